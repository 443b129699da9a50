"""Retrieval quality: recall and reciprocal rank of expected sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked_sources(hits: DataFrame) -> DataFrame:
    """(query_id, source_id, place): sources by their first hit."""
    first = hits.groupBy("query_id", "source_id").agg(F.min("rank").alias("rank"))
    return first.select("query_id", "source_id", F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "source_id")).alias("place"))


def case_results(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """(query_id, recall, reciprocal_rank) for cases (query_id, expected); an id expected twice counts twice."""
    expected = cases.select("query_id", F.explode("expected").alias("source_id"))
    met = expected.join(ranked_sources(hits), ["query_id", "source_id"], "left")
    scored = met.groupBy("query_id").agg(
        (F.count("place") / F.count(F.lit(1))).alias("recall"), F.coalesce(1 / F.min("place"), F.lit(0.0)).alias("reciprocal_rank")
    )
    return cases.select("query_id").join(scored, "query_id", "left").fillna(0.0, ["recall", "reciprocal_rank"])


def summary(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("n_cases"), F.avg("recall").alias("mean_recall"), F.avg("reciprocal_rank").alias("mrr"))
