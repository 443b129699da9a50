"""Evaluation cases from JSON, all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..limits import EngineError


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expected) from a list of {"q": text, "sources": [whole numbers]}; any bad case raises."""
    rows = spark.read.text(path, wholetext=True)
    parsed = rows.select(F.try_parse_json("value").alias("v"))
    cases = parsed.select(F.posexplode_outer(F.try_variant_get("v", "$", "array<variant>")).alias("query_id", "case"))
    query = F.try_variant_get("case", "$.q", "string")
    sources = F.try_variant_get("case", "$.sources", "array<variant>")
    whole = F.forall(sources, lambda s: F.schema_of_variant(s) == "BIGINT")
    text = F.schema_of_variant(F.try_variant_get("case", "$.q", "variant")) == "STRING"
    good = F.coalesce(text & (F.trim(query) != "") & whole, F.lit(False))
    if cases.filter(~good).limit(1).count():
        raise EngineError("VALIDATION_FIELD_FORMAT_INVALID", "every case needs q, a text, and sources, whole numbers")
    return cases.select("query_id", query.alias("query"), F.transform(sources, lambda s: F.try_variant_get(s, "$", "bigint")).alias("expected"))
