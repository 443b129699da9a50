"""Hybrid retrieval for a batch of questions: candidates, fusion, rerank, diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..limits import SUBSTRING_POOL, TOP_K
from ..lineage import cut
from .fusion import minmax, mmr, ranked_lists, rerank, rrf
from .lexical import drop_excluded, lexical_search, with_texts
from .vector import vector_search


def pool_size(k: int) -> int:
    return max(3 * k, 12)


def _again(hits: DataFrame) -> DataFrame:
    """Ranks without gaps after rows were dropped."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def finish(lists: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    fused = rrf(cut(lists))
    fused = fused.withColumn("score", minmax(F.col("score"), Window.partitionBy("query_id")))
    clean = F.when(F.size(X.negated_terms(F.col("query"))) > 0, X.without_negated(F.col("query"))).otherwise(F.col("query"))
    hits = with_texts(cut(fused.join(queries.select("query_id", clean.alias("query")), "query_id")), chunks, "text", "context")
    chosen = mmr(cut(rerank(hits)), k)  # a pool a query
    return chosen.select("query_id", "rank", "chunk_id", "source_id", "score", "bm25", "vec", "text", "context", "detail")


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, scanned: int | None = SUBSTRING_POOL, embedded: DataFrame | None = None) -> DataFrame:
    """Ranked hits of each query (query_id, notebook_id, query, vector); a null vector means lexical only.

    ``scanned`` bounds the chunks that the substring scan scores for a query; None takes all. ``embedded`` are
    the chunks with their embeddings, if ``chunks`` hasn't those: texts needn't be joined to them.
    """
    pool = pool_size(k)
    queries = cut(queries)  # a batch, read many times below
    lexical = lexical_search(chunks, queries, pool, scanned)
    vectors = _again(drop_excluded(cut(vector_search(chunks if embedded is None else embedded, queries, pool)), chunks, queries))
    return finish(ranked_lists(lexical, vectors), chunks, queries, k)


def retrieve_multi(chunks: DataFrame, phrasings: DataFrame, k: int = TOP_K, scanned: int | None = SUBSTRING_POOL, embedded: DataFrame | None = None) -> DataFrame:
    """Several phrasings of a question, fused: (query_id, phrasing, notebook_id, query, vector).

    Phrasing 0 is the question itself: its exclusions hold for all lists and it alone is the reference
    of the rerank; other phrasings lose exclusions of their own.
    """
    pool = pool_size(k)
    phrasings = cut(phrasings)  # a batch, read many times below
    first = phrasings.filter("phrasing = 0")
    own = F.when(F.col("phrasing") == 0, F.col("query")).otherwise(X.without_negated(F.col("query")))
    key = F.struct("query_id", "phrasing")
    asked = phrasings.select(key.alias("query_id"), "notebook_id", own.alias("query"), "vector")
    excluded = first.select("query_id", "query")

    def of_question(hits: DataFrame, value: str, at: int) -> DataFrame:
        flat = hits.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.phrasing").alias("phrasing"), "chunk_id", "source_id", value, "rank")
        kept = drop_excluded(flat, chunks, excluded)
        order = Window.partitionBy("query_id", "phrasing").orderBy("rank")
        other = F.lit(0.0).alias("vec" if value == "bm25" else "bm25")
        return kept.select("query_id", (2 * F.col("phrasing") + at).alias("list"), F.row_number().over(order).alias("rank"), "chunk_id", "source_id", value, other)

    lists = of_question(lexical_search(chunks, asked, pool, scanned), "bm25", 0).unionByName(of_question(cut(vector_search(chunks if embedded is None else embedded, asked, pool)), "vec", 1))
    return finish(lists, chunks, first, k)
