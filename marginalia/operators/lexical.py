"""Lexical retrieval over chunks: closed-form BM25, its substring fallback and exclusion terms.

Everything is batch-first: ``queries`` (query_id, notebook_id, query) against ``chunks`` (chunk_id,
source_id, notebook_id, context, text). The corpus is read once to find where the batch's phrases occur
(narrow rows), statistics are aggregated from that, and scores are joined from both. Where a batch is small enough to be
sent to every task, its best are found by two scans that shuffle only each task's best (``scan``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..limits import SUBSTRING_POOL, TOP_K
from ..lineage import cut, spread
from . import scan

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
#: Distinct terms of a batch that are sent to every task at most; a term is a word, so that is some megabytes.
BROADCAST_TERMS = 200_000
#: Pairs of query and term of a batch that are sent to every task at most, for each term that may be.
PAIRS_A_TERM = 10
#: Hits that are sent to every task at most, to meet their texts.
BROADCAST_HITS = 200_000
#: Of the chunks that one query may score, so many times more are looked into before all others are.
NEAR = 4
#: Runs of letters that a term can be made of, in small letters.
RUN = f"[a-z0-9_]+|[{X.CJK_WORD}]+"
_BREAK = "\u0000"


def searchable(chunks: DataFrame) -> DataFrame:
    """Chunks with ``low`` (context and text, small letters) and ``dl`` (indexed trigrams)."""
    context = F.coalesce("context", F.lit(""))
    length = F.greatest(F.length(context) - 2, F.lit(0)) + F.greatest(F.length("text") - 2, F.lit(0))
    return chunks.withColumns({"low": F.lower(F.concat(context, F.lit(_BREAK), "text")), "dl": length.cast("long")})


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row over the whole index, all notebooks: ``n_docs`` and ``avgdl``."""
    return searchable(chunks).agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def query_phrases(queries: DataFrame) -> DataFrame:
    """(query_id, notebook_id, phrase): small letters, distinct."""
    clean = X.without_negated(F.col("query"))
    return queries.select("query_id", "notebook_id", F.explode(F.array_distinct(F.transform(X.phrases(clean), F.lower))).alias("phrase"))


def _part(n: int) -> Callable[[Column], Column]:
    return lambda i: F.substring(F.col("run"), i, F.lit(n))


def runs_holding(docs: DataFrame, low: str, terms: DataFrame, each: bool, most: int = BROADCAST_TERMS) -> DataFrame:
    """``docs`` without ``low``, with each ``run`` of its letters and each ``term`` inside, or each place of a term.

    A term is made of word letters or of CJK ones only, so every occurrence lies inside one run of such
    letters. A run's parts of the terms' lengths are joined to the terms by equality; up to ``most``
    distinct terms are sent to every task.
    """
    distinct = terms.select("term").distinct()
    sizes = [tuple(r) for r in distinct.select(X.starts_cjk(F.col("term")), F.length("term")).distinct().collect()]  # one row a length
    keep = [c for c in docs.columns if c != low]
    runs = spread(docs).select(*keep, F.explode(X.matches(F.col(low), RUN)).alias("run"))
    none, every = F.array().cast("array<string>"), []
    for cjk, n in sorted(sizes):
        fits = (F.length("run") >= n) & (X.starts_cjk(F.col("run")) if cjk else ~X.starts_cjk(F.col("run")))
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length("run") - (n - 1), F.lit(1))), _part(n))
        every.append(F.when(fits, parts if each else F.array_distinct(parts)).otherwise(none))
    parts = runs.select(*keep, "run", F.explode(F.concat(none, *every)).alias("term"))
    small = distinct.limit(most + 1).count() <= most
    return parts.join(F.broadcast(distinct) if small else distinct, "term")


def occurrences(chunks: DataFrame, phrases: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """(chunk_id, source_id, notebook_id, dl, phrase, tf) wherever a phrase occurs, overlaps counted."""
    keep = ["chunk_id", "source_id", "notebook_id", "dl"]
    met = runs_holding(searchable(chunks).select(*keep, "low"), "low", phrases.select(F.col("phrase").alias("term")), True, most)
    return met.groupBy(*keep, F.col("term").alias("phrase")).agg(F.count(F.lit(1)).alias("tf"))


def bm25_scores(chunks: DataFrame, queries: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """(query_id, chunk_id, source_id, bm25) for chunks of the query's notebook that hold a phrase.

    Document frequencies and lengths are over all notebooks; only then is the notebook applied.
    Scores are rounded to ten places, so equal texts tie whatever order their sums were taken in.
    """
    asked = query_phrases(queries)
    found = occurrences(chunks, asked, most)
    stats = corpus_stats(chunks)
    n = F.col("n_docs")
    df = F.sum((F.col("tf") > 0).cast("long"))  # reads tf, so that the scan below is the same exchange
    idf = found.groupBy("phrase").agg(df.alias("df")).crossJoin(F.broadcast(stats))  # one row of statistics
    value = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = idf.select("phrase", "avgdl", F.when(value <= 0, F.lit(LEAST_IDF)).otherwise(value).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = found.join(idf, "phrase").select("chunk_id", "source_id", "notebook_id", "phrase", weight.alias("w"))
    return scored.join(asked, ["phrase", "notebook_id"]).groupBy("query_id", "chunk_id", "source_id").agg(F.round(F.sum("w"), 10).alias("bm25"))


def top(hits: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The first ``k`` of each query by score, with 1-based ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score), *(ties or ("chunk_id",)))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _batch(asked: DataFrame, term: str, chunks: DataFrame, most: int) -> tuple[DataFrame, list[tuple]] | None:
    """The queries of (query_id, notebook_id, term) by number ``q``, and (q, notebook, terms); None if a scan can't serve them."""
    if not most or not scan.plain_keys(chunks, asked) or not scan.one_row_each(chunks):
        return None
    if asked.limit(PAIRS_A_TERM * most + 1).count() > PAIRS_A_TERM * most or asked.select(term).distinct().limit(most + 1).count() > most:
        return None
    found = asked.groupBy("query_id", "notebook_id").agg(F.collect_list(term).alias("terms")).collect()  # bounded just above
    schema = asked.select(F.lit(0).alias("q"), "query_id", "notebook_id").schema
    numbered = asked.sparkSession.createDataFrame([(i, r["query_id"], r["notebook_id"]) for i, r in enumerate(found)], schema)
    return numbered.drop("notebook_id"), [(i, r["notebook_id"], r["terms"]) for i, r in enumerate(found)]


def _named(scored: DataFrame, numbered: DataFrame) -> DataFrame:
    return scored.join(F.broadcast(numbered), "q").select("query_id", "chunk_id", "source_id", F.col("score").alias("bm25"))


def bm25_top(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, most: int = BROADCAST_TERMS) -> DataFrame:
    """The first ``k`` of ``bm25_scores``: a scan for frequencies, then one that keeps the best of each task."""
    batch = _batch(query_phrases(queries), "phrase", chunks, most)
    if batch is None:
        return top(bm25_scores(chunks, queries, most), "bm25", k)
    numbered, rows = batch
    asked = scan.Asked.of(rows)
    docs = spread(searchable(chunks).select("chunk_id", "source_id", "notebook_id", "dl", "low"))
    df = np.zeros(len(asked.terms))
    for r in scan.frequencies(docs, asked.terms).groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a phrase
        df[r["term"]] = r["n"]
    n, avgdl = corpus_stats(chunks).first()
    value = np.log((n - df + 0.5) / (df + 0.5))
    idf = np.where(value <= 0, LEAST_IDF, value)

    def weigh(term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    best = scan.scores(docs, asked, False, weigh, k, True, 10)
    return top(_named(best, numbered), "bm25", k)


def substring_scores(chunks: DataFrame, queries: DataFrame, pool: int | None = SUBSTRING_POOL, most: int = BROADCAST_TERMS, best: int | None = None) -> DataFrame:
    """(query_id, chunk_id, source_id, bm25): occurrences of the query's needles in the text.

    A pool of the first chunks by id bounds what one query scores; None takes all. All are scored then, but where only
    the ``best`` of a query by score and id are asked for, a scan keeps no more of each task.
    """
    asked = queries.select("query_id", "notebook_id", F.explode(F.transform(X.needles(X.without_negated(F.col("query"))), F.lower)).alias("term"))
    batch = _batch(asked, "term", chunks, most)
    if batch is not None:
        return _scanned(chunks, *batch, pool, best)
    docs = chunks.select("chunk_id", "source_id", "notebook_id", F.lower("text").alias("low"))
    met = runs_holding(docs, "low", asked, False)
    apart = (F.length("run") - F.length(F.replace("run", F.col("term"), F.lit("")))) / F.length("term")
    counted = met.groupBy("chunk_id", "source_id", "notebook_id", "term").agg(F.sum(apart).alias("m"))
    found = counted.join(asked, ["term", "notebook_id"]).groupBy("query_id", "chunk_id", "source_id").agg(F.sum("m").alias("bm25"))
    return found if pool is None else _first_by_id(found, pool)


def _first_by_id(found: DataFrame, pool: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("chunk_id")  # a limit of the fallback's contract; None is exact
    return found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= pool).drop("_n")


def _scanned(chunks: DataFrame, numbered: DataFrame, rows: list[tuple], pool: int | None, best: int | None) -> DataFrame:
    """``substring_scores`` of a batch that is sent to every task.

    A query that has its pool within the least ids is settled there, as all its pool lies among them; only for
    the others are all chunks scanned.
    """
    docs = chunks.select("chunk_id", "source_id", "notebook_id", F.lit(0).cast("long").alias("dl"), F.lower("text").alias("low"))

    def found_in(some: DataFrame, rows: list[tuple], k: int | None, by_score: bool = False) -> DataFrame:
        return scan.scores(spread(some), scan.Asked.of(rows), True, lambda term, times, dl: times, k, by_score)

    if pool is None:
        return _named(found_in(docs, rows, best, True), numbered)
    least = chunks.select("chunk_id").orderBy("chunk_id").limit(NEAR * pool).agg(F.max("chunk_id")).first()[0]
    if least is None:
        return _named(found_in(docs, rows, pool), numbered)
    near = cut(found_in(docs.filter(F.col("chunk_id") <= least), rows, pool))
    settled = {r["q"] for r in near.groupBy("q").count().filter(F.col("count") >= pool).select("q").collect()}  # a row a query at most
    others = [r for r in rows if r[0] not in settled]
    found = near.filter(F.col("q").isin(*settled)) if settled else near.limit(0)
    if others:
        found = found.unionByName(found_in(docs, others, pool))
    return _first_by_id(_named(found, numbered), pool)


def needle_count(low: str, needles: str):
    return F.aggregate(needles, F.lit(0.0), lambda a, n: a + X.count_apart(F.col(low), n))


def with_texts(hits: DataFrame, chunks: DataFrame, *columns: Column | str, most: int = BROADCAST_HITS) -> DataFrame:
    """``hits`` with columns of their chunks; up to ``most`` hits are sent to the chunks, so that no texts are shuffled."""
    few = hits.limit(most + 1).count() <= most
    met = (F.broadcast(hits) if few else hits).join(chunks.select("chunk_id", *columns), "chunk_id")
    return spread(met) if few else met


def drop_excluded(hits: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits whose text holds none of the query's excluded terms."""
    excluded = queries.select("query_id", F.explode(X.negated_terms(F.col("query"))).alias("term"))
    if excluded.isEmpty():
        return hits
    texts = with_texts(hits.join(excluded, "query_id"), chunks, "text")
    bad = texts.filter(F.lower("text").contains(F.col("term"))).select("query_id", "chunk_id").distinct()
    return hits.join(bad, ["query_id", "chunk_id"], "left_anti")


def lexical_search(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, pool: int | None = SUBSTRING_POOL) -> DataFrame:
    """(query_id, chunk_id, source_id, bm25, rank): BM25, merged with or replaced by the substring scan.

    BM25 alone answers a query if it found something and no term is below three letters; else counts of
    the needles are added to its hits, and chunks that only the scan found follow. Excluded terms are
    applied after the cut where BM25 answers alone, before it where both do, as the contract has it. The scan
    scores ``pool`` chunks a query, the first by id, or ten times ``k`` if that is more; None scores all, of which only
    ``k`` that BM25 didn't find can come in, unless exclusions are still to drop some.
    """
    most = None if pool is None else max(10 * k, pool)
    full = cut(bm25_top(chunks, queries, k).withColumn("first", F.lit(0)))  # k rows a query, read several times below
    terms = X.query_terms(X.without_negated(F.col("query")))
    asked = queries.join(full.select("query_id").distinct().withColumn("found", F.lit(True)), "query_id", "left")
    asked = asked.withColumns({"short": F.exists(terms, lambda t: F.length(t) < 3), "found": F.coalesce("found", F.lit(False))})
    needs = asked.filter((~F.col("found") | F.col("short")) & (F.size(X.needles(X.without_negated(F.col("query")))) > 0))
    alone = full.join(needs.select("query_id"), "query_id", "left_anti").select("query_id", "chunk_id", "source_id", "bm25", "rank")
    needs = cut(needs.withColumn("drops", F.col("found") & (F.size(X.negated_terms(F.col("query"))) > 0)))

    def beyond(some: DataFrame, n: int | None) -> DataFrame:
        """Chunks that the scan found and BM25 didn't, the first ``n``; BM25 found ``k`` at most, so twice that holds ``k`` others."""
        scanned = substring_scores(chunks, some.select("query_id", "notebook_id", "query"), most, best=n and n + k)
        others = scanned.join(full.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        return cut(top(others, "bm25", n or (1 << 31) - 1).withColumn("first", F.lit(1)))

    if most is not None:
        rest = beyond(needs, None)
    else:
        rest, drops = beyond(needs.filter("NOT drops"), k), needs.filter("drops")
        rest = rest if drops.isEmpty() else rest.unionByName(beyond(drops, None))
    both = full.join(needs.select("query_id", F.transform(X.needles(X.without_negated(F.col("query"))), F.lower).alias("needles")), "query_id")
    both = with_texts(both, chunks, F.lower("text").alias("low"))
    both = both.withColumn("bm25", F.col("bm25") + needle_count("low", "needles")).drop("low", "needles")
    rest = rest.join(needs.select("query_id", "found"), "query_id")
    merged = both.withColumn("found", F.lit(True)).unionByName(rest)
    # found: exclusions, then the cut; not found: the cut, then exclusions
    scan_only = top(merged.filter("NOT found").drop("rank"), "bm25", k, "chunk_id")
    kept = top(drop_excluded(merged.filter("found"), chunks, queries).withColumnRenamed("rank", "was"), "bm25", k, "first", "was", "chunk_id")
    parts = [drop_excluded(alone, chunks, queries), drop_excluded(scan_only, chunks, queries), kept]
    columns = ["query_id", "chunk_id", "source_id", "bm25", "rank"]
    every = parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns))
    order = Window.partitionBy("query_id").orderBy("rank")
    return every.withColumn("rank", F.row_number().over(order))
