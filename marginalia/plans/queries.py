"""Registered queries over the given tables, and the same in SQL where SQL can say it.

``documents`` stand for sources and their whole-text chunks, ``benchmark`` for questions,
``embeddings`` for chunk vectors, ``conversations`` for messages, ``pages`` for fetched pages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import catalog, chunking, citations, context, evaluate, fusion, lexical, overview, retrieve, vector
from ..sinks import export
from ..sources import files
from ..streaming import ingest as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PLACES = 6
POOL = 24


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.lit("all").alias("notebook_id"), F.lit("").alias("context"), "text")


def embedded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return chunks_of(spark, sf_dir).join(vectors, "chunk_id", "left")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text, asked whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("all").alias("notebook_id"), F.col("text").alias("query"))


def keyword_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text's longest word, equals by name: a term to exclude, or a second phrasing."""
    words = F.array_sort(F.transform(F.array_distinct(X.query_terms(F.col("query"))), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return questions(spark, sf_dir).withColumn("query", F.coalesce(F.get(words, F.lit(0))["t"], F.lit("")))


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return questions(spark, sf_dir).join(vectors, "query_id", "left")


def rounded(c: str):
    return F.round(F.col(c), PLACES).alias(c)


# SQL fragments ----------------------------------------------------------------------------------

_WORDS = """
words AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM benchmark),
longest AS (SELECT item_id AS query_id, w AS query, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS n FROM words)"""
_KEYWORDS = _WORDS + ",\nasked AS (SELECT query_id, query FROM longest WHERE n = 1)"
_PHRASES = _WORDS + ",\nphrases AS (SELECT DISTINCT item_id AS query_id, lower(w) AS p FROM words WHERE length(w) >= 3)"
#: A phrase of word letters occurs inside words only. Overlapping occurrences differ from plain ones only for phrases with a border, an end equal to a beginning.
_BM25 = """,
docs AS (SELECT doc_id, lower(text) AS low, greatest(length(text) - 2, 0) AS dl FROM documents),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
distinct_phrases AS (SELECT p, len(list_filter(range(1, length(p)), lambda i: left(p, i) = right(p, i))) > 0 AS bordered FROM (SELECT DISTINCT p FROM phrases)),
doc_words AS (SELECT doc_id, dl, w, count(*) AS c FROM (SELECT doc_id, dl, unnest(regexp_extract_all(low, '[a-z0-9_]+')) AS w FROM docs) GROUP BY ALL),
inside AS (SELECT w, p, CASE WHEN bordered THEN len(list_filter(range(1, length(w) - length(p) + 2), lambda i: substr(w, i, length(p)) = p)) ELSE len(string_split(w, p)) - 1 END AS m
           FROM (SELECT DISTINCT w FROM doc_words) JOIN distinct_phrases ON contains(w, p)),
occurs AS (SELECT doc_id, dl, p, sum(c * m) AS tf FROM doc_words JOIN inside USING (w) GROUP BY ALL),
freq AS (SELECT p, count(*) AS df FROM occurs GROUP BY p),
idf AS (SELECT p, avgdl, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM freq, stats),
scored AS (SELECT query_id, doc_id AS chunk_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 10) AS bm25
           FROM occurs JOIN idf USING (p) JOIN phrases USING (p) GROUP BY query_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scored)"""
_VECTORS = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, list_cosine_similarity(q.e, c.e) AS vec FROM v q, v c),
near_ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec DESC, chunk_id) AS rank FROM near)"""


# statistics and lexical retrieval ---------------------------------------------------------------


@query("SELECT count(*) AS n_docs, round(avg(greatest(length(text) - 2, 0)), 6) AS avgdl FROM documents")
def corpus_stats(spark, sf_dir):
    return lexical.corpus_stats(chunks_of(spark, sf_dir)).select("n_docs", rounded("avgdl"))


@query(f"WITH {_PHRASES}{_BM25} SELECT query_id, chunk_id, rank, round(bm25, 6) AS bm25 FROM ranked WHERE rank <= 8")
def bm25_topk(spark, sf_dir):
    return lexical.bm25_top(chunks_of(spark, sf_dir), questions(spark, sf_dir)).select("query_id", "chunk_id", F.col("rank").cast("long"), rounded("bm25"))


@query(f"WITH {_PHRASES}{_BM25} SELECT query_id, chunk_id, rank, round(bm25, 6) AS bm25 FROM ranked WHERE rank <= 8")
def bm25_postings(spark, sf_dir):
    """As ``bm25_topk`` where the phrases are too many to be sent to every task."""
    found = lexical.bm25_top(chunks_of(spark, sf_dir), questions(spark, sf_dir), most=0)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long"), rounded("bm25"))


@query(f"""WITH {_PHRASES}{_BM25},
scoped AS (SELECT source AS notebook, query_id, chunk_id, bm25, row_number() OVER (PARTITION BY source, query_id ORDER BY bm25 DESC, chunk_id) AS rank
           FROM scored JOIN documents ON doc_id = chunk_id)
SELECT notebook, query_id, chunk_id, rank, round(bm25, 6) AS bm25 FROM scoped WHERE rank <= 3""")
def bm25_scoped(spark, sf_dir):
    """Every question asked of every notebook (source): statistics stay global."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("source_id"), F.col("source").alias("notebook_id"), F.lit("").alias("context"), "text")
    notebooks = docs.select(F.col("source").alias("notebook_id")).distinct()
    asked = questions(spark, sf_dir).drop("notebook_id").join(notebooks, how="cross")  # questions x notebooks, both small
    asked = asked.withColumn("query_id", F.struct("query_id", "notebook_id"))
    found = lexical.bm25_top(chunks, asked, 3)
    return found.select(F.col("query_id.notebook_id").alias("notebook"), F.col("query_id.query_id").alias("query_id"), "chunk_id", F.col("rank").cast("long"), rounded("bm25"))


_NEEDLES = """
needles AS (SELECT item_id AS query_id, lower(w) AS needle FROM words WHERE length(w) >= 2),
holding AS (SELECT doc_id, needle, len(string_split(low, needle)) - 1 AS m FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN (SELECT DISTINCT needle FROM needles) ON contains(low, needle)),
scanned AS (SELECT query_id, doc_id AS chunk_id, CAST(sum(m) AS DOUBLE) AS score FROM holding JOIN needles USING (needle) GROUP BY ALL)"""


@query(f"WITH {_WORDS},{_NEEDLES} SELECT query_id, chunk_id, score FROM scanned")
def like_fallback(spark, sf_dir):
    found = lexical.substring_scores(chunks_of(spark, sf_dir), questions(spark, sf_dir), None)
    return found.select("query_id", "chunk_id", F.col("bm25").alias("score"))


@query(f"""WITH {_KEYWORDS}
SELECT query_id, doc_id AS chunk_id FROM documents, asked WHERE NOT contains(lower(text), lower(query))""")
def neg_filter(spark, sf_dir):
    """All chunks but those that hold the excluded keyword."""
    asked = keyword_questions(spark, sf_dir).withColumn("query", F.concat(F.lit("notes -"), "query"))
    chunks = chunks_of(spark, sf_dir)
    every = chunks.select("chunk_id").join(asked.select("query_id"), how="cross")
    return lexical.drop_excluded(every, chunks, asked).select("query_id", "chunk_id")


_FIRST_BY_ID = """pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS k FROM scanned) WHERE k <= 2000),
"""
_LEXICAL = f"""{_PHRASES}{_BM25},{_NEEDLES},
answered AS (SELECT * FROM ranked WHERE rank <= {POOL}),
needing AS (SELECT item_id AS query_id FROM benchmark WHERE (item_id NOT IN (SELECT query_id FROM answered) OR item_id IN (SELECT item_id FROM words WHERE length(w) < 3)) AND item_id IN (SELECT query_id FROM needles)),
{_FIRST_BY_ID}joined AS (SELECT query_id, chunk_id, bm25 + coalesce(score, 0) AS bm25, 0 AS later, rank AS was FROM answered LEFT JOIN scanned USING (query_id, chunk_id) WHERE query_id IN (SELECT query_id FROM needing)
         UNION ALL SELECT query_id, chunk_id, score, 1, 0 FROM pool ANTI JOIN answered USING (query_id, chunk_id) WHERE query_id IN (SELECT query_id FROM needing)),
merged AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, later, was, chunk_id) AS rank FROM joined),
found AS (SELECT query_id, chunk_id, rank, bm25 FROM merged WHERE rank <= {POOL} UNION ALL SELECT query_id, chunk_id, rank, bm25 FROM answered WHERE query_id NOT IN (SELECT query_id FROM needing))"""
_LEXICAL_OF_ALL = _LEXICAL.replace(_FIRST_BY_ID, "").replace("FROM pool ANTI JOIN", "FROM scanned ANTI JOIN")


@query(f"WITH {_LEXICAL} SELECT query_id, chunk_id, rank, round(bm25, 6) AS bm25 FROM found")
def lexical_search(spark, sf_dir):
    found = lexical.lexical_search(chunks_of(spark, sf_dir), questions(spark, sf_dir), POOL)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long"), rounded("bm25"))


# text scalars -----------------------------------------------------------------------------------

_CLASS = X.CJK


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[{_CLASS}]')) + len(regexp_extract_all(text, '[A-Za-z0-9_]+'))
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]{{41,}}'), lambda r: (length(r) - 37) // 4)), 0) AS BIGINT) AS n_tokens FROM documents""")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"))


@query("SELECT item_id, array_to_string(regexp_extract_all(text, '[A-Za-z0-9_]+'), ' ') AS terms FROM benchmark")
def query_terms(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@query("""SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 3))), ' ') AS phrases,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2))), ' ') AS needles FROM benchmark""")
def query_phrases(spark, sf_dir):
    c = F.col("text")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(X.phrases(c)), " ").alias("phrases"), F.array_join(F.array_sort(X.needles(c)), " ").alias("needles"))


@query("""SELECT item_id, lower(regexp_extract(text, '[A-Za-z0-9_]+')) AS excluded, trim(text, ' ' || chr(10) || chr(9)) AS clean FROM benchmark""")
def neg_terms(spark, sf_dir):
    asked = F.concat(F.col("text"), F.lit(" -"), F.regexp_extract("text", X.WORD, 0))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(X.negated_terms(asked), " ").alias("excluded"), X.without_negated(asked).alias("clean"))


@query("""SELECT * FROM (VALUES ('コンピュータ', 'こんぴゅーた'), ('こんぴゅーた', 'コンピュータ'), ('書庫', '書庫'), ('書庫は', '書庫ハ')) AS t(term, swapped)""")
def kana_alt(spark, sf_dir):
    rows = spark.createDataFrame([("コンピュータ",), ("こんぴゅーた",), ("書庫",), ("書庫は",)], "term string")
    return rows.select("term", X.kana_swap(F.col("term")).alias("swapped"))


@query("""WITH c AS (SELECT doc_id, string_split(lower(text), '') AS c FROM documents)
SELECT doc_id, CASE WHEN len(c) < 2 THEN 0 ELSE len(list_distinct(list_transform(list_zip(c[:-2], c[2:]), lambda x: x[1] || x[2]))) END AS n_bigrams FROM c""")
def char_bigrams(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.bigram_set(F.lower("text"))).cast("long").alias("n_bigrams"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.sha256(F.col("text")).alias("sha256"))


@query("""WITH a AS (SELECT item_id, text, len(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS n, regexp_matches(regexp_replace(text, '[ \\t\\n]+$', ''), '[?？]$') AS asks,
  regexp_matches(text, '\\d') OR len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 12)) > 0 AS exact, contains(text, '"') AS quoted
  FROM (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 100000, split_part(text, '.', 1) || '?' FROM benchmark))
SELECT item_id, CAST(round(greatest(0.2, least(0.8, 0.5 + CASE WHEN n <= 3 AND NOT asks THEN -0.15 ELSE 0 END + CASE WHEN n >= 6 OR asks THEN 0.15 ELSE 0 END
  + CASE WHEN exact THEN -0.15 ELSE 0 END + CASE WHEN quoted THEN -0.1 ELSE 0 END)), 6) AS DOUBLE) AS alpha FROM a""")
def adaptive_alpha(spark, sf_dir):
    base = table(spark, sf_dir, "benchmark").select("item_id", "text")
    asks = base.select((F.col("item_id") + 100000).alias("item_id"), F.concat(F.split_part("text", F.lit("."), F.lit(1)), F.lit("?")).alias("text"))
    return base.unionByName(asks).select("item_id", F.round(fusion.adaptive_alpha(F.col("text")), PLACES).alias("alpha"))


# vectors and fusion -----------------------------------------------------------------------------


@query(f"WITH {_VECTORS} SELECT query_id, chunk_id, rank, round(vec, 6) AS vec FROM near_ranked WHERE rank <= 8 AND query_id % 50 = 0")
def vector_topk(spark, sf_dir):
    """Every fiftieth vector asks all vectors."""
    v = table(spark, sf_dir, "embeddings")
    chunks = v.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("source_id"), F.lit("all").alias("notebook_id"), "embedding")
    asked = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.lit("all").alias("notebook_id"), F.col("embedding").alias("vector"))
    return vector.vector_search(chunks, asked).select("query_id", "chunk_id", F.col("rank").cast("long"), rounded("vec"))


_VECTOR_QUESTIONS = _VECTORS.replace("FROM v q, v c", "FROM v q, v c WHERE q.vec_id IN (SELECT item_id FROM benchmark) AND c.vec_id IN (SELECT doc_id FROM documents)")
_BOTH = f"WITH {_PHRASES}{_BM25},{_VECTOR_QUESTIONS}, b AS (SELECT * FROM ranked WHERE rank <= {POOL}), n AS (SELECT * FROM near_ranked WHERE rank <= {POOL})"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    asked = vector_questions(spark, sf_dir)
    return lexical.bm25_top(chunks_of(spark, sf_dir), asked, POOL), vector.vector_search(embedded_chunks(spark, sf_dir), asked, POOL)


@query(_BOTH + """, lists AS (SELECT query_id, chunk_id, 0 AS list, rank FROM b UNION ALL SELECT query_id, chunk_id, 1, rank FROM n),
fused AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(list * 1000 + rank) AS first FROM lists GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS rank, round(score, 6) AS score FROM fused""")
def rrf_fusion(spark, sf_dir):
    fused = fusion.rrf(fusion.ranked_lists(*_both(spark, sf_dir)))
    return fused.select("query_id", "chunk_id", F.col("rank").cast("long"), rounded("score"))


_MINMAX = "CASE WHEN max({0}) OVER w - min({0}) OVER w < 1e-12 THEN CASE WHEN min({0}) OVER w < 1e-12 THEN 0.0 ELSE 1.0 END ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"


@query(f"WITH {_PHRASES}{_BM25} SELECT query_id, chunk_id, round({_MINMAX.format('bm25')}, 6) AS norm FROM ranked WHERE rank <= {POOL} WINDOW w AS (PARTITION BY query_id)")
def minmax_norm(spark, sf_dir):
    hits = lexical.bm25_top(chunks_of(spark, sf_dir), questions(spark, sf_dir), POOL)
    return hits.select("query_id", "chunk_id", F.round(fusion.minmax(F.col("bm25"), Window.partitionBy("query_id")), PLACES).alias("norm"))


@query(_BOTH + f""", bn AS (SELECT query_id, chunk_id, {_MINMAX.format('bm25')} AS bs FROM b WINDOW w AS (PARTITION BY query_id)),
vn AS (SELECT query_id, chunk_id, {_MINMAX.format('vec')} AS vs FROM n WINDOW w AS (PARTITION BY query_id)),
j AS (SELECT coalesce(bn.query_id, vn.query_id) AS query_id, coalesce(bn.chunk_id, vn.chunk_id) AS chunk_id, bs, vs FROM bn FULL JOIN vn ON bn.query_id = vn.query_id AND bn.chunk_id = vn.chunk_id)
SELECT query_id, chunk_id, round(CASE WHEN count(vs) OVER q = 0 THEN bs WHEN count(bs) OVER q = 0 THEN vs ELSE 0.4 * coalesce(vs, 0) + 0.6 * coalesce(bs, 0) END, 6) AS score FROM j WINDOW q AS (PARTITION BY query_id)""")
def convex_fusion(spark, sf_dir):
    return fusion.convex(*_both(spark, sf_dir), F.lit(0.4)).select("query_id", "chunk_id", rounded("score"))


@query(f"""WITH {_PHRASES}{_BM25}, pool AS (SELECT query_id, chunk_id, {_MINMAX.format('bm25')} AS s FROM ranked WHERE rank <= {POOL} WINDOW w AS (PARTITION BY query_id)),
terms AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM benchmark),
lex AS (SELECT query_id, chunk_id, s, avg((len(string_split(low, lower(w))) - 1)::DOUBLE / len(string_split(low, lower(w)))) AS l FROM pool JOIN terms USING (query_id) JOIN docs ON doc_id = chunk_id GROUP BY query_id, chunk_id, s)
SELECT query_id, chunk_id, round(0.7 * s + 0.3 * l, 6) AS score FROM lex""")
def lexical_rerank(spark, sf_dir):
    chunks, asked = chunks_of(spark, sf_dir), questions(spark, sf_dir)
    hits = lexical.bm25_top(chunks, asked, POOL).withColumn("score", fusion.minmax(F.col("bm25"), Window.partitionBy("query_id")))
    hits = hits.join(asked.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return fusion.rerank(hits).select("query_id", "chunk_id", rounded("score"))


def _mmr(pool: str, k: int = 8) -> str:
    """CTEs ``chosen_1`` to ``chosen_k`` (query_id, chunk_id, was, score) from ``pool`` (query_id, chunk_id, was, score): each step takes the best of what is left."""
    parts = [f"""
small AS (SELECT doc_id AS chunk_id, string_split(lower(left(text, 600)), '') AS c FROM documents WHERE doc_id IN (SELECT chunk_id FROM {pool})),
grams AS (SELECT chunk_id, CASE WHEN len(c) < 2 THEN [] ELSE list_distinct(list_transform(list_zip(c[:-2], c[2:]), lambda x: x[1] || x[2])) END AS g FROM small),
pairs AS (SELECT DISTINCT a.chunk_id AS a, b.chunk_id AS b FROM {pool} a JOIN {pool} b ON a.query_id = b.query_id AND a.chunk_id <> b.chunk_id),
common AS (SELECT a, b, len(list_intersect(x.g, y.g)) AS shared, len(x.g) + len(y.g) AS n FROM pairs JOIN grams x ON x.chunk_id = a JOIN grams y ON y.chunk_id = b),
alike AS (SELECT a, b, shared::DOUBLE / (n - shared) AS likeness FROM common WHERE shared > 0),
left_1 AS (SELECT query_id, chunk_id, was, score, 0.0::DOUBLE AS worst FROM {pool})"""]
    for i in range(1, k + 1):
        parts.append(f"""
chosen_{i} AS (SELECT query_id, chunk_id, was, score FROM left_{i} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 0.7::DOUBLE * score - (1 - 0.7::DOUBLE) * worst DESC, was) = 1)""")
        if i < k:
            parts.append(f"""
left_{i + 1} AS (SELECT l.query_id, l.chunk_id, l.was, l.score, greatest(l.worst, coalesce(likeness, 0)) AS worst
  FROM left_{i} l JOIN chosen_{i} c ON c.query_id = l.query_id AND c.was <> l.was LEFT JOIN alike ON a = l.chunk_id AND b = c.chunk_id)""")
    return ",".join(parts)


_CHOSEN = " UNION ALL ".join(f"SELECT query_id, {i} AS rank, chunk_id, score FROM chosen_{i}" for i in range(1, 9))


@query(f"""WITH {_PHRASES}{_BM25}, pool AS (SELECT query_id, chunk_id, rank AS was, {_MINMAX.format('bm25')} AS score FROM ranked WHERE rank <= {POOL} WINDOW w AS (PARTITION BY query_id)),
{_mmr('pool')} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM ({_CHOSEN})""")
def mmr_select(spark, sf_dir):
    chunks, asked = chunks_of(spark, sf_dir), questions(spark, sf_dir)
    hits = lexical.bm25_top(chunks, asked, POOL).withColumn("score", fusion.minmax(F.col("bm25"), Window.partitionBy("query_id")))
    return fusion.mmr(hits.join(chunks.select("chunk_id", "text"), "chunk_id")).select("query_id", "rank", "chunk_id", rounded("score"))


@query(f"""WITH {_LEXICAL_OF_ALL},{_VECTOR_QUESTIONS}, n AS (SELECT * FROM near_ranked WHERE rank <= {POOL}),
lists AS (SELECT query_id, chunk_id, 0 AS list, rank, bm25, 0 AS vec FROM found UNION ALL SELECT query_id, chunk_id, 1, rank, 0, vec FROM n),
fused AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(list * 1000 + rank) AS first, sum(bm25) AS bm25, sum(vec) AS vec FROM lists GROUP BY query_id, chunk_id),
scaled AS (SELECT query_id, chunk_id, bm25, vec, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, first) AS was, {_MINMAX.format('rrf')} AS s FROM fused WINDOW w AS (PARTITION BY query_id)),
terms AS (SELECT item_id AS query_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM benchmark),
lexed AS (SELECT query_id, chunk_id, was, s, avg((len(string_split(low, lower(w))) - 1)::DOUBLE / len(string_split(low, lower(w)))) AS l FROM scaled JOIN terms USING (query_id) JOIN docs ON doc_id = chunk_id GROUP BY ALL),
reranked AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, was) AS was FROM (SELECT *, 0.7::DOUBLE * s + 0.3::DOUBLE * l AS score FROM lexed)),
{_mmr('reranked')} SELECT query_id, rank, chunk_id, round(score, 6) AS score, round(bm25, 6) AS bm25, round(vec, 6) AS vec FROM ({_CHOSEN}) JOIN fused USING (query_id, chunk_id)""")
def retrieve_hybrid(spark, sf_dir):
    """Every chunk that the substring scan finds is scored."""
    hits = retrieve.retrieve(chunks_of(spark, sf_dir), vector_questions(spark, sf_dir), scanned=None, embedded=embedded_chunks(spark, sf_dir))
    return hits.select("query_id", "rank", "chunk_id", rounded("score"), rounded("bm25"), rounded("vec"))


@query()
def retrieve_multi(spark, sf_dir):
    first = vector_questions(spark, sf_dir).withColumn("phrasing", F.lit(0))
    second = keyword_questions(spark, sf_dir).select("query_id", "notebook_id", "query", F.lit(None).cast("array<float>").alias("vector"), F.lit(1).alias("phrasing"))
    hits = retrieve.retrieve_multi(chunks_of(spark, sf_dir), first.unionByName(second), embedded=embedded_chunks(spark, sf_dir))
    return hits.select("query_id", "rank", "chunk_id", rounded("score"))


@query(f"""WITH {_PHRASES}{_BM25}, expected AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
met AS (SELECT query_id, doc_id, rank FROM expected e LEFT JOIN (SELECT query_id, chunk_id AS doc_id, rank FROM ranked WHERE rank <= 8) r USING (query_id, doc_id))
SELECT query_id, round(count(rank)::DOUBLE / count(*), 6) AS recall, round(coalesce(1.0::DOUBLE / min(rank), 0), 6) AS reciprocal_rank FROM met GROUP BY query_id""")
def eval_recall_mrr(spark, sf_dir):
    """Expected are the documents that hold the benchmark text whole."""
    chunks, asked = chunks_of(spark, sf_dir), questions(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    holds = chunks.select("chunk_id", "text").join(F.broadcast(items), F.col("text").contains(F.col("query")))  # benchmark items
    cases = holds.groupBy("query_id").agg(F.collect_list("chunk_id").alias("expected"))
    return evaluate.case_results(cases, lexical.bm25_top(chunks, asked)).select("query_id", rounded("recall"), rounded("reciprocal_rank"))


# catalog ----------------------------------------------------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY source, sha256(text)) THEN 'SOURCE_ALREADY_EXISTS' END AS error FROM documents""")
def source_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("notebook_id"), X.sha256(F.col("text")).alias("sha256"))
    return catalog.dedup_sources(docs).select(F.col("id").alias("doc_id"), "error")


@query("""SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS n_sources, count(l_orderkey) AS n_chunks
FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def notebook_counts(spark, sf_dir):
    notebooks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("notebook_id"))
    return catalog.counts(notebooks, sources, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id")))


@query("""SELECT o_custkey AS notebook_id, o_orderstatus AS kind, max(o_orderkey) AS id, round(arg_max(o_totalprice, o_orderkey), 2) AS price FROM orders GROUP BY ALL""")
def latest_per_group(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("notebook_id"), F.col("o_orderstatus").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    return catalog.latest(rows, "notebook_id", "kind").withColumn("price", F.round("price", 2))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 6")
def recent_messages(spark, sf_dir):
    return catalog.recent(table(spark, sf_dir, "conversations"), "conv_id", 6, "turn").select("conv_id", "turn", "role")


@query("""WITH kept AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))
SELECT (SELECT count(*) FROM customer WHERE c_mktsegment <> 'BUILDING') AS n_notebooks, (SELECT count(*) FROM kept) AS n_sources,
  (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))) AS n_chunks""")
def cascade_delete(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    tables = {
        "notebooks": customers.select(F.col("c_custkey").alias("id")),
        "sources": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("notebook_id")),
        "chunks": table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id")),
    }
    left = catalog.delete_notebooks(tables, customers.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id")))
    counts = [left[name].agg(F.count(F.lit(1)).alias(f"n_{name}")) for name in ("notebooks", "sources", "chunks")]
    return counts[0].join(counts[1], how="cross").join(counts[2], how="cross")  # one row each


@query("""SELECT doc_id, 'N-' || source || CASE WHEN lang = 'en' THEN '' ELSE ' > ' || lang END AS context FROM documents""")
def rename_context(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.when(F.col("lang") == "en", F.col("source")).otherwise(F.concat_ws(" > ", "source", "lang"))
    return docs.select("doc_id", chunking.renamed_context(held, F.col("source"), F.concat(F.lit("N-"), "source")).alias("context"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber - 1 AS seq, max(l_linenumber - 1) OVER (PARTITION BY l_orderkey) AS last FROM lineitem)
SELECT l_orderkey AS source_id, CAST(seq AS BIGINT) AS seq FROM c WHERE last + 1 <= 3 OR seq IN (0, last // 2, last)""")
def overview_sample(spark, sf_dir):
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_linenumber") - 1).alias("seq"))
    return overview.sample_chunks(chunks).select("source_id", F.col("seq").cast("long"))


# ingest -----------------------------------------------------------------------------------------


@query()
def html_extract(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    made = files.from_pages(pages).join(pages.select("page_id", F.col("url").alias("origin")), "origin")
    return made.select("page_id", "kind", "title", "text", "error")


@query()
def chunk_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("title"), "text")
    return chunking.chunk_sources(docs)


@query("SELECT doc_id, left(source || ' > ' || lang, 200) AS context, source || ' > ' || lang || chr(10) || chr(10) || text AS input, lang AS section FROM documents")
def chunk_context(spark, sf_dir):
    made = chunking.chunk_context(F.col("source"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", made.alias("context"), chunking.embedding_input(made, F.col("text")).alias("input"), chunking.section(made, F.col("source")).alias("section"))


@query("""SELECT * FROM (VALUES ('a/b.TXT', 'txt'), ('x.md', 'md'), ('y.markdown', 'md'), ('z.htm', 'html'), ('p.pdf', 'pdf'), ('q.docx', NULL), ('noext', NULL)) AS t(path, kind)""")
def file_kinds(spark, sf_dir):
    rows = spark.createDataFrame([(p,) for p in ("a/b.TXT", "x.md", "y.markdown", "z.htm", "p.pdf", "q.docx", "noext")], "path string")
    return rows.select("path", files.kind_of(F.col("path")).alias("kind"))


# context, conversation, citations ---------------------------------------------------------------


@query()
def build_context(spark, sf_dir):
    chunks = chunks_of(spark, sf_dir)
    hits = lexical.bm25_top(chunks, questions(spark, sf_dir)).join(chunks.select("chunk_id", "text", "context"), "chunk_id")
    sources = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source_id"), F.col("source").alias("title"))
    return context.build_context(hits, sources).select("query_id", "block", F.size("sources").alias("n_sources"))


@query()
def history_window(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation"), F.col("turn").alias("id"), "role", F.col("text").alias("body"))
    return context.history(rows)


@query("""WITH u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN length(text) < 30 AND before IS NOT NULL AND before <> '' THEN before || ' ' || text ELSE text END AS expanded FROM u""")
def expand_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return turns.withColumn("before", before).select("conv_id", "turn", context.expand_query(F.col("text"), F.col("before")).alias("expanded"))


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with citations put in."""
    text = F.concat("text", F.lit(" [S"), F.col("turn"), F.lit("; s "), F.col("conv_id") % 5, F.lit("][S2] [see S]"))
    return table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("answer_id"), text.alias("text"))


_CITED = """WITH c AS (SELECT conv_id, turn, list_sort(list_distinct([turn, conv_id % 5, 2])) AS cited FROM conversations)"""


@query(f"{_CITED} SELECT conv_id, turn, array_to_string(cited, ',') AS cited FROM c")
def extract_citations(spark, sf_dir):
    found = citations.cited(X.nfkc("text")).cast("array<string>")
    return cited_answers(spark, sf_dir).select("answer_id.conv_id", "answer_id.turn", F.array_join(found, ",").alias("cited"))


@query(f"""{_CITED} SELECT conv_id, turn, array_to_string(list_filter(cited, lambda x: x BETWEEN 1 AND 3), ',') AS valid,
array_to_string(list_filter(cited, lambda x: x < 1 OR x > 3), ',') AS invalid, round(len(list_filter(cited, lambda x: x BETWEEN 1 AND 3)) / 3.0, 6) AS coverage FROM c""")
def validate_citations(spark, sf_dir):
    rows = cited_answers(spark, sf_dir).withColumn("n", citations.cited(X.nfkc("text")))
    good, bad = citations.valid(F.col("n"), F.lit(3)), citations.invalid(F.col("n"), F.lit(3))
    join = lambda c: F.array_join(c.cast("array<string>"), ",")
    return rows.select("answer_id.conv_id", "answer_id.turn", join(good).alias("valid"), join(bad).alias("invalid"), F.round(citations.coverage(good, F.lit(3)), PLACES).alias("coverage"))


def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant turn three sources: its own text, the turn before it, and a fixed one."""
    turns = table(spark, sf_dir, "conversations")
    before = F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit(""))
    bodies = F.array(F.col("text"), before, F.lit("Nothing that any turn would say."))
    rows = turns.withColumn("bodies", bodies).select(F.struct("conv_id", "turn").alias("answer_id"), F.posexplode("bodies").alias("s", "body"))
    return rows.withColumns({
        "s": F.col("s") + 1, "source_id": F.col("s").cast("long"), "title": F.concat(F.lit("T"), "s"), "section": F.lit(""), "chunk_ids": F.array(F.col("s").cast("long")),
    })


_SAID = """WITH answers AS (SELECT conv_id, turn, text || ' [S' || turn || '; s ' || (conv_id % 5) || '][S2] [see S]' AS answer FROM conversations),
cut AS (SELECT conv_id, turn, string_split(regexp_replace(regexp_replace(answer, '([。．！？!?\\n；])', '\\1' || chr(1), 'g'), '[.](\\s)', '.' || chr(1) || '\\1', 'g'), chr(1)) AS p FROM answers),
said AS (SELECT * FROM (SELECT conv_id, turn, unnest(range(len(p))) AS place, trim(unnest(p), ' ' || chr(9) || chr(10) || chr(13)) AS raw FROM cut) WHERE raw <> ''),
sentences AS (SELECT *, regexp_replace(regexp_replace(lower(raw), '\\[[^\\[\\]]+\\]', ' ', 'g'), '\\s+', '', 'g') AS bare FROM said)"""


def _grams_sql(c: str) -> str:
    return f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"


@query(f"""{_SAID},
claims AS (SELECT conv_id, turn, {_grams_sql('b')} AS claim FROM (SELECT conv_id, turn, arg_max(bare, place) AS b FROM sentences WHERE length(bare) >= 2 GROUP BY ALL)),
bodies AS (SELECT conv_id, turn, [text, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), 'Nothing that any turn would say.'] AS bodies FROM conversations),
sources AS (SELECT conv_id, turn, s, {_grams_sql('b')} AS grams FROM (SELECT conv_id, turn, unnest([1, 2, 3]) AS s, regexp_replace(lower(unnest(bodies)), '\\s+', '', 'g') AS b FROM bodies)),
held AS (SELECT conv_id, turn, s, len(list_intersect(claim, grams)) / len(claim)::DOUBLE AS o FROM claims JOIN sources USING (conv_id, turn)),
judged AS (SELECT conv_id, turn, a.s AS n, any_value(a.o) AS own, max(b.o) AS best FROM held a JOIN held b USING (conv_id, turn) WHERE a.s <> b.s AND a.s IN (turn, conv_id % 5, 2) GROUP BY ALL),
sets AS (SELECT conv_id, turn, string_agg(n, ',' ORDER BY n) FILTER (own >= 0.3) AS confirmed, string_agg(n, ',' ORDER BY n) FILTER (own < 0.3 AND best >= 0.3 AND best - own >= 0.2) AS misattributed FROM judged GROUP BY ALL)
SELECT conv_id, turn, coalesce(confirmed, '') AS confirmed, coalesce(misattributed, '') AS misattributed FROM conversations LEFT JOIN sets USING (conv_id, turn)""")
def verify_grounding(spark, sf_dir):
    found = citations.grounding(cited_answers(spark, sf_dir), answer_sources(spark, sf_dir).select("answer_id", "s", "body"))
    return found.select("answer_id.conv_id", "answer_id.turn", F.array_join(F.col("confirmed").cast("array<string>"), ",").alias("confirmed"), F.array_join(F.col("misattributed").cast("array<string>"), ",").alias("misattributed"))


@query(f"""{_SAID},
judged AS (SELECT *, length(bare) >= 5 AS claims, contains(raw, '[S2]') AS cites,
  contains(raw, '?') OR split_part(lower(regexp_extract(raw, '[^\\s]+')), chr(39) , 1) IN ({', '.join(repr(w) for w in X.QUESTION_WORDS)})
  OR len(list_filter([{', '.join(repr(d) for d in citations.DISCLAIMERS)}], lambda d: contains(raw, d))) > 0 AS excused FROM sentences),
flagged AS (SELECT *, coalesce(lead(cites AND NOT claims) OVER (PARTITION BY conv_id, turn ORDER BY place), false) AS vouched FROM judged),
found AS (SELECT conv_id, turn, string_agg(raw, '|' ORDER BY place) AS uncited FROM flagged WHERE claims AND NOT cites AND NOT excused AND NOT vouched GROUP BY ALL)
SELECT conv_id, turn, coalesce(uncited, '') AS uncited FROM conversations LEFT JOIN found USING (conv_id, turn)""")
def uncited_sentences(spark, sf_dir):
    rows = citations.uncited(cited_answers(spark, sf_dir))
    return rows.select("answer_id.conv_id", "answer_id.turn", F.array_join("uncited", "|").alias("uncited"))


@query()
def citation_report(spark, sf_dir):
    made = citations.report(cited_answers(spark, sf_dir), answer_sources(spark, sf_dir))
    return made.select("answer_id.conv_id", "answer_id.turn", F.to_json("report").alias("report"), export.status_line(F.col("report")).alias("status"))


@query("""SELECT conv_id, turn, contains(text, '?') OR lower(regexp_extract(text, '[^\\s]+')) IN ('what','how','why','when','where','who','which','does','is','are','was','were','will','would','could','should','can') AS asks FROM conversations""")
def question_filter(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.looks_like_question(X.nfkc("text")).alias("asks"))


def export_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("notebook_id"), F.when(F.col("lang") == "en", "url").otherwise("txt").alias("kind"),
        F.col("text").alias("title"), F.concat(F.lit("http://example.com/"), "lang", F.lit("_"), "doc_id").alias("origin"), F.lit("2021-03-09T12:00:00").alias("added_at"),
    )


_TEX = "title"
for _a, _b in (("{", "\x01"), ("}", "\x02"), ("\\", "\\\\"), ("%", "\\%"), ("&", "\\&"), ("$", "\\$"), ("#", "\\#"), ("_", "\\_"), ("^", "\\^{}"), ("~", "\\~{}"), ("\x01", "{\\{}"), ("\x02", "{\\}}")):
    _TEX = f"replace({_TEX}, '{_a}', '{_b}')"
_FLAT = "array_to_string(string_split(rtrim(text, chr(10)), chr(10)), ' ')"


@query(f"""WITH s AS (SELECT doc_id AS id, source AS notebook_id, {_FLAT} AS title, lang FROM documents)
SELECT notebook_id, string_agg('@misc{{source' || id || ',' || chr(10) || '  title = {{' || {_TEX} || '}},' || chr(10) || '  howpublished = {{http://example.com/' || lang || '\\_' || id || '}},' || chr(10)
  || '  year = {{2021}},' || chr(10) || '  note = {{Source, added 2021-03-09}}' || chr(10) || '}}', chr(10) || chr(10) ORDER BY id) || chr(10) AS body FROM s GROUP BY notebook_id""")
def export_bibtex(spark, sf_dir):
    return export.bibtex(export_sources(spark, sf_dir))


@query(f"""WITH s AS (SELECT doc_id AS id, source AS notebook_id, {_FLAT} AS title, lang FROM documents)
SELECT notebook_id, string_agg('TY  - ' || CASE WHEN lang = 'en' THEN 'ELEC' ELSE 'GEN' END || chr(10) || 'TI  - ' || title || chr(10) || 'UR  - http://example.com/' || lang || '_' || id || chr(10)
  || 'PY  - 2021' || chr(10) || 'DA  - 2021/03/09' || chr(10) || 'ER  -', chr(10) || chr(10) ORDER BY id) || chr(10) AS body FROM s GROUP BY notebook_id""")
def export_ris(spark, sf_dir):
    return export.ris(export_sources(spark, sf_dir))


@query()
def export_markdown(spark, sf_dir):
    sources = export_sources(spark, sf_dir).withColumn("title", F.substring("title", 1, 500))
    notebooks = sources.select(F.col("notebook_id").alias("id"), F.col("notebook_id").alias("name")).distinct()
    docs = table(spark, sf_dir, "documents")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("src"), F.col("conv_id") % 20).alias("notebook_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"), "role", F.col("text").alias("body"), F.lit("{}").alias("citation_report"))
    notes = docs.select(F.col("source").alias("notebook_id"), F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit("noted").alias("body"))
    outputs = catalog.latest(notes.select("notebook_id", F.col("title").alias("kind"), "id", "body", F.lit("{}").alias("citation_report")), "notebook_id", "kind")
    return export.markdown(notebooks, sources, notes, outputs, turns)


# streaming --------------------------------------------------------------------------------------


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_window_counts(spark, sf_dir):
    """The streaming aggregation, here over the whole table at once."""
    counted = stream.windowed_counts(table(spark, sf_dir, "events"))
    return counted.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
