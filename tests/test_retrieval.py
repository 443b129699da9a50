"""Lexical, vector and hybrid retrieval on literal sources, and BM25 against an FTS5 index."""

import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.operators import evaluate, fusion, lexical, retrieve, vector
from marginalia.plans import queries

CHUNKS = [
    (0, 1, 1, "", "書庫は知の書斎である。引用付きで文書と対話する。", [1.0, 0.0]),
    (1, 1, 1, "", "本日の天気は晴れ。気温は二十五度。", [0.0, 1.0]),
    (2, 1, 1, "", "猫は液体である説。", [0.0, 1.0]),
    (3, 2, 1, "", "Shelves is a local notebook. Citations are machine verified.", [0.0, 1.0]),
    (4, 2, 1, "", "The quick brown fox jumps over the lazy dog.", [0.0, 1.0]),
    (5, 3, 2, "other", "ただの別冊。unrelated words", None),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id long, source_id long, notebook_id long, context string, text string, embedding array<float>")


def asked(spark, *queries, notebook=1, vec=None):
    rows = [(i, notebook, q, vec) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id long, notebook_id long, query string, vector array<float>")


def ids(hits, q=0):
    return [r["chunk_id"] for r in hits.filter(F.col("query_id") == q).orderBy("rank").collect()]


def test_lexical_search(spark, chunks):
    found = lexical.lexical_search(chunks, asked(spark, "知の書斎", "machine verified citations", "猫", "unrelated", "zzzz存在しない語qqqq", "notebook -verified", "fox -dog lazy")).persist()
    assert ids(found, 0)[0] == 0 and ids(found, 1)[0] == 3 and ids(found, 2) == [2]
    assert ids(found, 3) == ids(found, 4) == ids(found, 5) == ids(found, 6) == []


def test_bm25_is_that_of_fts5(spark):
    texts = ["the fox ran", "a fox and another fox", "dogs and foxes run", "nothing here", "the the fox", "foxfoxfox", "running dogs"] * 3
    rows = [(i, i, 1, "ctx fox" if i % 5 == 0 else "", f"{t} {i}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "chunk_id long, source_id long, notebook_id long, context string, text string")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(context, text, tokenize='trigram')")
    db.executemany("INSERT INTO t(rowid, context, text) VALUES (?, ?, ?)", [(r[0] + 1, r[3], r[4]) for r in rows])
    want = {r - 1: -s for r, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH '\"fox\" OR \"running\"'")}
    for scan in (lexical.BROADCAST_TERMS, 0):
        got = {r["chunk_id"]: r["bm25"] for r in lexical.bm25_scores(df, asked(spark, "fox running"), scan).collect()}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], abs=1e-8) for i in want)


def test_cosine_guards(spark):
    pairs = [([1.0, 0.0], [1.0, 0.0], 1.0), ([], [], 0.0), ([1.0], [1.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([float("nan"), 1.0], [1.0, 1.0], 0.0), ([float("inf"), 1.0], [1.0, 1.0], 0.0)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(pairs)], "i int, a array<double>, b array<double>")
    got = [r["v"] for r in rows.select("i", vector.cosine(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()]
    assert got == [w for *_, w in pairs]


def test_rrf(spark):
    rows = [(0, 0, 1, 1, 1, 2.0, 0.0), (0, 0, 2, 2, 1, 1.0, 0.0), (0, 1, 1, 3, 1, 0.0, 0.9), (0, 1, 2, 2, 1, 0.0, 0.8)]
    lists = spark.createDataFrame(rows, "query_id int, list int, rank int, chunk_id long, source_id long, bm25 double, vec double")
    got = {r["chunk_id"]: r for r in fusion.rrf(lists).collect()}
    assert got[2]["score"] == pytest.approx(2 / 62) and got[1]["score"] == got[3]["score"] == pytest.approx(1 / 61)
    assert [got[i]["rank"] for i in (2, 1, 3)] == [1, 2, 3] and (got[2]["bm25"], got[2]["vec"]) == (1.0, 0.8)


def test_rerank_mmr_minmax(spark):
    rows = [(0, 1, "気候変動 影響", "気候変動の影響について", 0.8, 2), (0, 2, "気候変動 影響", "猫は液体である説の研究", 0.9, 1)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id long, query string, text string, score double, rank int")
    assert ids(fusion.rerank(hits)) == [1, 2]
    near = [(0, 1, "abcdefgh", 1.0, 1), (0, 2, "abcdefgi", 0.99, 2), (0, 3, "zyxwvuts", 0.95, 3)]
    hits = spark.createDataFrame(near, "query_id int, chunk_id long, text string, score double, rank int")
    assert ids(fusion.mmr(hits, 2, 0.5)) == [1, 3]
    one = spark.createDataFrame([(0, 5.0), (1, 0.0), (2, 1.0), (2, 3.0)], "q int, v double")
    got = one.select("q", "v", fusion.minmax(F.col("v"), Window.partitionBy("q")).alias("m")).orderBy("q", "v").collect()
    assert [r["m"] for r in got] == [1.0, 0.0, 0.0, 1.0]


def test_hybrid(spark, chunks):
    found = retrieve.retrieve(chunks, asked(spark, "書庫 対話", vec=[1.0, 0.0]), 3).persist()
    assert ids(found)[0] == 0 and found.count() == 3
    rows = [(0, 0, 1, "fox -dog", None), (0, 1, 1, "lazy dog", None), (0, 2, 1, "machine citations", None)]
    phrasings = spark.createDataFrame(rows, "query_id long, phrasing int, notebook_id long, query string, vector array<float>")
    assert ids(retrieve.retrieve_multi(chunks, phrasings, 3)) == [3]


def test_evaluation(spark):
    hits = spark.createDataFrame([(0, 1, 7), (0, 2, 8), (0, 3, 7), (1, 1, 9)], "query_id int, rank int, source_id long")
    cases = spark.createDataFrame([(0, [8]), (1, [1, 1, 9]), (2, [5])], "query_id int, expected array<long>")
    got = {r["query_id"]: (r["recall"], r["reciprocal_rank"]) for r in evaluate.case_results(cases, hits).collect()}
    assert got == {0: (1.0, 0.5), 1: (pytest.approx(1 / 3), 1.0), 2: (0.0, 0.0)}
    assert evaluate.summary(evaluate.case_results(cases, hits)).first()["n_cases"] == 3


def test_convex(spark):
    b = spark.createDataFrame([(0, 1, 2.0), (0, 2, 1.0), (1, 1, 3.0)], "query_id int, chunk_id long, bm25 double")
    v = spark.createDataFrame([(0, 2, 0.9), (0, 3, 0.1)], "query_id int, chunk_id long, vec double")
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in fusion.convex(b, v, F.lit(0.5)).collect()}
    assert got == {(0, 1): 0.5, (0, 2): 0.5, (0, 3): 0.0, (1, 1): 1.0}


ASKED = {0: "alpha bravo charlie delta echoes foxtrot fox owl", 1: "hotel india juliet kilogram limanda mike is"}
TEXTS = ["fox fox owl", "bravo charlie", "alpha delta echoes foxtrot", "mike mike", "is it so", "hotel india juliet", "nothing", "an owl", "kilogram limanda", "none", "zebra"]


def test_benchmark_texts_are_asked_whole(spark, tmp_path):
    """Against brute force: words beyond the five longest count, and short ones bring in the substring scan."""
    where = f"file://{tmp_path}"
    spark.createDataFrame(list(ASKED.items()), "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string").write.parquet(f"{where}/documents.parquet")
    mean = sum(max(len(t) - 2, 0) for t in TEXTS) / len(TEXTS)
    bm25, counts = {}, {}
    for q, text in ASKED.items():
        for w in set(re.findall("[a-z]+", text)):
            df = sum(w in t for t in TEXTS)
            for i, t in enumerate(TEXTS):
                if n := t.count(w):
                    counts[q, i] = counts.get((q, i), 0) + n
                    if len(w) > 2:
                        idf = max(math.log((len(TEXTS) - df + 0.5) / (df + 0.5)), 1e-6)
                        bm25[q, i] = bm25.get((q, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * max(len(t) - 2, 0) / mean))
    for name in ("bm25_topk", "bm25_postings", "bm25_scoped"):
        got = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in queries.QUERIES[name](spark, where).collect()}
        want = {k for q in ASKED for k in sorted((x for x in bm25 if x[0] == q), key=lambda x: (-round(bm25[x], 10), x))[: 3 if name == "bm25_scoped" else 8]}
        assert got.keys() == want and got == pytest.approx({k: bm25[k] for k in want}, abs=1e-6)
    assert {(r["query_id"], r["chunk_id"]): r["score"] for r in queries.QUERIES["like_fallback"](spark, where).collect()} == counts
    found = {(r["query_id"], r["chunk_id"]) for r in queries.QUERIES["lexical_search"](spark, where).collect()}
    assert (0, 0) in found and (1, 3) in found and (1, 4) in found  # document 4 holds the two-letter term alone


def test_hybrid_scores_chunks_of_any_id(spark, tmp_path):
    """The best chunk of the substring scan comes after 2,100 of lower id, where BM25 finds nothing and where it finds one."""
    where, last = f"file://{tmp_path}", 2100
    texts = ["zebra"] + ["is none"] * (last - 1) + ["is is is is"]
    spark.createDataFrame([(0, "is"), (1, "zebra is")], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{where}/embeddings.parquet")
    got = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in queries.QUERIES["retrieve_hybrid"](spark, where).collect()}
    assert got.get((0, last)) == got.get((1, last)) == 4.0 and (1, 0) in got and len(got) == 16
