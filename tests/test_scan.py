"""Scans of a batch against the joins that they stand for, and that neither runs' parts nor texts are shuffled by them."""

import numpy as np
import pytest

from marginalia.operators import lexical, retrieve, scan, vector

TEXTS = [
    "anana bananana anan", "知の書斎で猫と対話する。書斎 々々", "", None, "x" * 50 + " aaa aaaa", "the fox-fox foxfox_fox 9fox", "コンピュータ こんぴゅーた 猫猫猫",
    "ÉCOLE école fox", "fox", "fox", "THE Fox aa", "ab\u0000ab abab", "só fox cão",
]
ASKED = ["anana aaa fox", "書斎 猫猫 こんぴゅーた", "aa Fox fox the", "zzzz", "ab abab -fox", "猫", ""]


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, source_id long, notebook_id string, context string, text string, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def chunks(spark):
    vectors = [[1.0, 0.5, 0.0], [0.1, 0.7, 0.3], [0.0, 0.0, 0.0], None, [1.0, 2.0], [float("nan"), 1.0, 1.0], []]
    return table(spark, [(i, i % 4, "ab"[i % 2] if i != 5 else None, "fox" if i % 3 == 0 else None, t, vectors[i % 7]) for i, t in enumerate(TEXTS * 3)])


@pytest.fixture(scope="module")
def asked(spark):
    vectors = [[1.0, 0.4, 0.1], [0.3, 0.3], None, [0.0, 0.0, 0.0], [float("inf"), 0.0, 1.0], [], [0.2, 0.7, 0.6]]
    return spark.createDataFrame([(i, "ab"[i % 2], q, vectors[i]) for i, q in enumerate(ASKED)] + [(90, None, "fox", [1.0, 1.0, 1.0])], "query_id long, notebook_id string, query string, vector array<float>")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_best_of_bm25(spark, chunks, asked):
    for k in (2, 100):
        got = lexical.bm25_top(chunks, asked, k)
        assert rows_of(got) == rows_of(lexical.bm25_top(chunks, asked, k, 0)) != []
        assert "Generate" not in got._jdf.queryExecution().toString()  # before: a row for every part of every run of letters
    twice = table(spark, [(1, 1, "a", "", "fox one", None), (1, 1, "a", "", "fox fox two three", None), (2, 1, "a", "", "fox", None)] + [(i, 1, "b", "", "none", None) for i in range(3, 12)])
    for df in (twice, twice.limit(0)):
        assert rows_of(lexical.bm25_top(df, asked)) == rows_of(lexical.bm25_top(df, asked, most=0))


def test_substring_scan(chunks, asked, monkeypatch):
    monkeypatch.setattr(lexical, "NEAR", 1)
    for pool in (1, 3, 7, None):  # some queries have their pool among the least ids, others need all chunks
        got = lexical.substring_scores(chunks, asked, pool)
        assert rows_of(got) == rows_of(lexical.substring_scores(chunks, asked, pool, 0)) != []
        assert "Generate" not in got._jdf.queryExecution().toString()


def test_whole_substring_scan(spark, chunks, asked, monkeypatch):
    """Of all chunks, but no more of a task than may come in; all of a query whose exclusions are still to drop some."""
    best = lexical.substring_scores(chunks, asked, None, best=2)
    assert rows_of(lexical.top(best, "bm25", 2)) == rows_of(lexical.top(lexical.substring_scores(chunks, asked, None), "bm25", 2)) != []
    assert max(r["count"] for r in best.groupBy("query_id").count().collect()) <= 2 * best.rdd.getNumPartitions()
    texts = ["fox aa", "fox aa -9fox", "aa", "aa -aaaa", "foxfox an -fox-fox", "the ab -cão", "anan ab", "猫猫猫 an", "zzzz aa -foxfox"]
    some = spark.createDataFrame([(i, "ab"[i % 2], q) for i, q in enumerate(texts * 2)] + [(90 + i, "b", q) for i, q in enumerate(texts)], "query_id long, notebook_id string, query string")
    for k in (1, 3):
        want = rows_of(lexical.lexical_search(chunks, some, k, 1000))
        assert rows_of(lexical.lexical_search(chunks, some, k, None)) == want != []
    monkeypatch.setattr(lexical, "_batch", lambda *_: None)
    assert rows_of(lexical.lexical_search(chunks, some, 3, None)) == want


def test_small_slices(chunks, asked, monkeypatch):
    want = rows_of(lexical.bm25_top(chunks, asked, 3, 0))
    monkeypatch.setattr(scan, "SLICE_BYTES", 1)
    monkeypatch.setattr(scan, "WAITING", 1)
    terms = scan.Asked.of([(0, "a", ["fox", "anana"]), (1, "a", ["fox"])])
    first = scan.First(2, 2, True)
    for score in (1.0, 3.0, 2.0, 3.0):
        first.add(np.array([0, 1]), np.array([score, -score]), np.array([int(score), 7]), np.array([0, 0]))
    assert [x.tolist() for x in first.rows()[:3]] == [[0, 0, 1, 1], [3.0, 3.0, -1.0, -2.0], [3, 3, 7, 7]]
    assert terms.postings["a"][2].tolist() == [0, 1, 0] and rows_of(lexical.bm25_top(chunks, asked, 3)) == want


def test_vector_scan_is_cosine_to_the_bit(chunks, asked, monkeypatch):
    got = vector.vector_search(chunks, asked, 5)
    assert "zip_with" not in got._jdf.queryExecution().toString()
    found = rows_of(got)
    monkeypatch.setattr(vector, "BROADCAST_QUERIES", 0)
    assert found == rows_of(vector.vector_search(chunks, asked, 5)) != []


def test_texts_apart_from_embeddings(chunks, asked):
    columns = ["query_id", "rank", "chunk_id", "score"]
    want = rows_of(retrieve.retrieve(chunks, asked, 3).select(*columns))
    assert want == rows_of(retrieve.retrieve(chunks.drop("embedding"), asked, 3, embedded=chunks.drop("text", "context")).select(*columns)) != []
