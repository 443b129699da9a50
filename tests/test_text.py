"""Literal cases of the text functions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X
from marginalia.functions import tokens as K
from marginalia.plans import queries


def each(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    return [r["v"] for r in rows.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


def test_token_estimate(spark):
    texts = ["書庫 notebook 123", "parse_user_input", "a" * 41, "a" * 44, "a" * 45, "", "é", "Привет"]
    assert each(spark, texts, X.token_estimate) == [4, 1, 2, 2, 3, 0, 0, 0] == [K.estimate(t) for t in texts]


def test_query_terms(spark):
    assert each(spark, ["猫、犬。", "人々の生活", "über 9 x"], X.query_terms) == [["猫", "犬"], ["人々の生活"], ["ber", "9", "x"]]


def test_phrases_and_needles(spark):
    got = each(spark, ['weather "quote', "書庫は", "書庫学", "ab", "コード学"], X.phrases)
    assert got == [["weather", "quote"], ["書庫は", "書庫ハ"], ["書庫学"], [], ["コード", "ード学", "こーど", "ーど学"]]
    assert each(spark, ["猫 A is", "書庫学"], X.needles) == [["is", "猫"], ["書庫", "庫学"]]


def test_negated(spark):
    queries = ["機械学習 -Python -legacy", "AI -한국어", "state-of-the-art", "アルゴリズムの-最適化について", "Python -2 django"]
    assert each(spark, queries, X.negated_terms) == [["python", "legacy"], ["한국어"], [], [], ["2"]]
    assert each(spark, [queries[1], queries[4]], X.without_negated) == ["AI", "Python  django"]


def test_strip_and_lines(spark):
    assert each(spark, ["\n　a \t", "b"], X.strip) == ["a", "b"]
    texts = ["a\nb\r\nc", "a\n", "", "a b\x0bc", "a\n\nb"]
    assert each(spark, texts, X.lines) == [t.splitlines() for t in texts]


def test_grams(spark):
    assert each(spark, ["abc", "a", "", "𠮷野家"], lambda c: X.grams(c, 2)) == [["ab", "bc"], [], [], ["𠮷野", "野家"]]
    assert each(spark, ["aaa", "a.a"], lambda c: X.count_overlapping(c, F.lit("aa"))) == [2, 0]
    assert each(spark, ["aaaa", "a.a"], lambda c: X.count_apart(c, F.lit("aa"))) == [2, 0]
    assert each(spark, ["x\\Ey\\E"], lambda c: X.count_apart(c, F.lit("\\E"))) == [2]


def test_questions(spark):
    texts = ["What's new", "何ですか", "それを教えてください。", "A plain line", "really?", "", "Whatever it is"]
    assert each(spark, texts, X.looks_like_question) == [True, True, True, False, True, False, False]


def scanned_tail(text, tokens):
    """The suffix by definition: shorter suffixes counted from the right until the budget is met."""
    acc = run = 0
    sure = False
    for i in range(len(text) - 1, -1, -1):
        ch = text[i]
        word = bool(re.match("[A-Za-z0-9_]", ch))
        if word:
            run += 1
            gain = 2 if run == 41 else 1 if run > 41 and run % 4 == 1 else 0
            sure = sure or run == 41
            acc += gain
            if gain and acc >= tokens:
                return text[i:].lstrip()
            continue
        if run and not sure:
            acc += 1
            if acc >= tokens:
                return text[i + 1 :].lstrip()
        run, sure = 0, False
        if K.estimate(ch):
            acc += 1
            if acc >= tokens:
                return text[i:].lstrip()
    return text


@pytest.mark.parametrize("seed", range(6))
def test_tail_and_truncate(seed):
    rng = random.Random(seed)
    for _ in range(60):
        parts = [rng.choice(["a", "word", "x" * rng.randrange(38, 60), "猫", "書庫", " ", "  \n", "。", "é", "-"]) for _ in range(rng.randrange(14))]
        text = "".join(parts)
        for limit in (0, 1, 2, 3, 5, 9):
            want = next((text[:i] for i in range(len(text), -1, -1) if K.estimate(text[:i]) <= limit), "") if limit else ""
            assert K.truncate(text, limit) == want
            assert K.tail(text, limit) == (scanned_tail(text, limit) if limit else "")


def test_bigrams_of_whole_texts(spark, tmp_path):
    texts = ["ab" * 300 + "Cdefgh", "a", "", "Aa aA", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_bigrams"] for r in queries.QUERIES["char_bigrams"](spark, f"file://{tmp_path}").collect()}
    assert got == {i: len({(t or "").lower()[k : k + 2] for k in range(len(t or "") - 1)}) for i, t in enumerate(texts)}
