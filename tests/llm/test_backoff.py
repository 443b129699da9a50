import math
import random
import re
from collections import Counter

import pytest

from marginalia.llm import backoff

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, factor=0.4, least=2):
    texts = [WORD.findall(t or "") for _, t in rows]
    grams = Counter(tuple(w[i : i + k]) for w in texts for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = sum(map(len, texts))
    out = {}
    for (i, _), w in zip(rows, texts):
        s = 0.0
        for j in range(len(w)):
            for k in range(min(j, 2), -1, -1):
                c = grams[tuple(w[j - k : j + 1])]
                if k and c < least:
                    s += math.log(factor)
                    continue
                s += math.log(c / (grams[tuple(w[j - k : j])] if k else total))
                break
        out[i] = (len(w), s)
    return out


def corpus():
    rng = random.Random(5)
    texts = [" ".join(rng.choice("the of and to a é ß cat dog runs".split()) for _ in range(rng.randrange(60))) for _ in range(80)]
    return list(enumerate([None, "", " ", "one", "one two", *texts, texts[0]]))


@pytest.mark.parametrize(("shuffled", "rowwise"), [(False, False), (True, False), (False, True)])
def test_matches_brute_force(spark, monkeypatch, shuffled, rowwise):
    monkeypatch.setattr(backoff, "BLOCK_BYTES", 900)
    monkeypatch.setattr(backoff, "PARTITION_BYTES", 2000)
    if shuffled:
        monkeypatch.setattr(backoff, "BROADCAST_BYTES", 0)
    if rowwise:
        monkeypatch.setattr(backoff, "MOST_PARTS", 0)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS block")
    got = {r["doc_id"]: r for r in backoff.score(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for i, (n, s) in want.items():
        assert got[i]["n_words"] == n == sum(got[i][f"n_order{k}"] for k in (1, 2, 3))
        assert got[i]["log_score"] == pytest.approx(s, abs=1e-6)
        assert (got[i]["mean_log_score"] is None) == (n == 0)


def test_empty_table(spark):
    assert backoff.score(spark.createDataFrame([], "doc_id long, text string")).collect() == []
