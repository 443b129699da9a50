import random
import re

from marginalia.llm import licenses
from marginalia.llm.licenses import NOTICES, hitting_words, scan


def grams(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(rows):
    """(document, template) by containment over every stretch twice the template's size."""
    out = set()
    for i, text in rows:
        s = grams(text)
        for k, (_, notice) in enumerate(NOTICES):
            t = set(grams(notice))
            size = len(t)
            if any(len(t & set(s[a : a + size])) >= 0.8 * size for a in range(max(1, len(s)))):
                out.add((i, k))
    return out


def corpus():
    rng = random.Random(1)
    filler = lambda n: " ".join(rng.choice("lorem license the of under permission ipsum dolor version work".split()) for _ in range(n))
    texts = [None, "", "...", "mit license"]
    for _, notice in NOTICES:
        for n in (0, 3, 200):
            texts.append(f"{filler(n)} {notice.upper()}\n{filler(n)}")
        edited = notice.split()
        if len(edited) > 25:
            edited[12] = "changed"
            texts.append(filler(40) + " " + " ".join(edited))
        texts.append(filler(10) + " " + " ".join(notice.split()[: len(notice.split()) // 2]))
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS size", "2 AS license")
    got = {(r["doc_id"], r["template_id"]) for r in scan(df).collect()}
    want = brute(rows)
    # stretches around a window may reach further than the template's size
    assert want <= got
    far = {(i, k) for i, k in got - want}
    assert all(len(set(grams(NOTICES[k][1])) & set(grams(rows[i][1]))) >= 0.8 * len(set(grams(NOTICES[k][1]))) for i, k in far)


def test_hitting_words_hit_every_shingle():
    texts = [t for _, t in NOTICES]
    chosen = set(hitting_words(texts))
    assert all(set(g) & chosen for t in texts for g in grams(t))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert scan(docs).collect() == []
    some = spark.createDataFrame([(1, "Released under the MIT License.")], "doc_id long, text string")
    assert scan(some, licenses.notices(spark).limit(0)).collect() == []
    assert [r["license"] for r in scan(some).collect()] == ["MIT"]
