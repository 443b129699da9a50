import random
import re

from marginalia.llm import shared, substrings
from marginalia.llm.substrings import SubstringDedup, SuffixAutomaton, against_reference, spans

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, length):
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = WORD.findall((text or "").encode())
        gone = [False] * len(words)
        for s in range(len(words) - length + 1):
            window = tuple(words[s : s + length])
            if window in seen:
                gone[s : s + length] = [True] * length
            seen.add(window)
        out[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(50)]
    hot = [rng.choice(vocabulary) for _ in range(33)]
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (19, 20, 21, 45, 80, 150)]
    texts = [None, "", "  \n", "x " * 70, "a b " * 40, "é x ü " * 15]
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 5)):
            piece = rng.choice([hot, *base, [rng.choice(vocabulary) for _ in range(rng.randrange(40))]])
            low = rng.randrange(max(1, len(piece) - 15))
            words += piece[low : low + rng.randrange(15, 90)]
        texts.append(rng.choice([" ", "\n", "\t ", "  "]).join(words))
    texts += texts[10:16]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


def result(spark, rows, length):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS spans")
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in SubstringDedup(df, length).run().collect()}


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows, 20) == brute(rows, 20)


def test_split_anchors_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_ANCHOR", 3)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    rows = corpus(2)
    assert result(spark, rows, 20) == brute(rows, 20)


def test_empty_table(spark):
    assert result(spark, [], 20) == {}


def test_automaton_matching_statistics():
    rng = random.Random(4)
    for _ in range(30):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(25))] for _ in range(4)]
        automaton = SuffixAutomaton()
        for t in texts:
            automaton.add(t)
        asked = [rng.randrange(3) for _ in range(40)]
        held = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max((n for n in range(1, e + 1) if tuple(asked[e - n : e]) in held), default=0) for e in range(1, 41)]
        assert automaton.matching(asked) == want


def test_spans_and_reference(spark):
    assert spans([1, 2, 3, 0, 1, 2, 3, 4], 3) == [(0, 3), (4, 8)]
    reference = " ".join(f"r{i}" for i in range(40))
    df = spark.createDataFrame([(1, "a " + reference + " b"), (2, "nothing here"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in against_reference(df, [reference], 30).collect()] == [(1, 1, 41)]
