import random
import re
import tracemalloc

import pyarrow as pa

from marginalia.llm import bytewise, jaccard
from marginalia.llm.jaccard import JaccardJoin, divide_skip

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = WORD.findall(low)
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    texts = [None, "", " \n\t ", "one", "ONE", "one two", "Two one", "a b c", "A  b c", "a b\tC"]
    for _ in range(25):  # families of edited copies, with chains of edits
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 40, 90, 200]))]
        if rng.random() < 0.4:
            base[5:5] = passage
        texts.append(" ".join(base))
        now = list(base)
        for _ in range(rng.randrange(9)):
            now = list(base) if rng.random() < 0.6 else list(now)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(now))
                now[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
            texts.append(" ".join(now) if rng.random() < 0.8 else " ".join(now).upper())
    texts += [" ".join(passage)] * 3 + [" ".join(passage + [f"x{i}"]) for i in range(12)]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS n", "doc_id AS component")
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in JaccardJoin(df, **kw).run().collect()}


def test_matches_brute_force(spark):
    rows = corpus(1)
    assert result(spark, rows, k=3, percent=90) == brute(rows, 3, 90)


def test_other_settings(spark):
    rows = corpus(2)
    assert result(spark, rows, k=5, percent=80) == brute(rows, 5, 80)


def test_empty_table(spark):
    assert result(spark, [], k=3, percent=90) == {}


def test_divide_skip_counts_exactly():
    import numpy as np

    rng = np.random.default_rng(3)
    query = np.unique(rng.integers(0, 500, 120).astype(np.uint64))
    sets = [np.unique(np.concatenate((rng.choice(query, rng.integers(0, len(query))), rng.integers(0, 500, 30).astype(np.uint64)))) for _ in range(60)]
    for least in (1, 10, 60):
        required = np.full(60, least) + np.arange(60) % 7
        want = [len(np.intersect1d(query, s)) for s in sets]
        assert divide_skip(query, sets, required).tolist() == [w if w >= r else -1 for w, r in zip(want, required)]


def test_sets_are_made_in_little_memory():
    """Workers of all cores of an executor hold their slices at once, beside its heap."""
    column = pa.array([" ".join(f"w{i}x{j}" for j in range(400)) for i in range(1500)])
    tracemalloc.start()
    n = sum(len(s) for _, texts in bytewise.slices(column) for s in jaccard.shingle_sets(texts, 3, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1500 * 398 and peak < 50_000_000


def test_linked_sizes_meet_in_a_class():
    for percent in (50, 80, 90, 100):
        bounds = jaccard.Bounds(percent)
        for x in range(1, 3000):
            own = bounds.classes(x)
            for y in {-(-percent * x // 100), x - 1, x} - {0}:
                if 100 * y >= percent * x:
                    assert bounds.classes(y)[-1] in own


def large(words, seed, n):
    rng = random.Random(seed)
    return [f"{words}{rng.randrange(10**9)}" for _ in range(n)]


def test_large_sets_near_the_limit(spark):
    """Sizes on both sides of a power of two of the long maps, edits around the limit."""
    rows = []
    for family, n in enumerate((1500, 2290, 2310, 4600)):
        base = large("w", family, n)
        for edits in (0, 10, n // 70, n // 58, n // 50):
            text = list(base)
            for at in random.Random(edits).sample(range(n), edits):
                text[at] = f"e{at}"
            rows.append((len(rows), " ".join(text[: n - edits // 2])))
    assert result(spark, rows, k=3, percent=90) == brute(rows, 3, 90)
    assert result(spark, rows, k=5, percent=80) == brute(rows, 5, 80)


def test_unlike_large_sets_are_not_sent(spark):
    """Whole sets go only where the maps allow a link; one shared passage makes none."""

    class Counted(JaccardJoin):
        sent = 0

        def measure(self, pairs, name):
            found = super().measure(pairs, name)
            Counted.sent += found[1].count()
            return found

    passage = large("p", 9, 900)
    rows = [(i, " ".join(large("w", i, 5200 + 10 * i) + passage)) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in Counted(df, k=3, percent=90).run().collect()}
    assert found == {i: i for i in range(6)} and Counted.sent == 0


def test_unlike_sizes_share_no_list(spark):
    passage = large("p", 9, 30)
    rows = [(i, " ".join(passage + large("w", i, 4 << (2 * i)))) for i in range(6)]
    join = JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90)
    order = join.counts(join.scratch.save(join.summaries(), "summary"))
    assert join.short_lists(order).count() == 0
