"""Very long texts, repeated ids, nulls and columns whose names clash, through every operator and stage."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marginalia.llm import backoff, hilbert, jaccard, language, licenses, mixing, packing, quality, queries, shared, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NOTICE = licenses.NOTICES[10][1]


def odd_rows():
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "stormwind" for b in "aeiou" for c in ("ng", "ther", "lk", "st", "rn")]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = make(420_000) + " " + NOTICE  # above the slice of two megabytes
    assert len(long) > 2 << 20
    rows = [(0, None), (1, ""), (2, "one"), (3, long), (4, make(120)), (5, make(90)), (5, make(70)), (6, "same " + make(80)), (7, "ties ties ties")]
    rows += [(8, rows[4][1]), (9, long + " tail"), (10, rows[7][1]), (10, rows[7][1])]
    return rows


CLASHES = ("size", "curve", "shard", "slot", "epochs", "part", "taken", "lang_pred", "score", "n", "k", "ids", "start", "_size", "_part", "_epochs", "_n", "_k", "_text", "spans", "kept", "label")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame([(i, t, None if i == 4 else "en" if i % 2 else "de", None if i in (2, 5) else f"s{i % 2}") for i, t in odd_rows()], "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *(F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHES)).repartition(3)


def texts_of(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


def keeps_clashes(rows):
    return all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES)


def test_shards(odd):
    dims = ["source", "lang", "size", "doc_id"]
    rows = hilbert.plan_shards(odd, dims, 4).collect()
    sizes = Counter((i, len((t or "").encode()) + 16) for i, t in odd_rows())
    assert Counter((r["doc_id"], r["size"]) for r in rows) == sizes and all(r["dim_size"] == f"size of {r['doc_id']}" for r in rows)
    for s in range(4):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_curve_of_a_row(spark, odd, tmp_path):
    rows = hilbert.plan_shards(odd.filter("doc_id < 9"), ["n_chars", "doc_id"], 2, bits=2).collect()
    scratch = shared.Scratch(spark, "bounds")
    narrow = odd.filter("doc_id < 9").select("n_chars", "doc_id")
    bounds = [hilbert.step_bounds(narrow, c, 2, scratch) for c in ("n_chars", "doc_id")]
    for b, values in zip(bounds, ([len(t) for i, t in odd_rows() if t is not None and i < 9], [i for i, _ in odd_rows() if i < 9])):
        assert b == sorted(set(b)) and len(b) <= 3 and set(b) <= set(values)
    lengths = Counter((i, None if t is None else len(t)) for i, t in odd_rows())
    for r in rows:
        steps = [0 if v is None else sum(v >= x for x in b) for v, b in zip((r["n_chars"], r["doc_id"]), bounds)]
        assert lengths[r["doc_id"], r["n_chars"]] and r["curve"] == hilbert.hilbert_index(np.array(steps).reshape(2, 1), 2)[0]


def test_jaccard(odd):
    rows = jaccard.JaccardJoin(odd, k=3, percent=90).run().collect()
    sets = {}
    for i, t in odd_rows():
        words = WORD.findall((t or "").lower())
        sets.setdefault(i, []).append(len({tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}))
    assert Counter((r["doc_id"], r["n_shingles"]) for r in rows) == Counter((i, n) for i, ns in sets.items() for n in ns)
    component = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in rows}
    assert component[8, sets[8][0]] == 4 and component[9, sets[9][0]] == 3 and component[10, sets[10][0]] == 6 and component[0, 0] == 0


def test_licenses(odd, spark, monkeypatch):
    want = sorted(map(tuple, licenses.scan(odd).collect()))
    assert {(i, name) for i, _, name, *_ in want} == {(3, "MIT"), (9, "MIT")}
    monkeypatch.setattr(licenses, "MOST_TEMPLATE_SHINGLES", 40)
    assert len(licenses.template_groups({i: 30 for i in range(12)})) == 12
    few = odd.filter("doc_id < 5")
    assert sorted(map(tuple, licenses.scan(few).collect())) == [r for r in want if r[0] < 5]


def test_edited_templates(spark):
    """Notices of which edits leave 0.8 of the shingles are found, whatever surrounds them."""
    rng, rows, want = random.Random(3), [], set()
    for i in range(60):
        words = NOTICE.split()
        for at in rng.sample(range(0, len(words), 6), i % 2):
            words[at] = "edited"
        around = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(200))]
        rows.append((i, " ".join(around + words + around)))
        own = [w for w in re.findall(r"[a-z0-9]+", NOTICE.lower())]
        now = [w for w in re.findall(r"[a-z0-9]+", " ".join(words).lower())]
        sets = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (own, now)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0]):
            want.add(i)
    got = {r["doc_id"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("license = 'MIT'").collect()}
    assert len(want) > 30 and want <= got


def test_substrings(odd):
    unique = odd.filter("doc_id NOT IN (5, 10)")
    rows = {r["doc_id"]: r for r in substrings.SubstringDedup(unique, 20, carry=("label", "spans")).run().collect()}
    n = len(WORD.findall(odd_rows()[3][1]))
    assert rows[3]["n_words"] == n and rows[3]["n_removed"] == 0 and rows[9]["n_removed"] == n and rows[9]["kept"] == "tail"
    assert rows[8]["n_removed"] == 120 and rows[0]["kept"] == "" and all(r["label"] == f"label of {i}" and r["spans"] == f"spans of {i}" for i, r in rows.items())


def test_reference_in_shards(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{rng.randrange(60)}" for _ in range(900)]
    docs = [(i, " ".join(words[at : at + 80] + ["x"] + words[at + 10 : at + 10 + i])) for i, at in enumerate(range(0, 800, 40))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    reference = [" ".join(words[:500]), "short", " ".join(words[480:]), None]
    want = sorted(map(tuple, substrings.against_reference(df, reference, 12).collect()))
    monkeypatch.setattr(substrings, "REFERENCE_WORDS", 70)
    assert len(list(substrings.reference_shards(reference, 12))) > 10
    assert sorted(map(tuple, substrings.against_reference(df, reference, 12).collect())) == want and want
    assert substrings.against_reference(df, ["short"], 12).collect() == []


def test_packing(odd):
    got = Counter()
    for r in packing.pack(odd, queries.tokenizer_path(), 2).collect():
        got[r["doc_id"]] += len(r["ids"]) // 4
    own = packing.encoder(queries.tokenizer_path()).whole
    want = Counter()
    for i, t in odd_rows():
        if i not in (3, 9):
            want[i] += len(own.encode(t or "", add_special_tokens=False).ids) + 1
    assert {i: n for i, n in got.items() if i not in (3, 9)} == want and got[3] > 420_000 and got[9] - got[3] == len(own.encode("tail", add_special_tokens=False).ids)


def test_backoff(odd):
    rows = backoff.score(odd).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t in odd_rows())


def test_mixing(odd):
    plan = mixing.plan_mix(odd).collect()
    rows = mixing.mix(odd, mixing.plan_mix(odd)).collect()
    assert sum(r["epochs"] + (r["part"] > 0) for r in plan if r["taken"]) == len(rows) and keeps_clashes(rows)
    taken = Counter()
    for r in plan:
        taken[r["doc_id"]] += r["taken"]
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert +taken == +words


def test_language(odd):
    profiles = language.Profiles({"xx": [1, 2], "yy": [2, 3]}, 2)
    rows = language.identify(odd, profiles, names=("guess", "sure")).collect()
    assert keeps_clashes(rows) and texts_of(rows) == Counter(odd_rows())
    assert {r["guess"] for r in rows if not r["text"]} == {"und"}
    assert [c for c in language.identify(odd, profiles).columns if c == "score"] == ["score"]


def test_predictions_against_plain_ranks():
    """``Profiles.predict`` against the definition, on dictionaries of ranks."""
    rng = random.Random(4)
    texts = ["".join(rng.choice("aab béc ds") for _ in range(rng.randrange(1, 300))) for _ in range(60)] + ["a", "1a!", "zzz zz"]

    def ranked(text, depth):
        values, counts = language.grams(text)
        return [g for _, g in sorted(zip((-counts).tolist(), values.tolist()))][:depth]

    depth = 25
    known = {f"l{k}": ranked("".join(texts[k::5]), depth) for k in range(5)}
    model = language.Profiles(known, depth)
    for text in texts:
        own = ranked(text, depth)
        if not own:
            assert model.predict(text) == ("und", 0.0)
            continue
        far = {name: sum(abs(r - ranks.index(g)) if g in ranks else depth for r, g in enumerate(own)) for name, ranks in known.items()}
        best = min(sorted(far), key=far.get)
        lang, score = model.predict(text)
        assert lang == best and score == pytest.approx(1 - far[best] / (depth * len(own)))


def test_counts_of_ngrams():
    for text in ("Ab ab, abc", "é  É-é x", "one"):
        words = [w for w in re.split(r"[^a-zé]+", text.lower()) if w]
        padded, grams = " " + " ".join(words) + " ", Counter()
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if n == 1 and g != " " or n == 2 or n == 3 and g[1] != " ":
                    grams[g] += 1
        assert sorted(language.grams(text)[1].tolist()) == sorted(grams.values())


def test_rules(odd):
    rows = quality.ledger(odd).collect()
    assert Counter((r["doc_id"], r["n_words"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t in odd_rows())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stage(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    empty, got = stage(spark, odd.limit(0), ""), stage(spark, odd, "").collect()
    assert empty.collect() == []
    if name == "packing":
        assert {r["doc_id"] for r in got} == set(range(11))
        return
    assert empty.columns == odd.columns and keeps_clashes(got)
    ids = Counter(r["doc_id"] for r in got)
    if name == "language ID":
        assert not ids.keys() & {0, 1} and ids[5] in (0, 2)
    elif name == "n-gram Jaccard join":
        assert not ids.keys() & {8, 9, 10} and ids == Counter({0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 2, 6: 1, 7: 1})
    elif name == "substring dedup":
        assert not ids.keys() & {8, 10} and {r["text"] for r in got if r["doc_id"] == 9} == {"tail"}
    else:
        assert not ids.keys() & {0, 1}
