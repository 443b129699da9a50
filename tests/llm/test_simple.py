"""Sharding, packing, mixing, language and quality against brute force."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import bytewise, hilbert, language, mixing, packing, quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=300):
    rng = random.Random(seed)
    kinds = {"en": "the of and that was with for".split(), "fr": "le la des était avec pour où".split(), "de": "der die und über mit für".split()}
    out = []
    for i in range(n):
        lang = rng.choice(list(kinds))
        text = "".join(rng.choice(kinds[lang]) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.choice([0, 1, 3, 40, 400])))
        out.append((i * 7 % 1000, text, rng.choice([lang, lang, lang, None]), rng.choice(["a", "a", "a", "b", "c", "é", None]), len(text)))
    out += [(1001, None, None, None, None), (1002, "", "en", "a", 0), (1003, "!!! 123", "en", "b", 7), (1004, "## ## $$\n## ## $$\n## ## $$", "en", "b", 26)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_hilbert_index_is_a_walk():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1)
        index = hilbert.hilbert_index(grid, bits)
        assert sorted(index) == list(range(grid.shape[1]))
        walk = grid[:, np.argsort(index)]
        assert (np.abs(np.diff(walk, axis=1)).sum(axis=0) == 1).all()


def test_shards(docs, empty):
    dims = ["source", "lang", "n_chars", "doc_id"]
    rows = hilbert.plan_shards(docs, dims, 40).collect()
    want = {i: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in documents()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    assert set(shards) == set(range(40)) and max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    assert all(sorted(r["slot"] for r in s) == list(range(len(s))) for s in shards.values())
    curve = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert curve == sorted(curve)
    assert hilbert.plan_shards(empty, dims, 40).collect() == []


def test_written_shards_and_manifest(docs, tmp_path, spark):
    plan = hilbert.plan_shards(docs, ["source", "n_chars"], 5)
    hilbert.write_shards(docs, plan, f"file://{tmp_path}/shards")
    back = spark.read.parquet(f"file://{tmp_path}/shards")
    assert back.count() == docs.count() and {r["_shard"] for r in back.select("_shard").distinct().collect()} == set(range(5))
    assert hilbert.manifest(plan, ["source", "n_chars"]).agg(F.sum("rows")).first()[0] == docs.count()


def test_mixing(docs, empty, spark):
    rows = mixing.plan_mix(docs).collect()
    source = {i: s for i, _, _, s, _ in documents()}
    sizes = Counter()
    for i, t, _, s, _ in documents():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: 1 + k % 3 for k, s in enumerate(order)}
    free, total, target = set(order), sum(sizes.values()), {}
    while True:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        free -= over
    target |= {s: level * weights[s] for s in free}
    taken = Counter()
    for r in rows:
        s = source[r["doc_id"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert sorted(map(tuple, mixing.plan_mix(docs).collect())) == sorted(map(tuple, rows))
    assert mixing.plan_mix(empty).collect() == []
    mixed = mixing.mix(docs, mixing.plan_mix(docs)).collect()
    assert Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]}) == sum((Counter({r["doc_id"]: len(WORD.findall(r["text"]))}) for r in mixed), Counter())


ODD = ["", None, "Hello, World's  can't 123 x1y", "ÀÉ é ΑΣ Σ İ ǅ ß", "日本語 テスト、です。   a\u0085b", "a\x1cb \x00 x", "<|endoftext|> Hi <|startoftext|>", "don'T we'LL", "👩‍👩‍👧 🙂 ¼ ² Ⅷ", "x" * 9000, "́a é ́", "</w> a</w>b"]


def test_ids_equal_the_tokenizers():
    from tokenizers import Tokenizer

    own = packing.WordEncoder(queries.tokenizer_path())
    whole = Tokenizer.from_file(queries.tokenizer_path())
    texts = ODD + [t for _, t, *_ in documents()]
    got = own.encode(pa.array(texts, pa.string()))
    for text, ids in zip(texts, got):
        assert ids.tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_packing(spark, docs, empty):
    rows = [(i, t) for i, t, *_ in documents()] + [(2000 + i, t) for i, t in enumerate(ODD)] + [(3000, "the cat sat " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pieces = packing.pack(df, queries.tokenizer_path(), 2, block=4).collect()
    own = packing.WordEncoder(queries.tokenizer_path()).encode(pa.array([t for _, t in rows], pa.string()))
    whole, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4").tolist()
        whole[p["doc_id"]].append((p["start"], ids, p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], len(ids)))
    for (key, _), ids in zip(rows, own):
        want = [*ids.tolist(), 2]
        assert sum((x for _, x, _ in sorted(whole[key])), []) == want and {n for *_, n in whole[key]} == {len(want)}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0
    assert packing.pack(empty, queries.tokenizer_path(), 2).collect() == []


def test_piece_is_whole_if_any_sequence_has_room():
    """Eight sequences of two pieces of 40 cost less than the one of 60, which alone has room for 25."""
    placed, rest = packing.fill([60] + [40] * 16 + [25], 9, 100, 1.0)
    assert (17, 0, 25, 0, 60) in placed and rest == [] and len(placed) == 18


@pytest.mark.parametrize("seed", range(4))
def test_fill_is_that_of_a_plain_search(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([0, 1, rng.randrange(40), rng.randrange(150)]) for _ in range(120)]
    queue, room, cost, want = [(-n, i, 0) for i, n in enumerate(lengths) if n], [64] * 40, [0.0] * 40, []
    while queue and any(room):
        n, item, start = min(queue)
        queue.remove((n, item, start))
        fits = [s for s in range(40) if room[s] >= -n] or [s for s in range(40) if room[s]]
        s = min(fits, key=lambda s: (cost[s], s))
        put = min(-n, room[s])
        want.append((item, start, put, s, 64 - room[s]))
        room[s], cost[s] = room[s] - put, cost[s] + put + 0.25 * put * put
        if put < -n:
            queue.append((n + put, item, start + put))
    assert packing.fill(lengths, 40, 64, 0.25) == (want, sorted((i, start, -n) for n, i, start in queue))


def test_letters_of_all_planes():
    assert [chr(c) for c in range(0x110000) if chr(c).isalpha() != (language._letters()[c] != 32)] == []
    values, _ = language.grams("\U00030000\U00031350")
    assert len(values)


def test_language(spark, empty):
    rows = [(i, t, l, s, n) for i, t, l, s, n in documents(2, 600)]
    df = spark.createDataFrame(rows, SCHEMA)
    known = df.filter(~language.held_out(F.col("doc_id")))
    profiles = language.fit(known, "doc_id", "text", "lang", per_language=50)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df.select("doc_id", "text"), profiles).collect()}
    assert got[1001] == got[1002] == got[1003] == (language.UNKNOWN, 0.0)
    judged = [(got[i][0], l) for i, t, l, *_ in rows if l and t and len(t) > 100 and zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(judged) > 20 and sum(a == b for a, b in judged) / len(judged) > 0.95
    assert all(0 <= s <= 1 for _, s in got.values())
    nothing = language.fit(empty, "doc_id", "text", "lang")
    assert {r["lang_pred"] for r in language.identify(df, nothing).collect()} == {"und"}


def test_out_of_place_distance_by_hand():
    profiles = language.Profiles({"a": [5, 6, 7], "b": [7, 6, 5]}, 4)
    text_grams = (np.array([5, 6, 9], np.uint32), np.array([3, 2, 1]))
    own = language.top(*text_grams, 4)
    assert own.tolist() == [5, 6, 9]
    ranks = {k: {g: r for r, g in enumerate(v)} for k, v in {"a": [5, 6, 7], "b": [7, 6, 5]}.items()}
    want = {k: sum(abs(r - v[g]) if g in v else 4 for r, g in enumerate(own.tolist())) for k, v in ranks.items()}
    assert want == {"a": 4, "b": 6} and profiles.languages == ["a", "b"]


def brute_quality(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_quality(docs, empty, monkeypatch):
    rows = {r["doc_id"]: r for r in quality.ledger(docs).collect()}
    for i, text, *_ in documents():
        r = rows[i]
        want = brute_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        base = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert bool(r["failed"] & quality.policy_mask("v1")) == base
    book = quality.apply_policy(quality.ledger(docs), "v1")
    assert book.filter("kept AND n_words < 50").count() == 0
    ablated = {r["rule"]: r for r in quality.ablate(quality.ledger(docs), "v1").collect()}
    assert ablated["few_words"]["n_failed"] == sum(r["n_words"] < 50 for r in rows.values())
    assert quality.ledger(empty).collect() == []


def test_slices_do_not_change_results():
    texts = [t for _, t, *_ in documents()]
    column = pa.array(texts, pa.string())
    small = [quality.measure(x) for _, x in bytewise.slices(column, 64)]
    (whole,) = (quality.measure(x) for _, x in bytewise.slices(column, 1 << 30))
    for k in quality.MEASURES:
        assert np.concatenate([s[k] for s in small]).tolist() == whole[k].tolist()


def test_tidied_yields_the_same_and_gives_memory_back(monkeypatch):
    given = []
    monkeypatch.setattr(bytewise, "give_back", lambda: given.append(True))
    assert list(bytewise.tidied(lambda batches: (x + 1 for x in batches))(iter([1, 2]))) == [2, 3] and given == [True]


def test_give_back_runs_here():
    bytewise.give_back()


def test_texts_go_to_workers_once_in_light_batches(spark):
    """Batches are held by the executor and by all its workers at once."""
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame(documents(n=40), SCHEMA)
    found = language.identify(docs, language.fit(docs, "doc_id", "text", "lang"))
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.children().head().output().size() == len(docs.columns)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    want = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs.select("doc_id", "text"), language.fit(docs, "doc_id", "text", "lang")).collect()}
    got = found.collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == want and sorted(tuple(r)[:5] for r in got if r["text"]) == sorted(tuple(r) for r in docs.collect() if r["text"])


def test_packing_encodes_few_texts_at_a_time():
    import tracemalloc

    encoder = packing.encoder(queries.tokenizer_path())
    rng = random.Random(5)
    texts = pa.array([" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "and"]) for _ in range(packing.SLICE_BYTES // 500)) for _ in range(100)])
    tracemalloc.start()
    encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_packing_gives_small_batches_back():
    packer = packing.Packer(0, pa.int64(), 4096, 1024, packing.QUADRATIC)
    made = [b for i in range(1100) for b in packer.add(i, np.full(4096, i, np.uint32))] + list(packer.close())
    assert sum(b.num_rows for b in made) == 1100 and max(b.nbytes for b in made) < 9_000_000
    assert sorted(set(np.frombuffer(b"".join(b["ids"][k].as_py() for b in made for k in range(b.num_rows)), "<u4").tolist())) == list(range(1100))
