"""The pipeline on a small corpus, stage by stage against what its operators must do."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from marginalia.llm import packing, queries
from test_jaccard import brute as jaccard_brute
from test_substrings import brute as substring_brute


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)
    kinds = {"en": "the of and that was with for it his on are as at be this".split(), "fr": "le la des était avec pour où que les dans une sur pas".split()}
    passage = " ".join(rng.choice(kinds["en"]) + str(rng.randrange(99)) for _ in range(60))
    rows = []
    for i in range(120):
        lang = rng.choice(list(kinds))
        words = [rng.choice(kinds[lang]) + rng.choice("abcdefgh") * rng.randrange(3) for _ in range(rng.randrange(60, 200))]
        if i % 6 == 0:
            words[20:20] = passage.split()
        rows.append([i, " ".join(words), lang, f"s{i % 3}"])
    for i in range(120, 140):  # exact and near copies
        words = rows[i - 120][1].split()
        if i % 2:
            words[3] = "changed"
        rows.append([i, " ".join(words), rows[i - 120][2], "s1"])
    rows += [[140, "123 !!! 456", "en", "s0"], [141, None, None, None], [142, "", "fr", "s2"]]
    path = tmp_path_factory.mktemp("corpus")
    table = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"file://{path}/documents.parquet")
    return f"file://{path}"


def test_stages(spark, folder):
    docs = queries.table(spark, folder, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language ID", "n-gram Jaccard join", "substring dedup", "mixing sources to target weights", "packing"]
    rows = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())

    known = stages["language ID"](spark, docs, folder)
    assert known.columns == columns and {i for i, _ in rows(known)} == set(range(140))
    known = known.cache()
    apart = stages["n-gram Jaccard join"](spark, known, folder).cache()
    want = jaccard_brute(rows(known), 5, 80)
    assert apart.columns == columns and {i for i, _ in rows(apart)} == {i for i, (_, c) in want.items() if i == c} and apart.count() < 125
    cut = stages["substring dedup"](spark, apart, folder).cache()
    whole, left = dict(rows(apart)), dict(rows(cut))
    for i, (n, removed, kept) in substring_brute(rows(apart), 50).items():
        assert (left.get(i) == (kept if removed else whole[i])) if n > removed else i not in left
    assert cut.columns == columns and any(len(left[i]) < len(whole[i]) for i in left)
    mixed = stages["mixing sources to target weights"](spark, cut, folder)
    assert mixed.columns == columns and {i for i, _ in rows(mixed)} <= set(left)
    pieces = stages["packing"](spark, mixed.cache(), folder).collect()
    ids = packing.WordEncoder(queries.tokenizer_path()).encode(pa.array([t for _, t in rows(mixed)]))
    assert sum(len(np.frombuffer(p["ids"], "<u4")) for p in pieces) == sum(len(x) + 1 for x in ids)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_each_stage_starts_on_free_heaps(spark, folder):
    """A local session's tasks run in the driver's JVM, so its full collections can be counted."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if b.getName() in ("G1 Old Generation", "PS MarkSweep", "MarkSweepCompact"))
    pack, docs = dict(corpus_pipeline.STAGES)["packing"], queries.table(spark, folder, "documents")
    before = full()
    pack(spark, docs, folder)
    assert full() >= before + 1
    assert all(hasattr(stage, "__wrapped__") for _, stage in corpus_pipeline.STAGES)
