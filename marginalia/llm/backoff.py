"""Stupid-backoff language-model scores from the corpus's own n-gram counts.

Documents are gathered into blocks of bounded size. Each block's distinct n-grams (pre-aggregated with
their counts) are sent to a partition chosen by their hash; there they are the count table's entries and
the join's requests at once, and the partition answers each block with the corpus counts in the order
that the block asked. A block then scores every word of its documents and sums per document. Only
distinct n-grams of a block move, so frequent n-grams are no hot keys. N-grams are known by whole 64-bit
hashes.

The score of a word is log of count(history, word) / count(history) for the longest history whose n-gram
was counted ``least`` times or more, plus log(``factor``) for each word of history given up; a single
word is scored by its share of all words.

Defined cases: a null or empty text has no words, score 0 and a null mean; texts are scored whole (a
very long one is a block by itself); repeated rows count and are scored each; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise
from .shared import Scratch, shuffle_width

BLOCK_BYTES = 8 << 20
#: Text bytes per partition of the count table.
PARTITION_BYTES = 12 << 20
#: Answers of up to so many bytes are sent to every task; beyond it, they are joined by a shuffle.
BROADCAST_BYTES = 48 << 20
#: Bytes of text in a bucket of the saved blocks.
BUCKET_BYTES = 128 << 20
#: Partitions of the count table up to which a block sends its n-grams by ranges; beyond it, by rows.
MOST_PARTS = 1 << 13
#: Turns in which the ranges are counted.
TURNS = 2
ORDER = 3
FACTOR = 0.4
LEAST = 2


class BlockGrams:
    """The n-grams of a block's words: one hash per word and order, and the distinct ones in hash order."""

    def __init__(self, texts: list[str | None]):
        words, counts, grams, places = [], [], [[] for _ in range(ORDER)], [[] for _ in range(ORDER)]
        base = 0
        for _, some in bytewise.slices(pa.array(texts, pa.string())):
            own = some.words()
            counts.append(np.diff(some.word_offsets))
            for k in range(1, ORDER + 1):
                hashes, first = some.runs(own, k)
                grams[k - 1].append(bytewise.mix(hashes ^ np.uint64(k)))
                places[k - 1].append(first + (base + k - 1))
            base += len(own)
            words.append(own)
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.counts, self.n_words = join(counts, np.int64), base
        values, inverses, owns = [], [], []
        for k in range(ORDER):
            value, inverse, own = np.unique(join(grams[k], np.uint64), return_inverse=True, return_counts=True)
            grams[k] = None
            values.append(value)
            inverses.append(inverse.astype(np.int32))
            owns.append(own)
        sizes = np.cumsum([0, *map(len, values)])
        every = np.concatenate(values)
        order = np.argsort(every)
        self.distinct, self.own = every[order], np.concatenate(owns)[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        #: for each order, the entry of the n-gram that ends at each word, or -1
        self.entry = np.full((ORDER, base), -1, np.int32)
        for k in range(ORDER):
            self.entry[k, join(places[k], np.int64)] = rank[sizes[k] + inverses[k]]

    def parts(self, count: int) -> np.ndarray:
        """The first entry of each partition, and the end: partitions are ranges of the hash's top bits."""
        bounds = ((np.arange(1, count, dtype=np.uint64) << np.uint64(16)) + np.uint64(count - 1)) // np.uint64(count)
        return np.concatenate(([0], np.searchsorted(self.distinct, bounds << np.uint64(48)), [len(self.distinct)]))


def packed(ascending: np.ndarray, part: int, parts: int) -> bytes:
    """A partition's whole hashes as steps from one to the next, in as few bytes a step as will do; the first byte tells how many."""
    first = (-(-part * 65536 // parts) << 48) & (1 << 64) - 1
    steps = np.diff(ascending, prepend=np.uint64(first))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes, part: int, parts: int) -> np.ndarray:
    width = raw[0]
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, width)
    return np.uint64((-(-part * 65536 // parts) << 48) & (1 << 64) - 1) + np.cumsum(out.view("<u8").ravel(), dtype=np.uint64)


def score_words(grams: BlockGrams, totals: np.ndarray, n_corpus: int, factor: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word and the order of the n-gram that gave it."""
    n = grams.n_words
    score, order = np.zeros(n), np.zeros(n, np.int64)
    if not n:
        return score, order
    log = np.log(totals.astype(np.float64))
    todo = np.ones(n, bool)
    for k in range(ORDER - 1, 0, -1):
        # a history is the n-gram one shorter that ends one word earlier
        at = np.flatnonzero(todo & (grams.entry[k] >= 0))
        own = grams.entry[k, at]
        fit = totals[own] >= least
        at, own = at[fit], own[fit]
        score[at] += log[own] - log[grams.entry[k - 1, at - 1]]
        order[at] = k + 1
        todo[at] = False
        score[todo & (grams.entry[k] >= 0)] += np.log(factor)
    score[todo] += log[grams.entry[0, todo]] - np.log(n_corpus)
    order[todo] = 1
    return score, order


def by_parts(blocks: DataFrame, parts: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(part, block, words, totals) and the corpus's words: each block's corpus counts in the order of its n-grams.

    A partition of the count table is a range of hashes; a block's n-grams of one range travel as one row.
    The ranges are counted in turns, so that only a share of all n-grams is on the way at a time.
    """

    def turn(k: int) -> DataFrame:
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                    grams = BlockGrams(texts.as_py())
                    bounds = grams.parts(parts)
                    words = grams.n_words if k == 0 else 0  # counted once a block
                    for part in range(k, parts, TURNS):
                        own = slice(bounds[part], bounds[part + 1])
                        if own.start == own.stop and not words:
                            continue
                        counts = zlib.compress(grams.own[own].astype("<u4").tobytes(), 1)
                        values = ([part], [block], [words], [packed(grams.distinct[own], part, parts)], [counts])
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["part", "block", "words", "grams", "counts"])
                        words = 0

        requests = blocks.select("block", "texts").mapInArrow(ask, "part long, block long, words long, grams binary, counts binary")
        return scratch.save(requests.groupBy("part").applyInArrow(answer, "part long, block long, words long, totals binary"), f"answers-{k}")

    def answer(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        asked = [unpacked(b, part, parts) for b in group["grams"].to_pylist()]
        counts = [np.frombuffer(zlib.decompress(b), "<u4") for b in group["counts"].to_pylist()]
        values = np.concatenate(asked)
        _, inverse = np.unique(values, return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate(counts)).astype("<u8")[inverse] if len(values) else values
        cuts = np.cumsum([len(a) for a in asked])[:-1]
        back = [zlib.compress(t.tobytes(), 1) for t in np.split(totals, cuts)]
        return pa.table([group["part"], group["block"], group["words"], pa.array(back, pa.binary())], ["part", "block", "words", "totals"])

    answers = reduce(DataFrame.unionByName, [turn(k) for k in range(min(TURNS, parts))])
    return answers, answers.agg(F.sum("words").alias("n")).first()["n"] or 0


def by_rows(blocks: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """As ``by_parts`` with one row for each distinct n-gram of a block, joined to the table of all counts.

    Where ranges would be so many that a block has few n-grams in each, rows need no ranges.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, texts in zip(batch.column(0).to_pylist(), batch.column(1)):
                grams = BlockGrams(texts.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([None], pa.int64()), pa.array([grams.n_words], pa.int64())], ["block", "gram", "own"])
                for at in range(0, len(grams.own), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    columns = [pa.array(np.full(len(grams.own[some]), block)), pa.array(grams.distinct[some].view(np.int64)), pa.array(grams.own[some].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, ["block", "gram", "own"])

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(np.array(group["gram"], np.int64).view(np.uint64))
        totals = np.array(group["total"], np.int64)[order].astype("<u8")
        return pa.table({"part": [0], "block": [group["block"][0].as_py()], "totals": pa.array([zlib.compress(totals.tobytes(), 1)], pa.binary())})

    entries = scratch.save(blocks.select("block", "texts").mapInArrow(explode, "block long, gram long, own long"), "entries")
    n_corpus = entries.filter("gram IS NULL").agg(F.sum("own").alias("n")).first()["n"] or 0
    counts = entries.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("own").alias("total"))
    met = entries.join(counts, "gram").select("block", "gram", "total")
    return scratch.save(met.groupBy("block").applyInArrow(pack, "part long, block long, totals binary"), "answers"), n_corpus


def score(docs: DataFrame, factor: float = FACTOR, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``log_score``, ``mean_log_score`` and words scored by each order."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "backoff")
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, ids, texts, held = TaskContext.get().partitionId(), 0, [], [], 0
        id_kind = None

        def block() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made]), pa.array([held]), pa.array([ids], pa.list_(id_kind)), pa.array([texts], pa.list_(pa.string()))],
                ["block", "bytes", "ids", "texts"],
            )

        for batch in batches:
            id_kind = batch.column(0).type
            sizes = np.array(pc.binary_length(batch.column(1)))
            for key, text, n in zip(batch.column(0).to_pylist(), batch.column(1), sizes.tolist()):
                if held and held + n > BLOCK_BYTES:
                    yield block()
                    made, ids, texts, held = made + 1, [], [], 0
                ids.append(key)
                texts.append(text.as_py())
                held += n
        if ids:
            yield block()

    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = docs.mapInArrow(gather, f"block long, bytes long, ids array<{kind}>, texts array<string>")
    # so that answers come to the blocks, not both to new places
    blocks = scratch.save_bucketed(blocks, "blocks", "block", max(shuffle_width(spark), -(-size // BUCKET_BYTES)))
    parts = max(1, -(-size // PARTITION_BYTES))
    if parts <= MOST_PARTS:
        answers, n_corpus = by_parts(blocks, parts, scratch)
    else:
        answers, n_corpus = by_rows(blocks, scratch)
    small = (answers.agg(F.sum(F.octet_length("totals")).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES
    by_block = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("part", "totals"))).alias("answers"))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            id_kind = batch.column(0).type.value_type
            for ids, texts, got in zip(batch.column(0), batch.column(1), batch.column(2)):
                grams = BlockGrams(texts.as_py())
                parts_of = [np.frombuffer(zlib.decompress(r["totals"]), "<u8") for r in got.as_py() or ()]
                totals = np.concatenate(parts_of) if parts_of else np.zeros(0, np.uint64)
                logs, orders = score_words(grams, totals, n_corpus, factor, least)
                ends = np.concatenate(([0], np.cumsum(grams.counts)))
                per_text = lambda x, e=ends: np.diff(np.concatenate(([0], np.cumsum(x)))[e])
                columns = [pa.array(grams.counts.astype(np.int64)), pa.array(np.where(grams.counts > 0, per_text(logs), 0.0))]
                columns += [pa.array(per_text(orders == k).astype(np.int64)) for k in range(1, ORDER + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), id_kind), *columns], ["id", "n_words", "log_score", *names])

    names = [f"n_order{k}" for k in range(1, ORDER + 1)]
    joined = blocks.join(F.broadcast(by_block) if small else by_block, "block", "left").select("ids", "texts", "answers")
    scored = joined.mapInArrow(settle, f"id {kind}, n_words long, log_score double, " + ", ".join(f"{n} long" for n in names))
    mean = F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), "n_words", "log_score", mean.alias("mean_log_score"), *names)
