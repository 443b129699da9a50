"""Substring dedup by suffix automata.

Every word covered by a run of ``length`` consecutive words that also starts earlier (in a smaller id,
or earlier in the same document) is removed.

Streaming all documents past automata of all documents would be quadratic, so reference shards are cut
such that a document meets only shards that can hold a match: each run of ``length`` words is filed
under its *anchor*, the least hash among its ``GRAM``-word grams. Equal runs have equal anchors. The
consecutive runs under one anchor form a *passage* of at most ``2 length - GRAM`` words. Passages whose
anchor occurs once are unique and go no further; equal passages are settled by their hash; only passages
that share an anchor and differ are cut against each other, by the suffix automaton of the earlier ones:
a document's passage is streamed for its matching statistics, and maximal spans at or above ``length``
are removed. An anchor with very many different passages is split into its single runs, which are equal
or not by hash, so no shard grows with the corpus. ``against_reference`` is the plain form: shards
of a reference are broadcast one by one.

Defined cases: a null text has no words and becomes empty; texts below ``length`` words keep all;
repeated rows (one id twice) count as one document read in any order, so ids should be unique; an empty
table gives an empty result; other columns are carried only if named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import bytewise
from .shared import Scratch, fits, shuffle_width

GRAM = 10
#: Different passages of one anchor up to which one automaton holds them.
HOT_ANCHOR = 20_000
#: Words of reference that one broadcast automaton holds at most.
REFERENCE_WORDS = 2_000_000


class SuffixAutomaton:
    """All substrings of the word sequences added so far."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _clone(self, p: int, q: int, word: int) -> int:
        clone = len(self.size)
        self.next.append(dict(self.next[q]))
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            held = self.next[last].get(word)
            if held is not None:
                last = held if self.size[held] == self.size[last] + 1 else self._clone(last, held, word)
                continue
            new, p = len(self.size), last
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, word)
            last = new

    def matching(self, words: list[int]) -> list[int]:
        """For each word, the length of the longest held substring that ends with it."""
        out, state, have = [], 0, 0
        following, link, size = self.next, self.link, self.size
        for word in words:
            to = following[state].get(word)
            while to is None and state:
                state = link[state]
                have = size[state]
                to = following[state].get(word)
            if to is None:
                have = 0
            else:
                state, have = to, have + 1
            out.append(have)
        return out


def spans(matches: list[int], length: int) -> list[tuple[int, int]]:
    """Maximal spans covered by matches of at least ``length``."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(matches, 1):
        if n >= length:
            start = end - n
            while out and out[-1][1] >= start:
                start = min(start, out.pop()[0])
            out.append((start, end))
    return out


def passages(texts: bytewise.Texts, words: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text, anchor, first word, end word, hash) of every passage; words count from the slice's start."""
    grams, first = texts.runs(words, GRAM)
    span = length - GRAM + 1
    n = len(grams) - span + 1
    nothing = np.zeros(0, np.int64)
    if n <= 0:
        return nothing, nothing.view(np.uint64), nothing, nothing, nothing.view(np.uint64)
    owner = texts.owner(first)
    at, least = np.arange(n), grams[:n].copy()
    for j in range(1, span):
        less = grams[j : n + j] < least
        least[less] = grams[j : n + j][less]
        at[less] = np.flatnonzero(less) + j
    runs = np.flatnonzero(owner[:n] == owner[span - 1 :])
    if not len(runs):
        return nothing, nothing.view(np.uint64), nothing, nothing, nothing.view(np.uint64)
    at = at[runs]
    new = np.ones(len(runs), bool)
    new[1:] = (at[1:] != at[:-1]) | (runs[1:] != runs[:-1] + 1)
    edge = np.flatnonzero(new)
    low = first[runs[edge]]
    high = first[runs[np.append(edge[1:], len(runs)) - 1]] + length
    return owner[runs[edge]], grams[at[edge]], low, high, span_hashes(words, low, high)


def span_hashes(words: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    n = len(words) + 1
    total = np.zeros(n, np.uint64)
    np.cumsum(words * bytewise._power("up", bytewise._ODD, n)[: n - 1], out=total[1:])
    return bytewise.mix((total[high] - total[low]) * bytewise._power("down", bytewise._ODD_INVERSE, n)[low] + (high - low).astype(np.uint64))


def repeats_inside(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each passage has an equal one before it in its own text; passages are in text order."""
    keys = hashes ^ bytewise.mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def _ids(batch: pa.RecordBatch, row: int, n: int) -> np.ndarray:
    return np.array(batch.column(0).slice(row, n))


class SubstringDedup:
    """``carry`` names further columns to return, ``names`` those made here; ``spacing`` keeps the white space of texts that lose no word."""

    def __init__(
        self, docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), spacing: bool = False,
        names: tuple[str, str, str] = ("n_words", "n_removed", "kept"),
    ):
        if length < GRAM:
            raise ValueError(f"length must be {GRAM} words at least")
        own = [F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")]
        self.docs = docs.select(*own)
        self.whole = docs.select(*own, *(F.col(c).alias(f"_carry_{c}") for c in carry))
        self.length, self.id_col, self.carry, self.spacing, self.names = length, id_col, carry, spacing, names
        self.scratch = Scratch(docs.sparkSession, "substrings")

    def _joined(self, docs: DataFrame, small: DataFrame, how: str) -> DataFrame:
        return docs.join(F.broadcast(small) if fits(small) else small, "id", how)

    def all_passages(self) -> DataFrame:
        """(anchor, hash, id, low, n): each document's passages, equal ones once."""
        length = self.length

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, texts in bytewise.slices(batch.column(1)):
                    text, anchor, low, high, hashes = passages(texts, texts.words(), length)
                    keep = ~repeats_inside(text, hashes)
                    text, anchor, low, high, hashes = (x[keep] for x in (text, anchor, low, high, hashes))
                    ids = _ids(batch, row, len(texts))[text]
                    own = low - texts.word_offsets[text]
                    for at in range(0, len(ids), 1 << 16):
                        columns = (anchor.view(np.int64), hashes.view(np.int64), ids, own, (high - low).astype(np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], ["anchor", "hash", "id", "low", "n"])

        return self.docs.mapInArrow(bytewise.tidied(find), "anchor long, hash long, id long, low long, n int")

    def repeated_anchors(self) -> DataFrame:
        """Anchors that occur twice or more, in one document or several; counted over all documents."""
        length = self.length

        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in bytewise.slices(batch.column(1)):
                    text, anchor, _, _, hashes = passages(texts, texts.words(), length)
                    values, counts = np.unique(anchor[~repeats_inside(text, hashes)], return_counts=True)
                    for at in range(0, len(values), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)[at : at + (1 << 16)]), pa.array(counts[at : at + (1 << 16)])], ["anchor", "n"])

        counted = self.docs.mapInArrow(bytewise.tidied(find), "anchor long, n long")
        return counted.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")

    def cut_shards(self, first: DataFrame) -> DataFrame:
        """Spans (id, low, high) of first passages that earlier, different passages of their anchor hold."""
        scratch, length = self.scratch, self.length
        several = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
        wanted = first.join(several, "anchor").select("id", F.struct("anchor", "low", "n", (F.col("m") > HOT_ANCHOR).alias("hot")).alias("r"))
        routes = scratch.save(wanted.groupBy("id").agg(F.collect_list("r").alias("routes")), "routes")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            for batch in batches:
                for row, texts in bytewise.slices(batch.column(1)):
                    words, out = texts.words(), []
                    for i, (key, to) in enumerate(zip(batch.column(0).slice(row, len(texts)).to_pylist(), batch.column(2).slice(row, len(texts)).to_pylist())):
                        base = int(texts.word_offsets[i])
                        for r in to:
                            low = base + r["low"]
                            if r["hot"]:
                                at = np.arange(low, low + r["n"] - length + 1)
                                keys = span_hashes(words[low : low + r["n"]], at - low, at - low + length).view(np.int64).tolist()
                                out += [(k, key, r["low"] + j, None) for j, k in enumerate(keys)]
                            else:
                                out.append((r["anchor"], key, r["low"], words[low : low + r["n"]].tobytes()))
                    for at in range(0, len(out), 4096):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 4096]), kinds)], ["anchor", "id", "low", "words"])

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, automaton = None, SuffixAutomaton()
            for batch in batches:
                out = []
                for anchor, key, low, raw in zip(*(c.to_pylist() for c in batch.columns)):
                    if anchor != now:
                        now, automaton = anchor, SuffixAutomaton()
                    words = np.frombuffer(raw, np.uint64).tolist()
                    out += [(key, low + a, low + b) for a, b in spans(automaton.matching(words), length)]
                    automaton.add(words)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "low", "high"])

        sent = self._joined(self.docs, routes, "inner").select("id", "text", "routes").mapInArrow(bytewise.tidied(send), "anchor long, id long, low long, words binary")
        sent = scratch.save(sent, "shards")
        filed = sent.filter("words IS NOT NULL").repartition(shuffle_width(sent.sparkSession), "anchor").sortWithinPartitions("anchor", "id", "low")
        cut = filed.mapInArrow(bytewise.tidied(stream), "id long, low long, high long")
        single = sent.filter("words IS NULL").select("anchor", "id", "low")
        earliest = single.groupBy("anchor").agg(F.min(F.struct("id", "low")).alias("f"))
        later = single.join(earliest, "anchor").filter(F.struct("id", "low") != F.col("f")).select("id", "low", (F.col("low") + length).alias("high"))
        return cut.unionByName(later)

    def removed_spans(self) -> DataFrame:
        """(id, spans): disjoint word spans to remove, without what only repeats inside one document."""
        scratch = self.scratch
        anchors = scratch.save(self.repeated_anchors(), "anchors")
        few = fits(anchors)
        filed = scratch.save(self.all_passages().join(F.broadcast(anchors) if few else anchors, "anchor", "left_semi"), "passages")
        first = filed.groupBy("anchor", "hash").agg(F.min(F.struct("id", "low", "n")).alias("f")).select("anchor", "hash", "f.*")
        first = scratch.save(first, "first")
        # (id, low) of an equal passage's first place; every other place goes whole
        place = first.select("anchor", "hash", F.struct("id", "low").alias("f"))
        equal = filed.join(place, ["anchor", "hash"]).filter(F.struct("id", "low") != F.col("f")).select("id", "low", (F.col("low") + F.col("n")).alias("high"))
        found = equal.unionByName(self.cut_shards(first.select("anchor", "id", "low", "n")))
        merged = joined_spans(found)
        return scratch.save(merged.groupBy("id").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")

    def run(self) -> DataFrame:
        """One row per document: id, ``n_words``, ``n_removed``, ``kept`` (the kept words joined by one blank) and what is carried."""
        removed = self.removed_spans()
        length, spacing = self.length, self.spacing

        def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, texts in bytewise.slices(batch.column(1)):
                    text, _, low, high, hashes = passages(texts, texts.words(), length)
                    again = repeats_inside(text, hashes)
                    edge = np.zeros(len(texts.starts) + 1, np.int64)
                    np.add.at(edge, low[again], 1)
                    np.add.at(edge, high[again], -1)
                    for base, some in zip(texts.word_offsets.tolist(), batch.column(2).slice(row, len(texts)).to_pylist()):
                        for r in some or ():
                            edge[base + r["low"]] += 1
                            edge[base + r["high"]] -= 1
                    keep = np.cumsum(edge)[:-1] == 0
                    counts = np.diff(texts.word_offsets)
                    left = np.diff(np.concatenate(([0], np.cumsum(keep)))[texts.word_offsets])
                    kept, offsets = keep_words(texts, keep, (counts == left) & spacing)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(row, len(texts)), pa.array(counts.astype(np.int64)), pa.array((counts - left).astype(np.int64)),
                            pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(kept)),
                            *(c.slice(row, len(texts)) for c in batch.columns[3:]),
                        ],
                        ["id", "n_words", "n_removed", "kept", *batch.schema.names[3:]],
                    )

        carried = [f"_carry_{c}" for c in self.carry]
        joined = self._joined(self.whole, removed, "left").select("id", "text", "spans", *carried)
        schema = T.StructType.fromDDL("id long, n_words long, n_removed long, kept string")
        for c in carried:
            schema.add(joined.schema[c])
        stripped = joined.mapInArrow(bytewise.tidied(strip), schema)
        own = zip(("id", "n_words", "n_removed", "kept"), (self.id_col, *self.names))
        return stripped.select(*(F.col(a).alias(b) for a, b in own), *(F.col(a).alias(b) for a, b in zip(carried, self.carry)))


def keep_words(texts: bytewise.Texts, keep: np.ndarray, as_is: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts with only the kept words, joined by one blank; or texts as they are."""
    untouched = np.repeat(as_is, np.diff(texts.offsets))
    data = np.where(texts.inside | untouched, texts.data, np.uint8(0x20))
    edge = np.zeros(len(data) + 1, np.int8)
    edge[texts.starts[keep]] += 1
    edge[texts.ends[keep]] -= 1
    mask = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    word = np.flatnonzero(keep)
    owner = texts.owner(word)
    follows = np.zeros(len(word), bool)
    follows[1:] = owner[1:] == owner[:-1]
    mask[texts.starts[word[follows]] - 1] = True
    mask |= untouched
    return data[mask], np.concatenate(([0], np.cumsum(mask)))[texts.offsets]


def reference_shards(reference: list[str], length: int) -> Iterator[SuffixAutomaton]:
    """Automata of ``REFERENCE_WORDS`` words at most; longer texts go in parts that share ``length - 1`` words."""
    automaton, held = SuffixAutomaton(), 0
    for _, texts in bytewise.slices(pa.array(reference, pa.string())):
        words = texts.words().tolist()
        for low, high in zip(texts.word_offsets[:-1].tolist(), texts.word_offsets[1:].tolist()):
            while high - low >= length:
                part = min(high - low, REFERENCE_WORDS)
                if held and held + part > REFERENCE_WORDS:
                    yield automaton
                    automaton, held = SuffixAutomaton(), 0
                automaton.add(words[low : low + part])
                held += part
                low = low + part if low + part == high else low + part - (length - 1)
    if held:
        yield automaton


def against_reference(docs: DataFrame, reference: list[str], length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, low, high): maximal word spans of ``length`` or more that a reference also holds.

    The reference's automata are broadcast shard by shard; documents are streamed past each for their
    matching statistics, and the spans that shards find are joined.
    """
    context, found = docs.sparkSession.sparkContext, None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    for automaton in reference_shards(reference, length):
        shard = rows.mapInArrow(_streamed(context.broadcast(automaton), length), "id long, low long, high long")
        found = shard if found is None else found.unionByName(shard)
    if found is None:
        found = rows.select("id", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high")).limit(0)
    return joined_spans(found).withColumnRenamed("id", id_col)


def _streamed(sent: Broadcast, length: int):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row, texts in bytewise.slices(batch.column(1)):
                words = texts.words().tolist()
                for key, low, high in zip(batch.column(0).slice(row, len(texts)).to_pylist(), texts.word_offsets[:-1], texts.word_offsets[1:]):
                    out += [(key, a, b) for a, b in spans(sent.value.matching(words[low:high]), length)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["id", "low", "high"])

    return stream


def joined_spans(found: DataFrame) -> DataFrame:
    """Spans (id, low, high) that overlap or meet, as one."""
    by_start = Window.partitionBy("id").orderBy("low", "high")
    reach = F.max("high").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    island = found.withColumn("_new", F.when(reach >= F.col("low"), 0).otherwise(1)).withColumn("_k", F.sum("_new").over(by_start))
    return island.groupBy("id", "_k").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("_k")
