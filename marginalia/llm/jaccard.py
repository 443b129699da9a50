"""N-gram Jaccard join by T-occurrence search.

Every shingle has an inverted list: the sets that hold it. Lists are ordered from short to long by counts
of all shingles of all documents (a table of fixed size, counted in the first scan). Two sets that reach
the required overlap share one of the shortest lists of each, so only those are merged across the cluster:
one shuffle on the shingle. What a list brings together is then settled by ``divide_skip``: a heap merges
the short lists of the sets that meet, long ones are probed by binary search, and the sets that reach the
required overlap stay.

A list is kept apart by classes of set sizes; a set is filed in each class that holds a size it could link
to, none larger than its own, so two sets that link meet in the class of the smaller, and sets of unlike
sizes never do. Equal shingle sets stand as one. Lists of very frequent shingles are cut into pieces before the shuffle.
A list is never expanded into all its pairs: in rounds, each list tests one centre (first the set that
shares the largest part of its short lists, then others by hash) against its sets of other components;
those linked to it join its component, and by the triangle inequality of the Jaccard distance a set
further than twice the limit from the first centre cannot link to one within the limit. After the rounds,
only pairs still in different components are tested. Pairs whose parity maps differ in more bits than
linked sets may differ in shingles are never looked at; large sets have a longer map besides, as one of
fixed length tells them apart no more. Those tests lose nothing.

Defined cases: a null or empty text has the empty set and links with nothing; fewer words than a shingle
make one shingle; texts of any length are read whole; repeated rows are equal sets and get one row each;
rows that share an id are each judged by their own text; equal sizes and shares go by id; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import merge
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytewise
from .graph import components
from .shared import Scratch, fits

#: Rounds of centres at most; they stop sooner once few pairs are left for the last step.
CENTRE_ROUNDS = 6
FEW_PAIRS = 100_000
#: A round that leaves more than this share of the pairs has met lists of unlike sets, which centres don't join.
SLOW_ROUND = 0.7
#: Bits of a set's parity map: bit b tells whether an odd number of its shingles hash to b.
PARITY_BITS = 1024
MAP = [f"b{i}" for i in range(PARITY_BITS // 64)]
#: A size class spans so many times, in logarithms, what the sizes of two linked sets may differ by.
CLASS_SPAN = 4
_CLASS = np.uint64(0xD1B54A32D192ED03)  # times a class's number, tells its lists from others of the shingle
#: Long maps are sent to every task up to so many bytes; there are few pairs to shuffle to them otherwise.
WIDE_BYTES = 8 << 20
#: Shingles that one group of a centre may hold; larger groups are split and the centre is repeated.
GROUP_SHINGLES = 1 << 16
#: The table of counts: buckets by the shingle's top bits, sent to the driver and back in blocks.
COUNT_BITS, BLOCK_BITS = 22, 16
#: Tasks that add up the counts of all others, some blocks each.
COUNT_TASKS = 8
#: Rows of a list, besides four times the mean of a bucket, beyond which it is cut into pieces.
LIST_ROWS = 256
#: Sets that a task remembers, so that it lists equal ones once.
SEEN = 1 << 20
_PIECE = 0x9E3779B97F4B  # times a piece's number, below 2**63, flips bits of the shingle


def shingle_sets(texts: bytewise.Texts, k: int, lower: bool) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = texts.words(lower)
    runs, first = texts.runs(words, k)
    bounds = np.searchsorted(first, texts.word_offsets)
    counts = np.diff(texts.word_offsets)
    out = []
    for i, n in enumerate(counts.tolist()):
        if n >= k:
            own = np.sort(runs[bounds[i] : bounds[i + 1]])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif n:
            at = texts.word_offsets[i]
            h = np.full(1, n, np.uint64)
            for w in words[at : at + n]:
                h = bytewise.mix(h + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    return tuple(int(bytewise.mix(s).sum(dtype=np.uint64).view(np.int64)) for s in (shingles, ~shingles))


def count_blocks(names: list[str], blocks: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows (.., block, counts) of the blocks named, in as few bytes a count as will do; other columns null."""
    raw = []
    for b in blocks.tolist():
        own = counts[b << BLOCK_BITS :][: 1 << BLOCK_BITS]
        raw.append(own.astype(np.min_scalar_type(own.max())).tobytes())
    empty = [pa.nulls(len(blocks), pa.list_(pa.int64()) if name == "wide" else pa.int64()) for name in names[:-2]]
    return pa.RecordBatch.from_arrays([*empty, pa.array(blocks, pa.int32()), pa.array(raw, pa.binary())], names)


def read_counts(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) >> BLOCK_BITS}")


def parity_map(shingles: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(bool)).view(np.int64)


def divide_skip(query: np.ndarray, sets: list[np.ndarray], required: np.ndarray) -> np.ndarray:
    """Overlap of ``query`` with each set that reaches its required overlap, else -1.

    The sets' postings form one inverted list per query shingle. The longest lists are set aside and a
    heap merges the others; a set is a candidate if the lists set aside could still lift it to its bound,
    and is then looked up in each of them by binary search.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    member = np.repeat(np.arange(len(sets)), sizes)
    tokens = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    at = np.minimum(np.searchsorted(query, tokens), len(query) - 1)
    held = query[at] == tokens
    at, member = at[held], member[held]
    order = np.argsort(at, kind="stable")  # members ascend in each list
    ends = np.searchsorted(at[order], np.arange(len(query) + 1))
    lengths = np.diff(ends)
    least = max(1, int(required.min()))
    # the published rule for how many lists to probe; its factor 0.01 is the usual setting
    n_long = min(least - 1, int(least / (0.01 * np.log2(max(2, lengths.max())) + 1)))
    by_length = np.argsort(lengths, kind="stable")
    lists = member[order]
    short = [lists[ends[k] : ends[k + 1]].tolist() for k in by_length[: len(query) - n_long] if lengths[k]]
    bound = np.maximum(required - n_long, 1).tolist()
    out = np.full(len(sets), -1, np.int64)
    long = [lists[ends[k] : ends[k + 1]] for k in by_length[len(query) - n_long :] if lengths[k]]
    candidates, counts = [], []
    for k, same in groupby(merge(*short)):
        n = sum(1 for _ in same)
        if n >= bound[k]:
            candidates.append(k)
            counts.append(n)
    if candidates:
        asked, total = np.array(candidates), np.array(counts)
        for one in long:
            place = np.minimum(np.searchsorted(one, asked), len(one) - 1)
            total += one[place] == asked
        reached = total >= required[asked]
        out[asked[reached]] = total[reached]
    return out


class Bounds:
    """What a Jaccard similarity of ``percent`` / 100 says of two sets' sizes and shared shingles."""

    def __init__(self, percent: int):
        self.percent = percent

    def overlap(self, both: object, percent: int) -> object:
        """Least overlap of two sets with ``both`` shingles together: p (x + y) / (100 + p), rounded up."""
        return -(-percent * both // (100 + percent))

    def prefix(self, n: int) -> int:
        """Shortest lists of a set of n of which any partner shares one."""
        return n - -(-self.percent * n // 100) + 1

    def classes(self, n: int) -> range:
        """Size classes in which a set of n is filed: of its own size and of all less that a partner may have."""
        step = CLASS_SPAN * np.log(100 / min(self.percent, 99))
        return range(int(np.log(-(-self.percent * n // 100)) / step), int(np.log(n) / step) + 1)

    def wide_bits(self, n: int) -> int:
        """Bits of a large set's own map: four times or more what it and a near one may differ by; 0 for a small set."""
        near = max(1, 2 * self.percent - 100)
        bits = 1 << (8 * n * (100 - near) // (100 + near)).bit_length()
        return bits if bits > PARITY_BITS else 0


class ShingleCounts:
    """How often the shingles of each bucket were counted, as logarithms: the order of the lists."""

    def __init__(self, counts: np.ndarray):
        blocks = np.array_split(counts, 64)  # the driver needs room for little more than the result
        self.levels = np.concatenate([np.round(np.log2(1.0 + x) * 1000).astype(np.uint16) for x in blocks])
        self.most = 4 * float(counts.mean()) + LIST_ROWS

    def of(self, shingles: np.ndarray) -> np.ndarray:
        return self.levels[(shingles >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]

    def shortest(self, shingles: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` shingles that come first by count and hash; ties at the end are all in."""
        key = (self.of(shingles).astype(np.uint64) << np.uint64(48)) | (shingles >> np.uint64(16))
        return shingles if n >= len(key) else shingles[key <= np.partition(key, n - 1)[n - 1]]

    def pieces(self, shingles: np.ndarray) -> np.ndarray:
        """Pieces that each shingle's list is cut into."""
        return np.minimum(np.ceil((np.exp2(self.of(shingles) / 1000.0) - 1) / self.most), 32767).astype(np.int64)


class JaccardJoin:
    """Links between texts whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more."""

    def __init__(self, docs: DataFrame, k: int = 5, percent: int = 80, lower: bool = True, id_col: str = "doc_id", text_col: str = "text"):
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        self.k, self.bounds, self.percent, self.lower, self.id_col = k, Bounds(percent), percent, lower, id_col
        self.scratch = Scratch(docs.sparkSession, "jaccard")

    def summaries(self) -> DataFrame:
        """Per document: size, signature and parity map of its set; then the task's shingle counts, in blocks."""
        k, lower, wide_bits = self.k, self.lower, self.bounds.wide_bits
        names = ["id", "n", "one", "two", *MAP, "wide", "block", "counts"]

        def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(1 << COUNT_BITS, np.uint32)
            for batch in batches:
                for row, texts in bytewise.slices(batch.column(1)):
                    sets = shingle_sets(texts, k, lower)
                    if sets:
                        np.add.at(counts, (np.concatenate(sets) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
                    one, two = zip(*map(signature, sets))
                    maps = np.stack([parity_map(s) for s in sets])
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(row, len(texts)), pa.array([len(s) for s in sets], pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                            *(pa.array(np.ascontiguousarray(column)) for column in maps.T),
                            pa.array([parity_map(s, b) if (b := wide_bits(len(s))) else None for s in sets], pa.list_(pa.int64())), pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()),
                        ],
                        names,
                    )
            blocks = np.flatnonzero(counts.reshape(-1, 1 << BLOCK_BITS).any(axis=1))
            if len(blocks):
                yield count_blocks(names, blocks, counts)

        return self.docs.mapInArrow(bytewise.tidied(summarise), ", ".join(f"{name} long" for name in names[:-3]) + ", wide array<long>, block int, counts binary")

    def counts(self, summary: DataFrame) -> ShingleCounts:
        """The counts of all tasks, summed in steps; the driver receives the table's fixed size."""
        names = ["block", "counts"]

        def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 << COUNT_BITS, np.uint64)
            by_block = total.reshape(-1, 1 << BLOCK_BITS)
            for batch in batches:
                for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    by_block[block] += read_counts(raw)
            blocks = np.flatnonzero(by_block.any(axis=1))
            if len(blocks):
                yield count_blocks(names, blocks, total)

        made = summary.filter("block IS NOT NULL").select(*names)
        made = made.mapInArrow(scanned, "block int, counts binary")
        # tasks of the last step hold some blocks each, of all partial sums
        made = made.repartition(COUNT_TASKS, "block").mapInArrow(scanned, "block int, counts binary")
        total = np.zeros(1 << COUNT_BITS, np.uint64)
        for batch in made.toArrow().to_batches():
            for block, raw in zip(*(batch.column(c) for c in names)):
                total[block.as_py() << BLOCK_BITS :][: 1 << BLOCK_BITS] = read_counts(raw.as_py())
        order = ShingleCounts(total)
        del made, total
        bytewise.give_back()
        return order

    def short_lists(self, order: ShingleCounts) -> DataFrame:
        """(key, one, piece, pieces): the short lists of every set that other sets are in too; key tells shingle and piece."""
        k, lower, prefix, classes = self.k, self.lower, self.bounds.prefix, self.bounds.classes
        sent = self.docs.sparkSession.sparkContext.broadcast(order)  # two bytes a bucket

        def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            order, seen = sent.value, set()
            for batch in batches:
                for _, texts in bytewise.slices(batch.column(0)):
                    lists, ones, kinds = [], [], []
                    for s in shingle_sets(texts, k, lower):
                        if len(s) and (own := signature(s)) not in seen:
                            if len(seen) < SEEN:
                                seen.add(own)
                            short = order.shortest(s, prefix(len(s)))
                            for kind in classes(len(s)):
                                lists.append(short)
                                ones.append(own[0])
                                kinds.append(kind)
                    if not lists:
                        continue
                    lengths = [len(x) for x in lists]
                    one = np.repeat(np.array(ones, np.int64), lengths)
                    token = np.concatenate(lists)
                    pieces = order.pieces(token)
                    token = bytewise.mix(token ^ (np.repeat(np.array(kinds, np.uint64), lengths) * _CLASS))
                    piece = np.where(pieces > 1, one % np.maximum(pieces, 1), 0)
                    key = token.view(np.int64) ^ (piece * _PIECE)
                    cut = np.where(pieces > 1, (pieces << 16) + piece, 0).astype(np.int32)
                    for at in range(0, len(key), 1 << 16):
                        yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in (key, one, cut)], ["key", "one", "cut"])

        posted = self.docs.select("text").mapInArrow(bytewise.tidied(post), "key long, one long, cut int")
        by_key = Window.partitionBy("key")
        met = posted.withColumns({"_a": F.min("one").over(by_key), "_b": F.max("one").over(by_key)}).filter("_a <> _b OR cut <> 0")
        return met.select("key", "one", "cut").distinct()

    def filed(self, distinct: DataFrame, order: ShingleCounts) -> DataFrame:
        """(token, piece, pieces, id, n, own): short lists by document; own tells how little of a set's lists is shared."""
        scratch = self.scratch
        met = scratch.save(self.short_lists(order), "met")
        met = met.withColumns({"piece": F.expr("cut & 65535"), "pieces": F.greatest(F.lit(1), F.expr("cut >> 16"))})
        met = met.withColumn("token", F.col("key").bitwiseXOR(F.col("piece").cast("long") * F.lit(_PIECE))).select("token", "piece", "pieces", "one")
        shares = met.groupBy("one").agg(F.count(F.lit(1)).alias("_m"))
        sets = scratch.save(distinct.select("one", "id", "n").join(shares, "one"), "sets")
        wanted = -(F.col("_m") / (F.col("n") + 1))
        sets = sets.select("one", "id", "n", wanted.alias("own"))
        lists = met.join(F.broadcast(sets) if fits(sets) else sets, "one").drop("one")
        return lists

    def measure(self, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(c, id, linked) for the pairs (c, id, n) whose similarity reaches ``2 p - 100`` percent; the pairs.

        Pairs are grouped by centre; a large group is split and its centre repeated for each part.
        """
        k, lower, percent = self.k, self.lower, self.percent
        near = max(1, 2 * percent - 100)
        overlap = self.bounds.overlap
        pairs = self.scratch.save(pairs, f"{name}-pairs")
        parts = pairs.groupBy("c").agg((F.expr(f"sum(n) div {GROUP_SHINGLES}") + 1).alias("parts"))
        members = pairs.join(parts, "c").select("id", F.struct("c", F.expr("pmod(xxhash64(id), parts)").alias("part"), F.lit(False).alias("centre")).alias("r"))
        centres = parts.select(F.col("c").alias("id"), F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
        centres = centres.select("id", F.struct(F.col("id").alias("c"), "part", F.lit(True).alias("centre")).alias("r"))
        routes = members.unionByName(centres).groupBy("id").agg(F.collect_list("r").alias("routes"))
        routes = self.scratch.save(routes.join(self.signatures, "id"), f"{name}-routes")
        routed = self.docs.join(F.broadcast(routes) if fits(routes) else routes, "id")

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, texts in bytewise.slices(batch.column(1), 1 << 19):
                    sets = shingle_sets(texts, k, lower)
                    columns = [batch.column(c).slice(row, len(sets)).to_pylist() for c in (0, 2, 3)]
                    # a row of the same id with another text is no such set
                    rows = [(r["c"], r["part"], r["centre"], key, s.tobytes()) for s, key, to, one in zip(sets, *columns) if len(s) and signature(s)[0] == one for r in to]
                    for at in range(0, len(rows), 256):
                        columns = list(zip(*rows[at : at + 256]))
                        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["c", "part", "centre", "id", "set"])

        def count(group: pa.Table) -> pa.Table:
            centre = np.array(group["centre"])
            sets = [np.frombuffer(b, np.uint64) for b in group["set"].to_pylist()]
            query = sets[int(np.flatnonzero(centre)[0])]
            others = np.flatnonzero(~centre)
            if not len(others):  # a part of a large group may get no member
                return pa.table({"c": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "linked": pa.array([], pa.bool_())})
            both = np.array([len(sets[i]) for i in others]) + len(query)
            found = divide_skip(query, [sets[i] for i in others], overlap(both, near))
            hit = found >= 0
            ids = np.array(group["id"])[others[hit]]
            linked = found[hit] >= overlap(both[hit], percent)
            return pa.table({"c": pa.array(np.repeat(np.array(group["c"])[:1], len(ids))), "id": pa.array(ids), "linked": pa.array(linked)})

        sent = routed.select("id", "text", "routes", "one").mapInArrow(bytewise.tidied(send), "c long, part long, centre boolean, id long, set binary")
        found = self.scratch.save(sent.groupBy("c", "part").applyInArrow(count, "c long, id long, linked boolean"), name)
        self.scratch.drop(f"{name}-routes")
        return found, pairs

    def alike(self, percent: int) -> Column:
        """Whether the sizes and parity maps of (n, b0..) and (cn, cb0..) allow a similarity of ``percent``."""
        sizes = F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent
        differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"c{b}"))) for b in MAP), F.lit(0))
        both = F.col("n") + F.col("cn")
        return sizes & (differ <= both - 2 * F.ceil(percent * both / (100 + percent)))

    def mapped(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """``rows`` with the parity map of a set, its columns named after ``key`` if that is the centre."""
        maps = self.maps.select(F.col("id").alias(key), *(F.col(b).alias(b if key == "id" else f"c{b}") for b in MAP))
        return rows.join(F.broadcast(maps) if fits(self.maps) else maps, key)

    def possible(self, pairs: DataFrame, percent: int) -> DataFrame:
        """Of pairs (c, cn, id, n), those that may reach ``percent``."""
        pairs = pairs.filter(F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent).distinct()
        return self.wide_alike(self.mapped(self.mapped(pairs), "c").filter(self.alike(percent)).select("c", "cn", "id", "n"), percent)

    def wide_alike(self, pairs: DataFrame, percent: int) -> DataFrame:
        """(c, id, n) of the pairs (c, cn, id, n) whose long maps, the longer one folded, allow ``percent``, or that have none."""
        for key, name in (("id", "_w"), ("c", "_cw")):
            maps = self.wide.select(F.col("id").alias(key), F.col("wide").alias(name))
            pairs = pairs.join(F.broadcast(maps) if self.wide_fits else maps, key, "left")
        words = "least(size(_w), size(_cw))"
        a, b = (f"if(size({w}) > {words}, zip_with(slice({w}, 1, {words}), slice({w}, {words} + 1, {words}), (x, y) -> x ^ y), {w})" for w in ("_w", "_cw"))
        differ = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (x, y) -> x + y)")
        both = F.col("n") + F.col("cn")
        unknown = F.expr(f"_w IS NULL OR _cw IS NULL OR greatest(size(_w), size(_cw)) > 2 * {words}")
        return pairs.filter(F.when(unknown, True).otherwise(differ <= both - 2 * F.ceil(percent * both / (100 + percent)))).select("c", "id", "n")

    @staticmethod
    def against(lists: DataFrame, centre: DataFrame) -> DataFrame:
        """Lists with their centre; a list in pieces meets it in each, so no piece is one key with another."""
        spread = centre.withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)"))).drop("pieces")
        return lists.join(spread, ["token", "piece"])

    def run(self) -> DataFrame:
        """One row per document: id, ``n_shingles``, ``component_id`` (the least id linked to it)."""
        scratch = self.scratch
        scanned = scratch.save(self.summaries(), "summary")
        order = self.counts(scanned)
        summary = scanned.filter("block IS NULL").select("id", "n", "one", "two")
        same = ["n", "one", "two"]
        distinct = scanned.filter("n > 0").groupBy(*same).agg(F.min("id").alias("id"), *(F.first(b).alias(b) for b in [*MAP, "wide"]))
        distinct = scratch.save(distinct, "distinct")
        lists = scratch.save(self.filed(distinct, order), "lists")
        met = lists.select("id").distinct()
        self.maps = scratch.save(distinct.select("id", "one", *MAP).join(met, "id", "left_semi"), "maps")
        self.wide = scratch.save(distinct.filter("wide IS NOT NULL").select("id", "wide").join(met, "id", "left_semi"), "wide")
        self.wide_fits = (self.wide.agg(F.sum(F.size("wide") * 8 + 40)).first()[0] or 0) <= WIDE_BYTES
        self.signatures = self.maps.select("id", "one")
        lists = lists.withColumns({"label": F.col("id"), "used": F.lit(0), "state": F.lit(1)})
        near_percent = max(1, 2 * self.percent - 100)
        links, tested, before = None, None, float("inf")
        for k in range(CENTRE_ROUNDS):
            first = F.col("own") if k == 0 else F.xxhash64("token", "id")
            choice = F.struct(F.col("used"), first.alias("first"), F.col("id"), F.col("n"), F.col("label"))
            centre = lists.groupBy("token").agg(F.min(choice).alias("x"), F.min("label").alias("_a"), F.max("label").alias("_b"), F.max("pieces").alias("pieces")).filter("_a <> _b")
            centre = scratch.save(centre.select("token", "pieces", F.col("x.id").alias("c"), F.col("x.n").alias("cn"), F.col("x.label").alias("cl")), f"centres-{k}")
            pairs = self.against(lists, centre).filter(F.col("label") != F.col("cl")).select("c", "cn", "id", "n")
            pairs = self.possible(pairs, near_percent)
            if tested is not None:
                pairs = pairs.join(tested, ["c", "id"], "left_anti")
            found, done = self.measure(pairs, f"round-{k}")
            done = done.select("c", "id")
            done = done.unionByName(done.select(F.col("id").alias("c"), F.col("c").alias("id")))
            tested = done if tested is None else tested.unionByName(done)
            new = found.filter("linked").select(F.col("c").alias("u"), F.col("id").alias("v"))
            links = new if links is None else links.unionByName(new)
            grouped = scratch.save(components(links, scratch, f"graph-{k}"), f"labels-{k}")
            small = fits(grouped)
            if k == 0:
                # (centre, id): near or linked; what is not here is far from the list's centre
                near = found.select("c", "id", "linked")
                lists = self.against(lists, centre.select("token", "pieces", "c")).join(F.broadcast(near) if fits(near) else near, ["c", "id"], "left")
                state = F.when((F.col("id") == F.col("c")) | F.col("linked"), 0).when(F.col("linked").isNotNull(), 1).otherwise(2)
                lists = lists.withColumn("state", state).drop("c", "linked")
            else:
                lists = self.against(lists, centre.select("token", "pieces"))
            lists = lists.join(F.broadcast(grouped) if small else grouped, "id", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
            centres = centre.select(F.col("c").alias("id")).distinct().withColumn("_used", F.lit(1))
            lists = lists.join(F.broadcast(centres) if fits(centre) else centres, "id", "left").withColumn("used", F.greatest("used", F.coalesce("_used", F.lit(0)))).drop("_used")
            lists = scratch.save(lists, f"lists-{k}")
            scratch.drop(f"lists-{k - 1}" if k else "lists", f"centres-{k}", f"labels-{k - 1}" if k else "met")
            # lists whose sets are all one component are done
            by_label = lists.groupBy("token", "label").agg(F.count(F.lit(1)).alias("m"), F.max("pieces").alias("pieces")).groupBy("token")
            several = by_label.agg((F.pow(F.sum("m"), F.lit(2.0)) - F.sum(F.pow("m", F.lit(2.0)))).alias("x"), F.max("pieces").alias("pieces"), F.count(F.lit(1)).alias("_l")).filter("_l > 1")
            several = scratch.save(several.drop("_l"), f"several-{k}")
            crossing = several.agg(F.sum("x").alias("x")).first()["x"] or 0
            lists = self.against(lists, several.drop("x"))
            if crossing <= 2 * FEW_PAIRS or crossing > SLOW_ROUND * before:
                break
            before = crossing
        # a list in pieces meets itself piece by piece
        pieces = F.explode(F.expr("sequence(0, pieces - 1)"))
        lists = self.mapped(lists)
        other = lists.select("token", F.col("id").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl"), F.col("state").alias("cs"), *(F.col(b).alias(f"c{b}") for b in MAP), pieces.alias("piece"))
        apart = (F.col("label") != F.col("cl")) & (F.col("c") < F.col("id")) & (F.abs(F.col("state") - F.col("cs")) < 2)
        pairs = lists.join(other, ["token", "piece"]).filter(apart & self.alike(self.percent)).select("c", "cn", "id", "n").distinct().join(tested, ["c", "id"], "left_anti")
        pairs = self.wide_alike(pairs, self.percent)
        found, _ = self.measure(pairs, "rest")
        links = links.unionByName(found.filter("linked").select(F.col("c").alias("u"), F.col("id").alias("v")))
        grouped = scratch.save(components(links, scratch, "graph-rest").withColumnRenamed("id", "rep"), "grouped")
        # every row's set, by its signature; then the set's component
        reps = distinct.select(*same, F.col("id").alias("rep")).join(F.broadcast(grouped) if fits(grouped) else grouped, "rep", "left")
        reps = reps.select(*same, F.coalesce("component", "rep").alias("component"))
        out = summary.select("id", *same).join(reps, same, "left")
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
