"""Embedding near-dedup with an inverted multi-index.

Two codebooks, one for each half of a vector, form a grid of cells. Every vector is filed in its cell;
neighbouring cells are packed into blocks of bounded size. A vector asks every block with a cell that
could hold a link of it: unit vectors of cosine c are sqrt(2 - 2c) apart, and each half of a vector is at
least as far from any other code's share of space as from the plane between that code and the nearest.
So no link is missed. Blocks that ask each other are compared by exact cosine in double precision and
return counts and a spanning set of links, never all pairs. Where directions are spread evenly the bound
rules out little, and the work is that of all pairs of blocks.

Equal vectors stand as one. Large cells are split into blocks.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing; vectors of different lengths are in different grids; ties go to the smaller id; an empty table
gives an empty result; only the id and the vector are read. Ids must be unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch

#: Codebooks are fitted on at most so many vectors, those whose id hashes lowest.
FIT_ROWS = 8192
#: Mean vectors of a cell that the grid is sized for.
CELL_ROWS = 128
#: Vectors of a block at most; small tables are cut into ``SPREAD`` blocks.
BLOCK = 4096
SPREAD = 16


def unit(rows: list, width: int) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so large components don't overflow."""
    x = np.array(rows, np.float64).reshape(len(rows), width)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    return unit(np.array(column.flatten(), np.float64), width) if len(column) == 0 else unit(np.array(column.flatten(), np.float64).reshape(-1, width), width)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means; deterministic, started from spread-out rows."""
    if x.shape[1] == 0 or len(x) <= 1 or k == 1:
        return x.mean(axis=0, keepdims=True) if len(x) else np.zeros((1, x.shape[1]))
    centres = np.unique(x, axis=0)
    centres = centres[np.random.default_rng(5).permutation(len(centres))[:k]]
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


class Grid:
    """The product of two codebooks for vectors of one length."""

    def __init__(self, x: np.ndarray, k: int):
        half = x.shape[1] // 2
        self.half, self.books = half, (codebook(x[:, :half], k), codebook(x[:, half:], k))
        self.shape = tuple(len(b) for b in self.books)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        parts = (x[:, : self.half], x[:, self.half :])
        return [(p * p).sum(1)[:, None] - 2 * p @ b.T + (b * b).sum(1) for p, b in zip(parts, self.books)]

    def visits(self, x: np.ndarray, count: int) -> np.ndarray:
        """Cells in multi-sequence order: by the sum of the halves' distances, nearest first.

        The cell at places (a, b) of the two sorted lists has (a + 1)(b + 1) cells no farther, so only
        places with (a + 1)(b + 1) <= count can be among the first ``count``.
        """
        count = min(count, self.shape[0] * self.shape[1])
        one, two = self.distances(x)
        o, t = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
        ab = np.array([(a, b) for a in range(min(count, self.shape[0])) for b in range(min(count // (a + 1), self.shape[1]))], np.int64)
        total = np.take_along_axis(one, o, 1)[:, ab[:, 0]] + np.take_along_axis(two, t, 1)[:, ab[:, 1]]
        order = np.argsort(total, axis=1, kind="stable")[:, :count]
        return np.take_along_axis(o, ab[:, 0][order], 1) * self.shape[1] + np.take_along_axis(t, ab[:, 1][order], 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.distances(x)
        return np.argmin(one, axis=1) * self.shape[1] + np.argmin(two, axis=1)

    def least(self, x: np.ndarray) -> list[np.ndarray]:
        """For each half, the squared distance from ``x`` that whatever is filed under a code has at least.

        It is nearer to its own code than to the one nearest to ``x``, so it is beyond the plane between
        the two. Rounding is allowed for; codes that are all but equal give no bound.
        """
        out = []
        for far, book in zip(self.distances(x), self.books):
            norms = (book * book).sum(1)
            apart = norms[:, None] - 2 * book @ book.T + norms
            near = np.argmin(far, axis=1)
            gap = (far - far[np.arange(len(x)), near][:, None]) / (2 * np.sqrt(np.maximum(apart[near], 1e-9)))
            gap[apart[near] < 1e-9] = 0
            out.append(np.maximum(gap * (1 - 1e-5) - 1e-6, 0) ** 2)
        return out

    def place(self, one: np.ndarray, two: np.ndarray, cell: int) -> int:
        """Place of a cell in the order of a query with these half distances."""
        least = one[cell // self.shape[1]] + two[cell % self.shape[1]]
        return int(np.searchsorted(np.sort(two), least - one - 1e-12, side="left").sum())


class MultiIndex:
    def __init__(self, vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.vectors = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
        self.cosine, self.id_col = cosine, id_col
        self.scratch = Scratch(vectors.sparkSession, "multiindex")

    @staticmethod
    def usable(v: Column) -> Column:
        bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        return v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)

    def fit(self, distinct: DataFrame, rows: int) -> dict[int, Grid]:
        sample = distinct.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toArrow()["v"].to_pylist()
        by_width: dict[int, list] = {}
        for v in sample:
            by_width.setdefault(len(v), []).append(v)
        k = max(1, min(1024, len(sample) // 4, 1 << max(0, round(np.log2(max(1.0, (rows / CELL_ROWS)) ** 0.5)))))
        return {w: Grid(unit(some, w), k) for w, some in by_width.items()}

    def file(self, distinct: DataFrame, grids: dict[int, Grid]) -> DataFrame:
        """Each vector with its cell; the length is part of the cell's number."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                widths = np.array(batch.column(3))
                cells = widths.astype(np.int64) << 32  # a length that the sample lacks has one cell
                for w in np.unique(widths).tolist():
                    if w in grids:
                        own = np.flatnonzero(widths == w)
                        cells[own] += grids[w].cells(matrix(batch.column(1).take(pa.array(own)), w))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells)], ["id", "v", "m", "w", "cell"])

        kind = distinct.schema["v"].dataType.simpleString()
        rows = distinct.select("id", "v", "m", F.size("v").alias("w"))
        return rows.mapInArrow(place, f"id long, v {kind}, m long, w int, cell long")

    def pack(self, filed: DataFrame, grids: dict[int, Grid], rows: int) -> DataFrame:
        """One row per block: its vectors, and ``reach``, the blocks from itself on that some of them ask."""
        size, within = max(1, min(BLOCK, rows // SPREAD)), 2 - 2 * self.cosine + 1e-9
        counts = sorted((r["cell"], r["n"]) for r in filed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a cell
        first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
        block, held, width = -1, size, None
        for k, (cell, n) in enumerate(counts):
            if held + n > size or cell >> 32 != width:
                block, held, width = block + 1, 0, cell >> 32
            first[k], parts[k] = block, n // size + 1 if n > size else 1
            block, held = block + int(parts[k]) - 1, held + n
        keys = np.array([cell for cell, _ in counts], np.int64)
        in_block = np.concatenate([np.arange(f, f + p) for f, p in zip(first, parts)]) if len(keys) else first
        in_cell = np.repeat(keys, parts)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.searchsorted(keys, np.array(batch.column(4)))
                own = first[at] + np.array(batch.column(5)) % parts[at]
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(own)], ["id", "v", "m", "w", "block"])

        def packed(table: pa.Table) -> pa.Table:
            own, w = table["block"][0].as_py(), table["w"][0].as_py()
            flat = table["v"].combine_chunks().flatten()
            x = matrix(table["v"].combine_chunks(), w)
            some = np.flatnonzero((in_cell >> 32 == w) & (in_block >= own))
            blocks, starts = np.unique(in_block[some], return_index=True)
            asks = np.ones((len(x), len(blocks)), bool)
            if w in grids:
                one, two = grids[w].least(x)
                a, b = np.divmod(in_cell[some] & 0xFFFFFFFF, grids[w].shape[1])
                step = max(1, (1 << 22) // len(some))
                for low in range(0, len(x), step):
                    near = one[low : low + step, a] + two[low : low + step, b] <= within
                    asks[low : low + step] = np.logical_or.reduceat(near, starts, axis=1)
            reach = [{"b": int(blocks[k]), "asks": np.packbits(asks[:, k]).tobytes()} for k in np.flatnonzero(asks.any(axis=0))]
            whole = [np.array(table[c], np.int64).tobytes() for c in ("id", "m")]
            kind = pa.list_(pa.struct([("b", pa.int64()), ("asks", pa.binary())]))
            return pa.table(
                [pa.array([own]), pa.array([w], pa.int32()), *(pa.array([c], pa.binary()) for c in whole), pa.array([np.array(flat).astype(form).tobytes()], pa.binary()), pa.array([reach], kind)],
                ["block", "w", "ids", "ms", "vs", "reach"],
            )

        form = self.form(filed)
        kind = filed.schema["v"].dataType.simpleString()
        rows = filed.withColumn("h", F.xxhash64("id")).select("id", "v", "m", "w", "cell", "h")
        rows = rows.mapInArrow(assign, f"id long, v {kind}, m long, w int, block long")
        return rows.groupBy("block").applyInArrow(packed, "block long, w int, ids binary, ms binary, vs binary, reach array<struct<b: long, asks: binary>>")

    @staticmethod
    def form(filed: DataFrame) -> str:
        """How packed components are written."""
        return "<f4" if filed.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"

    def compare(self, blocks: DataFrame, form: str) -> DataFrame:
        """(id, n, root): links counted for a vector in one pair of blocks, and a vector it is connected with there."""
        cosine = self.cosine
        left = blocks.select(F.col("block").alias("a"), "w", "ids", "ms", "vs", F.explode("reach").alias("r"))
        left = left.select("a", F.col("r.b").alias("b"), "w", "ids", "ms", "vs", F.col("r.asks").alias("asks"))
        pairs = blocks.select(F.col("block").alias("a"), F.explode("reach.b").alias("b"))
        right = pairs.join(blocks.select(F.col("block").alias("b"), "ids", "ms", "vs"), "b").select("a", "b", "ids", "ms", "vs")

        def read(table: pa.Table, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, ms = (np.frombuffer(table[c][0].as_py(), np.int64) for c in ("ids", "ms"))
            return ids, ms, unit(np.frombuffer(table["vs"][0].as_py(), form).reshape(-1, w), w)

        def both(asking: pa.Table, holding: pa.Table) -> pa.Table:
            out: list[list] = [[], [], []]
            w, same = asking["w"][0].as_py(), asking["a"][0].as_py() == asking["b"][0].as_py()
            (qi, qm, q), (si, sm, s) = read(asking, w), read(holding, w)
            asks = np.flatnonzero(np.unpackbits(np.frombuffer(asking["asks"][0].as_py(), np.uint8), count=len(qi)))
            qi, qm, q = qi[asks], qm[asks], q[asks]
            back = np.zeros(len(si), np.int64)
            for low in range(0, len(qi), 512):
                own = slice(low, low + 512)
                near = (q[own] @ s.T >= cosine) & (qi[own][:, None] != si[None, :])
                r, c = np.nonzero(near)
                if not len(r):
                    continue
                if not same:  # in a block's pair with itself each of the two ends asks
                    back += qm[own] @ near
                rows, columns = np.unique(r), np.unique(c)
                top, side = qi[own].copy(), si.copy()
                while True:
                    was = top[rows].sum() + side[columns].sum()
                    np.minimum.at(top, r, side[c])
                    np.minimum.at(side, c, top[r])
                    if top[rows].sum() + side[columns].sum() == was:
                        break
                out[0] += [qi[own][rows], si[columns]]
                out[1] += [(near @ sm)[rows], np.zeros(len(columns), np.int64)]
                out[2] += [top[rows], side[columns]]
            extra = np.flatnonzero(back)
            out[0].append(si[extra])
            out[1].append(back[extra])
            out[2].append(si[extra])
            return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], ["id", "n", "root"])

        return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(both, "id long, n long, root long")

    def run(self) -> DataFrame:
        """One row per vector: id, ``n_links``, ``component_id``, ``kept``."""
        scratch = self.scratch
        keyed = self.vectors.withColumn("ok", self.usable(F.col("v"))).withColumns({"one": F.xxhash64("v"), "two": F.hash("v"), "w": F.size("v")})
        same = ["one", "two", "w"]
        distinct = keyed.filter("ok").groupBy(*same).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"), F.first("v").alias("v"))
        distinct = scratch.save(distinct, "distinct")
        rows = distinct.count()
        grids = self.fit(distinct, rows)
        filed = scratch.save(self.file(distinct, grids), "filed")
        blocks = scratch.save(self.pack(filed, grids, rows), "blocks")
        found = scratch.save(self.compare(blocks, self.form(filed)), "found")
        grouped = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")), scratch, "graph")
        counts = found.groupBy("id").agg(F.sum("n").alias("n"))
        reps = distinct.select("id", "m", *same).join(counts, "id", "left").join(grouped, "id", "left")
        reps = reps.select(*same, (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "id").alias("component"), F.lit(True).alias("ok"))
        out = keyed.select("id", "ok", *same).join(reps, ["ok", *same], "left")
        component = F.coalesce("component", "id")
        return out.select(
            F.col("id").alias(self.id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept")
        )
