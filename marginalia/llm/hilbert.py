"""Sharding along a Hilbert curve.

Each metadata column is cut into 2**bits steps of equal depth (exact counts for text, percentiles over
all rows for numbers), the steps are joined into one Hilbert index, rows are range-sorted by it, and
the order is cut into runs. Neighbours on the curve are near in every dimension, so each shard spans a
small box and readers can skip shards by several columns at once (``manifest``).

Defined cases: nulls take the lowest step of their dimension and a null text has size 0 + 16; ties on
the curve go by text hash and id; repeated rows take neighbouring places; an empty table gives an empty
plan; columns other than the id, the text and the dimensions are not read. A dimension that has an
output's name is returned as ``dim_`` and its name.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, fresh, slice_offsets, sorted_slices

ROW_BYTES = 16
BITS = 5
OUTPUTS = ("size", "text_crc32", "curve", "shard", "slot")


def hilbert_index(steps: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with integer coordinates below 2**bits, one row per dimension."""
    x = steps.astype(np.int64).copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the excess rotations, from the coarsest square to the finest
        low = q - 1
        for i in range(dims):
            far = (x[i] & q) != 0
            swap = np.where(far, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(far, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def step_bounds(rows: DataFrame, column: str, bits: int, scratch: Scratch) -> list:
    """Ascending values at which a column's steps begin; at most 2**bits of them."""
    steps = 1 << bits
    if isinstance(rows.schema[column].dataType, T.NumericType):
        shares = [i / steps for i in range(1, steps)]
        found = rows.agg(F.percentile_approx(column, shares, 20 * steps).alias("p")).first()["p"]
        return sorted(set(found or []))
    counts = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = sorted_slices(counts, [F.col("v")], scratch, f"values-{column}")
    offsets = slice_offsets(ranked, F.col("n"), [])
    total = F.lit(ranked.agg(F.sum("n").alias("t")).first()["t"] or 1)
    running = F.expr("sum(n) OVER (PARTITION BY slice ORDER BY at)") - F.col("n")
    placed = ranked.join(offsets, "slice").withColumn("before", F.col("_offset") + running)
    first = placed.groupBy(F.floor(F.col("before") * steps / total).alias("step")).agg(F.min("v").alias("v"))
    return sorted(row["v"] for row in first.collect())  # one row a step


def plan_shards(
    docs: DataFrame, dimensions: list[str], shards: int, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS
) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, the dimensions, ``curve``, ``shard``, ``slot``.

    Shards are runs of the curve whose row counts differ by one at most.
    """
    scratch = Scratch(docs.sparkSession, "hilbert")
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_BYTES
    narrow = docs.select(
        F.col(id_col).alias("_id"), size.alias("_size"), F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).alias("_crc"),
        *(F.col(d).alias(f"_d{i}") for i, d in enumerate(dimensions)),
    )
    narrow = scratch.save(narrow, "narrow")
    bounds = [step_bounds(narrow, f"_d{i}", bits, scratch) for i in range(len(dimensions))]
    names = [f"_d{i}" for i in range(len(dimensions))]

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.zeros((len(names), batch.num_rows), np.int64)
            for i, name in enumerate(names):
                coded = batch.column(batch.schema.get_field_index(name)).dictionary_encode()
                values = coded.dictionary.to_pylist()
                text = pa.types.is_string(coded.dictionary.type)
                step = [bisect_right(bounds[i], v if text or not bounds[i] or not isinstance(bounds[i][0], str) else str(v)) for v in values]
                at = np.array(coded.indices.fill_null(len(step)))
                steps[i] = np.minimum(np.array([*step, 0])[at], (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_index(steps, bits))], [*batch.schema.names, "curve"])

    curved = narrow.mapInArrow(indexed, T.StructType([*narrow.schema.fields, T.StructField("curve", T.LongType())]))
    ranked = sorted_slices(curved, [F.col("curve"), F.col("_crc"), F.col("_id")], scratch, "ranked")
    scratch.drop("narrow")
    # one row per slice; the counts of all slices are what a rank needs
    offsets = slice_offsets(ranked, F.lit(1), []).withColumn("_n", F.lit(ranked.count()))
    placed = ranked.join(F.broadcast(offsets), "slice").withColumn("_rank", F.col("_offset") + F.col("at"))
    placed = placed.withColumn("shard", F.expr(f"(_rank * {shards}) div _n").cast("int"))
    first = F.expr(f"(shard * _n + {shards - 1}) div {shards}")
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
        *(F.col(n).alias(f"dim_{d}" if d in OUTPUTS else d) for n, d in zip(names, dimensions) if d != id_col), "curve", "shard", (F.col("_rank") - first).alias("slot"),
    )


def manifest(plan: DataFrame, dimensions: list[str]) -> DataFrame:
    """Per shard: rows, bytes and the span of each dimension, for skipping whole shards."""
    spans = [f(d).alias(f"{f.__name__}_{d}") for d in dimensions for f in (F.min, F.max)]
    return plan.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"), *spans)


def write_shards(docs: DataFrame, plan: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the documents as one directory per shard, in slot order. Ids must be unique."""
    shard, slot = fresh(docs.columns, "_shard"), fresh(docs.columns, "_slot")
    placed = docs.join(plan.select(id_col, F.col("shard").alias(shard), F.col("slot").alias(slot)), id_col)
    placed = placed.repartitionByRange(F.col(shard), F.col(slot)).sortWithinPartitions(shard, slot)
    placed.drop(slot).write.partitionBy(shard).parquet(path)
