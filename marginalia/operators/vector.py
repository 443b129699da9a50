"""Exact vector search: guarded cosine and top-k per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..limits import TOP_K
from ..lineage import spread
from . import scan
from .lexical import top

#: Queries and components of their vectors that are sent to every task at most.
BROADCAST_QUERIES, BROADCAST_COMPONENTS = 100_000, 1 << 24


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 for empty or different lengths, zero norms and values that aren't finite."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    fit = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (dot(a, a) > 0) & (dot(b, b) > 0)
    finite = ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.coalesce(F.when(fit & finite, value), F.lit(0.0))


def _squares(vectors: np.ndarray) -> np.ndarray:
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total += vectors[:, d] * vectors[:, d]
    return total


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``cosine`` of each row of ``a`` with each of ``b``, to the last bit: products are added up in order."""
    with np.errstate(all="ignore"):
        total, one = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
        for d in range(a.shape[1]):
            np.multiply(a[:, d, None], b[None, :, d], out=one)
            total += one
        x, y = _squares(a), _squares(b)
        value = total / (np.sqrt(x)[:, None] * np.sqrt(y)[None, :])
        return np.where((x > 0)[:, None] & (y > 0)[None, :] & np.isfinite(value), value, 0.0)


def _best(docs: DataFrame, asked: DataFrame, k: int) -> DataFrame | None:
    """The best of each task's chunks by number of the query and named, or None if the batch can't be sent to every task."""
    if not scan.plain_keys(docs, asked) or not docs.filter(F.col("chunk_id").isNull()).isEmpty():
        return None
    sizes = asked.limit(BROADCAST_QUERIES + 1).agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    if sizes[0] > BROADCAST_QUERIES or (sizes[1] or 0) > BROADCAST_COMPONENTS:
        return None
    rows = asked.collect()  # bounded just above
    schema = asked.select(F.lit(0).alias("q"), "query_id").schema
    numbered = asked.sparkSession.createDataFrame([(i, r["query_id"]) for i, r in enumerate(rows)], schema)
    of: dict = {}
    for i, r in enumerate(rows):
        if r["notebook_id"] is not None:  # null equals no notebook
            of.setdefault(r["notebook_id"], {}).setdefault(len(r["vector"]), []).append((i, _doubles(r["vector"])))
    sent = asked.sparkSession.sparkContext.broadcast(
        {notebook: {n: (np.array([i for i, _ in some]), np.array([v for _, v in some]).reshape(len(some), n)) for n, some in sized.items()} for notebook, sized in of.items()}
    )
    kinds = {c: docs.schema[c].dataType for c in ("chunk_id", "source_id")}
    out = T.StructType([T.StructField("q", T.IntegerType()), *(T.StructField(c, t) for c, t in kinds.items()), T.StructField("vec", T.DoubleType())])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of, first, types = sent.value, scan.First(len(rows), k, True), None
        for batch in batches:
            types = [batch.schema.field(c).type for c in ("chunk_id", "source_id")]
            chunk, source = (scan.array(batch, c) for c in ("chunk_id", "source_id"))
            vectors, groups = batch.column(3).to_pylist(), {}
            for i, (notebook, v) in enumerate(zip(batch.column(2).to_pylist(), vectors, strict=True)):
                if notebook in batch_of:
                    groups.setdefault((notebook, len(v)), []).append(i)
            for (notebook, n), at in groups.items():
                every = np.array([_doubles(vectors[i]) for i in at]).reshape(len(at), n)
                for size, (numbers, asks) in batch_of[notebook].items():
                    step = max(1, scan.SLICE_CELLS // 4 // len(numbers))
                    for a in range(0, len(at), step):
                        some = np.array(at[a : a + step])
                        value = cosines(every[a : a + step], asks) if size == n else np.zeros((len(some), len(numbers)))
                        first.add(np.tile(numbers, len(some)), value.ravel(), np.repeat(chunk[some], len(numbers)), np.repeat(source[some], len(numbers)))
        found = first.rows()
        if found is not None:
            q, value, chunk, source = found
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(chunk, types[0]), pa.array(source, types[1]), pa.array(value)], names=["q", "chunk_id", "source_id", "vec"])

    best = spread(docs).mapInArrow(compared, out)
    return best.join(F.broadcast(numbered), "q").select("query_id", "chunk_id", "source_id", "vec")


def _doubles(vector: list) -> list[float]:
    """With null components as what is not finite: both make a cosine of 0."""
    return [float("nan") if v is None else v for v in vector]


def vector_search(chunks: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, chunk_id, source_id, vec, rank) over all embedded chunks of the query's notebook.

    ``queries`` has (query_id, notebook_id, vector) and is one batch; every chunk is compared with each
    query of its notebook, and a query keeps ``k``, dissimilar ones too.
    """
    docs = chunks.filter(F.col("embedding").isNotNull()).select("chunk_id", "source_id", "notebook_id", "embedding")
    asked = queries.filter(F.col("vector").isNotNull()).select("query_id", "notebook_id", "vector")
    scored = _best(docs, asked, k)
    if scored is None:
        scored = docs.join(asked, "notebook_id").select("query_id", "chunk_id", "source_id", cosine(F.col("vector"), F.col("embedding")).alias("vec"))
    return top(scored, "vec", k)
