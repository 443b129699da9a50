"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Each node's larger (or not larger) neighbours are tied to the least node that it knows.

    The least neighbour is found by a pre-aggregated minimum and joined back, so a node with very many
    neighbours is split like any skewed key and never gathered.
    """
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        near = near.filter("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = near.join(least, "u")
    out = tied.filter("v > u") if large else tied
    out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) for every node of ``links`` (u, v): component is the least node reachable.

    Each round is a saved table; rounds stop when one changes nothing. Self-links and repeats are
    allowed; nodes without links are not in the result.
    """
    state = scratch.save(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0")
    print_of = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")]
    was, k = state.agg(*print_of).first(), 0
    while was["n"]:
        k += 1
        state = scratch.save(_star(_star(state, True), False), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
        now = state.agg(*print_of).first()
        if now == was:
            break
        was = now
    roots = state.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
