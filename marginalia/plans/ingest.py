"""From extracted sources to indexed chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import catalog
from ..operators.chunking import chunk_sources


@dataclass
class Indexed:
    """New rows for the sources and chunks tables, and what was refused (origin, error)."""

    sources: DataFrame
    chunks: DataFrame
    refused: DataFrame


def index_sources(extracted: DataFrame, existing: DataFrame, existing_chunks: DataFrame, limit: int = 50_000) -> Indexed:
    """Index (id, notebook_id, kind, title, origin, text, sha256, error, added_at), each source on its own terms.

    A source is refused for its own error, for bytes its notebook has, or when its chunks would take the
    notebook over its limit (sources are admitted in id order).
    """
    fit = extracted.filter("error IS NULL").drop("error")
    unique = catalog.dedup_sources(fit, existing)
    new = unique.filter("error IS NULL").withColumn("title", catalog.clean_title(F.col("title")))
    chunks = chunk_sources(new.select(F.col("id").alias("source_id"), "title", "text"))
    n = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    held = existing_chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).join(existing.select(F.col("id").alias("source_id"), "notebook_id"), "source_id")
    held = held.groupBy("notebook_id").agg(F.sum("n").alias("held"))
    sized = new.join(n.withColumnRenamed("source_id", "id"), "id", "left").join(held, "notebook_id", "left")
    running = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy("notebook_id").orderBy("id")) + F.coalesce("held", F.lit(0))
    error = F.when(F.coalesce("n", F.lit(0)) == 0, "INGEST_EMPTY").when(running > limit, "INGEST_CHUNK_LIMIT")
    sized = sized.withColumn("error", error)
    admitted = sized.filter("error IS NULL")
    refused = [x.filter("error IS NOT NULL").select("origin", "error") for x in (extracted, unique, sized)]
    kept = chunks.join(admitted.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    columns = ["id", "notebook_id", "kind", "title", "origin", "sha256", "added_at"]
    return Indexed(admitted.select(*columns), kept, refused[0].unionByName(refused[1]).unionByName(refused[2]))


def refresh_source(tables: catalog.Tables, fresh: DataFrame) -> catalog.Tables:
    """Replace the text of web sources (id, title, text, sha256) under their ids, unless nothing changed."""
    known = tables["sources"].select("id", "notebook_id", F.col("sha256").alias("_was"))
    taken = tables["sources"].select("notebook_id", "sha256", F.col("id").alias("_other"))
    changed = fresh.join(known, "id").filter("sha256 <> _was")
    clash = changed.join(taken, ["notebook_id", "sha256"]).filter("_other <> id").select("id")
    changed = changed.join(clash, "id", "left_anti")
    chunks = chunk_sources(changed.select(F.col("id").alias("source_id"), "title", "text"))
    new = changed.select("id", F.col("title").alias("_title"), F.col("sha256").alias("_sha"))
    sources = tables["sources"].join(new, "id", "left").withColumns({"title": F.coalesce("_title", "title"), "sha256": F.coalesce("_sha", "sha256")})
    return dict(tables, sources=sources.select(*tables["sources"].columns), chunks=catalog.replace_chunks(tables["chunks"], chunks))
