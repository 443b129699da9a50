"""Tables of a notebook library: appends with validation, cascades, renames, counts and latest rows.

Tables are immutable DataFrames; a change returns the new tables, which the caller writes and swaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..limits import MAX_CHUNKS_PER_NOTEBOOK, MAX_NAME_CHARS, MAX_TITLE_CHARS
from ..schema import TABLES
from .chunking import renamed_context

Tables = dict[str, DataFrame]


def name_error(name: Column) -> Column:
    """Why a name can't be used, or null."""
    trimmed = X.strip(F.coalesce(name, F.lit("")))
    return F.when(trimmed == "", "VALIDATION_REQUIRED_FIELD_MISSING").when(F.length(trimmed) > MAX_NAME_CHARS, "VALIDATION_FIELD_FORMAT_INVALID")


def clean_title(title: Column) -> Column:
    return F.substring(title, 1, MAX_TITLE_CHARS)


def empty_tables(spark) -> Tables:
    return {name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()}


def upgraded(table: DataFrame, name: str) -> DataFrame:
    """A table of an earlier version with the columns it lacks; chunks had no context once."""
    empty = table.sparkSession.createDataFrame([], TABLES[name])
    full = empty.unionByName(table, allowMissingColumns=True).select(*empty.columns)
    return full.withColumn("context", F.coalesce("context", F.lit(""))) if name == "chunks" else full


def dedup_sources(new: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """``new`` with ``error``: SOURCE_ALREADY_EXISTS where its notebook holds the same bytes already.

    Of equal new sources the one with the least id is first. The least id is found by a pre-aggregated
    minimum, so a hash that very many sources share is no hot window.
    """
    key = ["notebook_id", "sha256"]
    first = new.groupBy(*key).agg(F.min("id").alias("_first"))
    out = new.join(first, key)
    held = F.lit(False)
    if existing is not None:
        out = out.join(existing.select(*key).distinct().withColumn("_held", F.lit(True)), key, "left")
        held = F.coalesce("_held", F.lit(False))
    error = F.when(held | (F.col("id") != F.col("_first")), F.lit("SOURCE_ALREADY_EXISTS"))
    return out.withColumn("error", error).select(*new.columns, "error")


def counts(notebooks: DataFrame, sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notebooks with their numbers of sources and chunks, each pre-aggregated before the join."""
    per_source = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    of_notebook = sources.select(F.col("id").alias("source_id"), "notebook_id").join(per_source, "source_id", "left")
    totals = of_notebook.groupBy("notebook_id").agg(F.count(F.lit(1)).alias("n_sources"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_chunks"))
    out = notebooks.join(totals.withColumnRenamed("notebook_id", "id"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_sources", "n_chunks")})


def latest(rows: DataFrame, *group: str, order: str = "id") -> DataFrame:
    """The row of the greatest ``order`` in each group."""
    others = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*others), order).alias("_r")).select(*group, "_r.*")


def recent(messages: DataFrame, group: str, n: int, order: str = "id") -> DataFrame:
    """The last ``n`` rows of each group; callers read them in ascending order."""
    by = Window.partitionBy(group).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")


def delete_notebooks(tables: Tables, ids: DataFrame) -> Tables:
    """All tables without the notebooks in ``ids`` (id) and everything that hangs on them."""
    gone = ids.select(F.col("id").alias("notebook_id"))
    sources = tables["sources"].join(gone, "notebook_id", "left_anti")
    out = dict(tables, sources=sources)
    out["notebooks"] = tables["notebooks"].join(ids.select("id"), "id", "left_anti")
    for name in ("notes", "studio_outputs", "messages"):
        if name in tables:
            out[name] = tables[name].join(gone, "notebook_id", "left_anti")
    lost = tables["sources"].join(gone, "notebook_id", "left_semi").select(F.col("id").alias("source_id"))
    out["chunks"] = tables["chunks"].join(lost, "source_id", "left_anti")
    return out


def delete_sources(tables: Tables, ids: DataFrame) -> Tables:
    out = dict(tables, sources=tables["sources"].join(ids.select("id"), "id", "left_anti"))
    out["chunks"] = tables["chunks"].join(ids.select(F.col("id").alias("source_id")), "source_id", "left_anti")
    return out


def rename_sources(tables: Tables, titles: DataFrame) -> Tables:
    """New titles (id, title) for sources, also at the head of their chunks' contexts."""
    new = titles.select("id", clean_title(X.strip("title")).alias("_new"))
    sources = tables["sources"].join(new, "id", "left")
    moved = sources.filter("_new IS NOT NULL").select(F.col("id").alias("source_id"), F.col("title").alias("_old"), "_new")
    chunks = tables["chunks"].join(moved, "source_id", "left")
    context = F.when(F.col("_new").isNotNull(), renamed_context(F.col("context"), F.col("_old"), F.col("_new"))).otherwise(F.col("context"))
    out = dict(tables, sources=sources.withColumn("title", F.coalesce("_new", "title")).select(*tables["sources"].columns))
    out["chunks"] = chunks.withColumn("context", context).select(*tables["chunks"].columns)
    return out


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """``chunks`` with all chunks of the sources in ``new`` replaced by those in it."""
    return chunks.join(new.select("source_id").distinct(), "source_id", "left_anti").unionByName(new, allowMissingColumns=True)


def touch(notebooks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    return notebooks.join(hit, "id", "left").withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at"))).select(*notebooks.columns)


def over_capacity(chunks: DataFrame, sources: DataFrame, limit: int = MAX_CHUNKS_PER_NOTEBOOK) -> DataFrame:
    """(notebook_id, n) of the notebooks that hold more chunks than allowed."""
    per_source = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    joined = per_source.join(sources.select(F.col("id").alias("source_id"), "notebook_id"), "source_id")
    return joined.groupBy("notebook_id").agg(F.sum("n").alias("n")).filter(F.col("n") > limit)


def put_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    row = settings.sparkSession.createDataFrame([(key, value)], TABLES["settings"])
    return settings.filter(F.col("key") != key).unionByName(row)


def missing(ids: DataFrame, table: DataFrame, code: str) -> DataFrame:
    """(id, error) for the asked ids that a table lacks."""
    return ids.select("id").join(table.select("id"), "id", "left_anti").withColumn("error", F.lit(code))
