"""Tables in the folder that every node of the cluster can reach, and ranks over whole tables.

Long plans are cut by writing a table and reading it again, never by a local checkpoint, so a lost
executor costs a re-read and not the job.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, one of a single machine's own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Named tables of one run under the shared folder."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.tables: list[str] = []
        for opened in _scopes:
            opened.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with self.tidy():
            df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_bucketed(self, df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
        """Like ``save``, in buckets by a column: a later join on it leaves this side where it is."""
        table = f"{self.root.rpartition('/')[2]}_{name}".replace("-", "_")
        writer = df.write.format("parquet").option("compression", "zstd").option("path", f"{self.root}/{name}")
        with self.tidy():
            writer.bucketBy(buckets, column).saveAsTable(table)
        self.tables.append(table)
        return self.spark.table(table)

    @contextmanager
    def tidy(self) -> Iterator[None]:
        """What is shuffled for a saved table goes once it is saved."""
        key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        was = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, was)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_scopes: list[list[Scratch]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes at its end all scratch tables opened inside; results must be saved elsewhere by then."""
    opened: list[Scratch] = []
    _scopes.append(opened)
    try:
        yield
    finally:
        _scopes.remove(opened)
        for scratch in opened:
            for table in scratch.tables:
                scratch.spark.sql(f"DROP TABLE IF EXISTS {table}")
            scratch.drop("")


#: Rows of a batch that a Python worker gets; whole texts make batches of many MB, held on both sides of the pipe.
BATCH_ROWS = 2000


def light_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches: the setting is read when a plan runs, so it stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def free_heaps(spark: SparkSession) -> None:
    """Has executors collect all garbage: a heap that once grew is else held beside the Python workers of whatever comes next.

    One task a core, all sent out at once. An executor that gets none keeps its heap; no result depends on it.
    """
    cores = spark.sparkContext.defaultParallelism
    collected = F.call_function("java_method", F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(collected.alias("_")).write.format("noop").mode("overwrite").save()


def fresh(taken: list[str], name: str) -> str:
    """``name``, or with as many underscores behind it that no column has it; Spark's names ignore case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


#: A side of a join is sent to every task up to so many bytes; beyond it, both sides are shuffled.
BROADCAST_BYTES = 64 << 20


def fits(df: DataFrame) -> bool:
    """Whether a saved table is small enough to be broadcast, by its rows and what they hold."""
    kinds = [f.dataType for f in df.schema.fields]
    held = [F.octet_length(f.name) for f, k in zip(df.schema.fields, kinds) if isinstance(k, (T.StringType, T.BinaryType))]
    held += [F.size(f.name) * 32 for f, k in zip(df.schema.fields, kinds) if isinstance(k, T.ArrayType)]
    row = sum((F.coalesce(h, F.lit(0)) for h in held), F.lit(16 + 8 * len(kinds)))
    return (df.agg(F.sum(row.cast("long")).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_slices(df: DataFrame, order: list[Column], scratch: Scratch, name: str) -> DataFrame:
    """``df`` range-sorted by ``order`` and saved, with ``slice`` (its range) and ``at`` (place in it).

    ``order`` should end in a unique column: ties are then spread over ranges like other rows.
    """
    width = shuffle_width(df.sparkSession)
    ranged = df.repartitionByRange(width, *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    ranged = ranged.withColumn("_place", place)
    ranged = ranged.withColumn("slice", F.shiftright("_place", 33).cast("int"))
    ranged = ranged.withColumn("at", F.col("_place").bitwiseAND((1 << 33) - 1)).drop("_place")
    return scratch.save(ranged, name)


def slice_offsets(slices: DataFrame, weight: Column, within: list[str]) -> DataFrame:
    """Weight before each slice, inside each group ``within``: one small row per slice and group."""
    sums = slices.groupBy("slice", *within).agg(F.sum(weight).alias("_here"))
    before = Window.partitionBy(*within).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        "slice", *within, F.coalesce(F.sum("_here").over(before), F.lit(0)).cast("long").alias("_offset")
    )
