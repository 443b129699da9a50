"""Continuous ingest: new files become sources and chunks as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import chunk_sources


def chunk_stream(sources: DataFrame) -> DataFrame:
    """Chunks of a stream of sources (source_id, title, text); stateless, so the batch operator serves."""
    return chunk_sources(sources)


def start_ingest(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Read parquet files of sources as they appear; each batch is deduplicated and appended once.

    A batch is written under its number, so a batch that is run again replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["source_id"])
        chunk_sources(new).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) per window and type; works on a stream (with a watermark) and on a table."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    grouped = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
