"""Cutting long plans in the folder that all nodes share, and spreading small tables over all cores."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` saved by a checkpoint in the folder of ``spark.checkpoint.dir``; a lost executor loses none of it."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
            folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")  # a single machine's own
        context.setCheckpointDir(folder)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` as it is, or dealt over all cores where it comes in fewer pieces than those."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
