"""Intermediate files in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in ``spark.checkpoint.dir``; in local mode in a folder of our own where that is unset."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lexiscope-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/lexiscope/{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet and read again, so that it is evaluated once."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
