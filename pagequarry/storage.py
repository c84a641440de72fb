"""Intermediate tables of iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset on a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="pagequarry-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet and read it back: a short plan, and rows that outlive their executors."""
    path = f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
