"""Session settings that plans rely on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoints(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names. Only a local session (tests) may leave it unset and gets
    a folder of its own; on a cluster that is an error, as executors don't see each other's folders."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-checkpoints-"))


def scratch(spark: SparkSession) -> str:
    """A new folder for intermediate tables in the shared one. It is the cluster's to clean."""
    ensure_checkpoints(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{folder.rstrip('/')}/tables-{uuid.uuid4().hex}"


def kept(df: DataFrame, path: str) -> DataFrame:
    """The table, written once. Compressed columns take a small part of what a checkpoint's rows do."""
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
