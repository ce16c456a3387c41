"""Tables between jobs, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; only a local session without that setting gets a temporary folder of its own."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="scorewright-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/scorewright-{uuid.uuid4().hex}"


def materialised(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends there, and lost executors repeat nothing before it."""
    path = shared_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
