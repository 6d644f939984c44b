"""Where intermediate files go."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder of spark.checkpoint.dir or setCheckpointDir; a temporary one only for a local session without either."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="calorant-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base}/{purpose}-{uuid.uuid4().hex}"


def settled(df: DataFrame, purpose: str = "table") -> DataFrame:
    """df written as Parquet in the shared folder and read back, to cut its plan where it is used often."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
