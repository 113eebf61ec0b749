"""The folder that driver and executors share, and tables written there so that lineage ends."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; where that is unset, a temporary folder of the application for a local master, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"quillon-{os.getpid()}-{spark.sparkContext.applicationId}")
    return at.rstrip("/")


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/quillon/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read back."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
