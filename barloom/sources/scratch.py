"""Folders for what a query writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Where the session names none, a temporary folder does in local mode only, where driver and
    executors are one process; on a cluster each machine would write to its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def at_end(spark: SparkSession, path: str) -> None:
    """Removes a folder when the application ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the folder that the session shares with all executors."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table that was written once, for results that several later steps read; a lost executor costs none of the steps before."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
