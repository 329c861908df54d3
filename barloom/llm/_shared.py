"""Tables written between the steps of one operator, in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.sources.scratch import at_end, shared_folder


#: Bytes of a batch of rows between Spark and a Python worker. Both sides hold a batch whole, with room for it to grow, once for each task.
_BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Batches that go to Python are of ``_BATCH`` bytes at most, or one longer row: Spark's own limit is 10,000 rows or 64 MB, texts included."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > _BATCH:
        spark.conf.set(name, str(_BATCH))


class Workspace:
    """Parquet tables of one run under the shared folder.

    A written table cuts the lineage: when an executor is lost, its readers start from files instead of
    recomputing the steps before. ``drop`` removes tables that nothing reads any more; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/barloom-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0

    def write(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        if self._n == 1:
            at_end(self.spark, self.root)
        table = self.spark.read.schema(df.schema).parquet(path)
        table._barloom_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._barloom_path)
            path.getFileSystem(conf).delete(path, True)

    def size(self, table: DataFrame) -> int:
        """Bytes of a table's files."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(table._barloom_path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def joinable(self, table: DataFrame, limit: int = 16 << 20) -> DataFrame:
        """A written table for the smaller side of a join: broadcast if its files are at most ``limit`` bytes, else merged whatever Spark thinks of it."""
        return F.broadcast(table) if self.size(table) <= limit else table.hint("merge")
