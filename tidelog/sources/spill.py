"""Spilled events: tables of events kept aside while a snapshot is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import file_name
from ..operators.apply import replay_from

SCHEMA = "table_id string, source_type string, position string, tx_id string, seq bigint, place bigint, is_begin boolean, is_commit boolean, payload string, ts timestamp"


class SpillStore:
    """Events by table in one Parquet folder, partitioned by the table's file name.

    Spark's commit protocol makes an append whole or absent, so there is no tail
    to repair; each payload carries its CRC-32, which reads verify.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, events: DataFrame) -> None:
        marked = events.withColumn("crc", F.crc32(F.encode("payload", "UTF-8"))).withColumn("part", file_name(F.col("table_id")))
        marked.write.mode("append").partitionBy("part").parquet(self.path)

    def exists(self) -> bool:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def read(self, table_id: str | None = None, tx: str = "", seq: int = 0) -> DataFrame:
        """A table's events from (tx, seq) on, in order of ``place``."""
        rows = self.spark.read.schema(f"{SCHEMA}, crc bigint, part string").parquet(self.path) if self.exists() else self.spark.createDataFrame([], f"{SCHEMA}, crc bigint, part string")
        if table_id is not None:
            part = self.spark.range(1).select(file_name(F.lit(table_id))).first()[0]
            rows = rows.filter((F.col("part") == part) & (F.col("table_id") == table_id))
        sound = F.col("crc") == F.crc32(F.encode("payload", "UTF-8"))
        rows = rows.withColumn("payload", F.when(sound, F.col("payload")).otherwise(F.raise_error("a spilled payload is damaged").cast("string")))
        return replay_from(rows.drop("crc", "part"), tx, seq)

    def delete(self, table_id: str) -> None:
        """Removes a table's folder."""
        part = self.spark.range(1).select(file_name(F.lit(table_id))).first()[0]
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={part}")
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)

    def bytes(self) -> int:
        """Bytes of all files, from the listing."""
        if not self.exists():
            return 0
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
