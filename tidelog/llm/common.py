"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_LONE_SURROGATE = re.compile("[\ud800-\udfff]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in one Arrow batch.  Texts are long, and a batch is held several times over
#: (in the JVM, as Arrow and as Python objects).
BATCH_ROWS = 500


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches, and those that Parquet is read in, to ``BATCH_ROWS`` rows."""
    for name in ("execution.arrow.maxRecordsPerBatch", "parquet.columnarReaderBatchSize"):
        spark.conf.set(f"spark.sql.{name}", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in ``spark.checkpoint.dir``.  Only where that is unset (a
    single machine, as in tests) a temporary folder is made and recorded there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; nothing exists there yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffles of DataFrames made here go as soon as an action on them ends.

    Otherwise their files stay until the driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again.

    This cuts the lineage: the files outlive any executor.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path, in whatever store it is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release_memory() -> None:
    """Gives freed memory back to the system at the end of a task: an idle worker
    stays for a while, beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError, TypeError):  # another C library
        pass


def texts(column) -> list[str]:
    """An Arrow string column as Python strings, null as the empty text."""
    return [t or "" for t in column.to_pylist()]
