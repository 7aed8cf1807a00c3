"""Lineage cuts that survive the loss of an executor.

Everything here writes under the folder named by ``spark.checkpoint.dir``, which
driver and executors share. Only where that setting is absent *and* the session
runs in one JVM (``local[...]``, as in tests) a temporary folder is used instead.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_root(spark: SparkSession) -> str:
    """The folder shared by all executors, as a URI."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    made = spark.sparkContext.getCheckpointDir()
    if made:
        return made.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="basalt-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably; removed by Spark's cleaner once unreferenced."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_root(spark))
    return df.checkpoint(eager=True)


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle and checkpoint files that nothing refers to any more.

    The cleaner acts when the driver collects garbage, which a loop of many small jobs
    on a quiet driver may not cause before the files of all rounds have piled up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for a written table; it goes when the application ends."""
    path = f"{shared_root(spark)}/basalt-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target)
    fs.deleteOnExit(target)
    return fs.makeQualified(target).toString()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder made by ``scratch`` that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Columnar and compressed, so cheaper than ``checkpoint`` for wide rows that
    are read more than once or with few of their columns.
    """
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[table] = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for ``tables``, once nothing that is still to run reads it."""
    for table in tables:
        remove(table.sparkSession, _written.pop(table))
