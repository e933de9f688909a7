"""The folder that all executors share, and tables kept there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; only a local session that sets none gets a temporary folder, removed at exit."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        root = "file://" + _OWN[0]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def keep_until_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove path when the driver ends: results that read it are lazy, so none can remove it earlier."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def saved(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df written to the shared folder and read back: computed once however often it is used, and safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    keep_until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written in here are removed when it is written, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
