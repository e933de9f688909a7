"""A keyed table that a stream keeps up to date: batches are written as they come and merged level by level.

Batch n of the stream is the folder level=0/batch=n. When a level has FANOUT folders, the newest rows of their keys become one folder of the next level,
named after its last batch, so a table of n batches has some FANOUT * log n folders. A folder counts once its write has finished (its
_SUCCESS file stands); merged folders are removed only after that, and what an interrupted removal left behind is removed by the next
write. A batch that is already stored, by itself or merged, isn't written again, so a batch may be run any number of times.

Folders written in buckets of the key are tables of the session beside that: equal keys meet without an exchange in `newest`, in merges and
in `with_newest`. Where they aren't (another application wrote them), the folders are read as they are, with an exchange and the same rows.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FANOUT = 4


def _store(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def folders(spark: SparkSession, path: str) -> list[tuple[int, int, str]]:
    """(level, batch, path) of finished folders."""
    fs, at = _store(spark, path)
    found = fs.globStatus(at(f"{path}/level=*/batch=*/_SUCCESS")) or []
    named = [re.search(r"^(.*/level=(\d+)/batch=(\d+))/_SUCCESS$", f.getPath().toString()) for f in found]
    return sorted((int(m[2]), int(m[3]), m[1]) for m in named)


def _live(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Folders without those that a higher level has taken up."""
    return [f for f in found if not any(level > f[0] and batch >= f[1] for level, batch, _ in found)]


def is_stored(spark: SparkSession, path: str, batch: int) -> bool:
    return any(b == batch if level == 0 else b >= batch for level, b, _ in folders(spark, path))


def _read(spark: SparkSession, path: str, found: list[tuple[int, int, str]]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[p for _, _, p in found])


def _newest(rows: DataFrame, key: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch")))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n", "batch", "level")


def _table(path: str, level: int, batch: int) -> str:
    return f"levels_{hashlib.md5(path.encode()).hexdigest()}_{level}_{batch}"


def _tables(spark: SparkSession, path: str, found: list[tuple[int, int, str]]) -> list[DataFrame] | None:
    """The folders' tables, newest first; none if one of them isn't known to the session."""
    names = [_table(path, level, batch) for level, batch, _ in sorted(found, key=lambda f: -f[1])]
    return [spark.table(n) for n in names] if all(spark.catalog.tableExists(n) for n in names) else None


def _merged(spark: SparkSession, path: str, found: list[tuple[int, int, str]], key: str) -> DataFrame:
    tables = _tables(spark, path, found)
    if not tables:
        return _newest(_read(spark, path, found), key)
    parts = [reduce(lambda rows, newer: rows.join(newer.select(key), key, "left_anti"), tables[:i], t) for i, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, parts)


def newest(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The newest row of every key; an error if nothing is stored yet."""
    return _merged(spark, path, _live(folders(spark, path)), key)


def with_newest(rows: DataFrame, path: str, key: str, name: str, schema: StructType) -> DataFrame:
    """rows with the newest stored row of their key as the struct `name`, null if there is none; schema is that of a stored row."""
    spark = rows.sparkSession
    found = _live(folders(spark, path))
    tables = _tables(spark, path, found) or ([_merged(spark, path, found, key)] if found else [])
    for i, t in enumerate(tables):
        rows = rows.join(t.select(key, F.struct(*schema.names).alias(f"_at{i}")), key, "left")
    ats = [F.col(f"_at{i}") for i in range(len(tables))]
    return rows.withColumn(name, F.coalesce(*ats) if ats else F.lit(None).cast(schema)).drop(*[f"_at{i}" for i in range(len(tables))])


def _write(rows: DataFrame, path: str, level: int, batch: int, key: str, buckets: int | None) -> None:
    at, table = f"{path}/level={level}/batch={batch}", _table(path, level, batch)
    if buckets:
        rows.write.mode("overwrite").option("compression", "zstd").bucketBy(buckets, key).option("path", at).saveAsTable(table)
    else:
        rows.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
        rows.write.mode("overwrite").parquet(at)


def put(rows: DataFrame, path: str, batch: int, key: str, fanout: int = FANOUT, buckets: int | None = None) -> None:
    """Store a batch's rows, one for each key, and merge levels that are full.

    With `buckets` they are written in buckets of the key; rows should lie in so many partitions of it, and none be without a key.
    """
    spark = rows.sparkSession
    fs, at = _store(spark, path)
    if is_stored(spark, path, batch):
        return
    _write(rows, path, 0, batch, key, buckets)
    level = 0
    while True:
        found = folders(spark, path)
        live = _live(found)
        for f in set(found) - set(live):
            spark.sql(f"DROP TABLE IF EXISTS {_table(path, *f[:2])}")
            fs.delete(at(f[2]), True)
        full = [f for f in live if f[0] == level]
        if len(full) < fanout:
            return
        level += 1
        _write(_merged(spark, path, full, key), path, level, max(b for _, b, _ in full), key, buckets)
