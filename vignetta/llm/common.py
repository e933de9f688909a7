"""Reading, shared work tables and Arrow helpers used by the operators of this subpackage."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: An Arrow batch holds at most so many bytes (a single longer row excepted) and rows.
BATCH_BYTES, BATCH_ROWS = 1 << 20, 100_000
_OWN: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only a local session that names none gets a temporary one, removed at exit."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-shared-"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return "file://" + _OWN[0]


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what `saved` wrote for these tables; nothing may read them any more."""
    for t in tables:
        jvm, at = t.sparkSession._jvm, t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._saved_at)
        at.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def bound_batches(spark: SparkSession) -> None:
    """Whole texts can be long: every Arrow batch of the session is limited by bytes. The limits never differ, so the order of calls doesn't matter."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def split_of(col: str, mod: int):
    """crc32 of an id written as text, modulo mod; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, then give a task's freed memory back to the system: idle Python workers wait beside those of the next stage."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # not in every C library
            trim(0)

    return tidied


def add_columns(df: DataFrame, fields: str, fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """Append columns that fn computes batch by batch; a new column replaces one of the same name.

    fn may also be a factory with the attribute `per_task`: it is then called once in each task.
    """
    bound_batches(df.sparkSession)
    new = T._parse_datatype_string(fields)
    names = {f.name.lower() for f in new}
    keep = [f for f in df.schema if f.name.lower() not in names]
    schema = T.StructType(keep + list(new))
    kept_names = [f.name for f in keep]
    new_names = [f.name for f in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = fn() if getattr(fn, "per_task", False) else fn
        for b in batches:
            if b.num_rows:
                got = work(b)
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in kept_names] + got, kept_names + new_names)

    return df.mapInArrow(_tidy(run), schema)


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of bounded size."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(_tidy(fn), schema)


def per_task(fn):
    fn.per_task = True
    return fn


def content_key(col: str):
    """Hash of a text without its white space; null counts as empty."""
    return F.sha2(F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"[\x20\x09-\x0D]", ""), 256)


def without(docs: DataFrame, key: Column, gone: DataFrame, repeated: DataFrame, *order: Column) -> DataFrame:
    """docs without the rows of (doc_id, key) in `gone`, and one row, the first in order, of each (doc_id, key) in `repeated`; both have (_id, _key).

    Ids and keys are matched null-safe. Only rows that are repeated are ranked. docs may have columns of any name.
    """
    own = uuid.uuid4().hex
    gone, repeated = (t.select(F.col("_id").alias(f"id_{own}"), F.col("_key").alias(f"key_{own}")) for t in (gone, repeated))
    same = docs["doc_id"].eqNullSafe(F.col(f"id_{own}")) & (key == F.col(f"key_{own}"))
    first = Window.partitionBy("doc_id", key).orderBy(*order, F.lit(0))
    many = docs.join(repeated, same, "left_semi").withColumn(f"rank_{own}", F.row_number().over(first)).filter(F.col(f"rank_{own}") == 1).drop(f"rank_{own}")
    return docs.join(gone.unionByName(repeated), same, "left_anti").unionByName(many.join(gone, same, "left_anti"))
