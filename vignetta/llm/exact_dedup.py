"""Exact duplicates by a tree-merge of sorted digest runs.

Every input partition digests its texts and sorts the digests into one run. Runs then meet in binomial
rounds: round r brings together the runs whose numbers agree after dropping 3r bits (eight runs at a time),
always split by digest so that a round uses all executors. The sorted shuffle merges the runs and one pass
keeps the best row of equal digests and adds up their sizes, so a group of copies shrinks to one row per
run before it travels and never gathers anywhere. Digests are verified at every level by a second,
independent 64-bit hash and the normalised length.

Defined results: a null text is empty; all empty or blank texts are one group; equal lengths fall to the
smallest doc_id (null ids last); of wholly repeated rows exactly one is kept; an empty table gives no row;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FAN_IN_BITS = 3
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))
_KEY = ["digest", "check", "norm_bytes"]


def _digest(b: pa.RecordBatch) -> list[pa.Array]:
    texts = common.text_bytes(b.column("text"))
    digest, check, size, points = [], [], [], []
    for t in texts:
        n = t.translate(None, _SPACE)
        digest.append(hashlib.sha256(n).digest())
        check.append(xxhash.xxh3_64_intdigest(n) - (1 << 63))
        size.append(len(n))
        points.append(len(t.translate(None, _CONTINUATION)))
    return [pa.array(digest, pa.binary()), pa.array(check, pa.int64()), pa.array(size, pa.int64()), pa.array(points, pa.int64())]


def digest_rows(docs: DataFrame) -> DataFrame:
    """One small row per document: row_id, doc_id, digest, check, norm_bytes, n_points, run."""
    rows = common.add_columns(docs.select("doc_id", "text"), "digest binary, check bigint, norm_bytes bigint, n_points bigint", _digest).drop("text")
    return rows.withColumns({"row_id": F.monotonically_increasing_id(), "run": F.spark_partition_id()})


def _first_of_equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge pass over sorted rows: the first of equal digests stays with the sum of sizes; the last run of a batch goes on in the next."""
    held: pa.Table | None = None
    for b in batches:
        rows = pa.Table.from_arrays(b.columns, names=b.schema.names)  # without the batch's own notes on nulls
        rows = rows if held is None else pa.concat_tables([held, rows])
        if not rows.num_rows:
            continue
        rows = rows.combine_chunks()
        new = np.zeros(rows.num_rows, bool)
        new[0] = True
        for name in ("grp", *_KEY):
            c = rows[name].chunk(0)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        size = np.add.reduceat(rows["size"].to_numpy(), first)
        rows = rows.take(pa.array(first)).drop_columns(["size"]).append_column("size", pa.array(size))
        held = rows.slice(rows.num_rows - 1)
        yield from rows.slice(0, rows.num_rows - 1).to_batches()
    if held is not None:
        yield from held.to_batches()


def tree_merge(rows: DataFrame) -> DataFrame:
    """Winners: one row per distinct verified digest with keep_id, keep_row and group_size."""
    cols = ["grp", *_KEY, "n_points", "doc_id", "row_id", "size"]
    order = ["grp", *_KEY, F.desc("n_points"), F.asc_nulls_last("doc_id"), "row_id"]
    level = rows.select(F.col("run").alias("grp"), *_KEY, "n_points", "doc_id", "row_id", F.lit(1).cast("long").alias("size"))
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    level = common.map_batches(level.sortWithinPartitions(*order), _first_of_equal, level.select(*cols).schema)
    while True:
        level = level.withColumn("grp", F.shiftright("grp", FAN_IN_BITS))
        runs = (runs + (1 << FAN_IN_BITS) - 1) >> FAN_IN_BITS
        level = common.map_batches(level.repartition("grp", *_KEY).sortWithinPartitions(*order), _first_of_equal, level.select(*cols).schema)
        if runs <= 1:
            break
    return level.select(*_KEY, F.col("doc_id").alias("keep_id"), F.col("row_id").alias("keep_row"), F.col("size").alias("group_size"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    rows = common.saved(digest_rows(docs), "digests")
    winners = common.saved(tree_merge(rows), "digest-winners")
    return rows.join(winners, _KEY).select(
        "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without exact copies, columns unchanged."""
    found = common.saved(exact_dedup(docs).withColumnsRenamed({"doc_id": "_id", "text_sha256": "_key"}), "exact-copies")
    gone = found.filter(~F.col("_id").eqNullSafe(F.col("keep_id"))).select("_id", "_key").distinct()
    repeated = found.filter(F.col("_id").eqNullSafe(F.col("keep_id"))).groupBy("_id", "_key").agg(F.count("*").alias("n")).filter("n > 1").select("_id", "_key")
    return common.without(docs, common.content_key("text"), gone, common.saved(repeated, "exact-repeats"), F.desc(F.length(F.coalesce("text", F.lit("")))))
