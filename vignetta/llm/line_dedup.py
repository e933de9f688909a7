"""Line dedup by probing a sharded minimal perfect hash.

The documents per line key are counted first (each key once per document, summed per task before the
shuffle, as a 128-bit hash, never as text). All distinct keys go to shards by the leading bits of their hash; each shard
task builds a minimal perfect hash (a cascade of bit levels: a key that is alone on a slot of a level takes it,
the others go on to the next level; the slot's rank is the key's index) with an array of 32-bit fingerprints and an array of
16-bit counts at those indexes. Documents probe these arrays; lines are never joined: blocks of 2^BLOCK_BITS neighbouring documents send each
of their distinct keys to its shard once, so a line that all documents share makes one probe a block; a task holds one
shard and answers the probes that stream past; the frequent keys come back by block and drop their lines.

Texts are written once with their block and read three times, whatever the number of shards; nothing is broadcast.

Defined results: a null text is empty, and an empty text is one empty line; a key of less than
`min_points` code points is never dropped; a text whose lines are all dropped becomes empty with n_lines unchanged; a key counts
once per row of the table, so repeated rows count as documents; texts of any length are one row; an empty table gives no row; columns other than
doc_id and text, clashing names too, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHARD_KEYS = 1 << 17
BLOCK_BITS = 8
LEVELS = 40
FLUSH = 400_000
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def _long_enough(key: bytes, min_points: int) -> bool:
    return len(key) >= min_points and (min_points <= 1 or len(key.translate(None, _CONTINUATION)) >= min_points)


def line_counts(docs: DataFrame, min_points: int) -> DataFrame:
    """(hi, lo, n): documents per line key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        def rows() -> pa.RecordBatch:
            raw = np.frombuffer(b"".join(seen), ">i8").astype(np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(raw[:, 0]), pa.array(raw[:, 1]), pa.array(list(seen.values()), pa.int64())], ["hi", "lo", "n"])

        for b in batches:
            for t in common.text_bytes(b.column("text")):
                for k in {k for x in t.split(b"\n") if _long_enough(k := line_key(x), min_points)}:
                    d = xxhash.xxh3_128_digest(k)
                    seen[d] = seen.get(d, 0) + 1
            if len(seen) > FLUSH:
                yield rows()
                seen = {}
        if seen:
            yield rows()

    found = common.map_batches(docs.select("text"), run, "hi bigint, lo bigint, n bigint")
    return found.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _slots(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """A slot from both halves of the keys; whether two keys meet is independent from level to level."""
    return (_mix(hi ^ _mix(lo + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys (hi, lo): levels of bits with ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.rank = []
        base = 0
        for bits in levels:
            self.rank.append(base + np.cumsum(bits, dtype=np.int32) - bits)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels = []
        while len(hi):
            if len(levels) == LEVELS:
                raise ValueError("two keys are equal")
            size = 2 * len(hi) + 1
            at = _slots(hi, lo, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(alone)
            hi, lo = hi[~alone[at]], lo[~alone[at]]
        return cls(levels)

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Index of each key; of a key outside the set, any index or -1."""
        out = np.full(len(hi), -1, np.int64)
        open_ = np.arange(len(hi))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            at = _slots(hi[open_], lo[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = self.rank[level][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> tuple[list[int], bytes]:
        return [len(x) for x in self.levels], np.packbits(np.concatenate(self.levels)).tobytes() if self.levels else b""

    @classmethod
    def load(cls, sizes: list[int], bits: bytes) -> PerfectHash:
        flat = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        ends = np.cumsum([0, *sizes])
        return cls([flat[a:b] for a, b in zip(ends[:-1], ends[1:])])


class Shard:
    """What a shard's row holds: the hash, and fingerprints and counts at its indexes."""

    def __init__(self, sizes: list[int], bits: bytes, fps: bytes, counts: bytes):
        self.hash, self.fps, self.counts = PerfectHash.load(list(sizes), bits), np.frombuffer(fps, np.uint32), np.frombuffer(counts, np.uint16)

    def count(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Documents of each key (65,535 stands for as many or more), 0 for one whose fingerprint is another's."""
        at = self.hash.index(hi, lo)
        out = np.where(at >= 0, self.counts[at], 0)
        out[self.fps[at] != (lo & np.uint64(0xFFFFFFFF))] = 0
        return out


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    hi, lo = pdf["hi"].to_numpy(np.int64).view(np.uint64), pdf["lo"].to_numpy(np.int64).view(np.uint64)
    ph = PerfectHash.build(hi, lo)
    at = ph.index(hi, lo)
    fps, counts = np.zeros(len(hi), np.uint32), np.zeros(len(hi), np.uint16)
    fps[at] = lo & np.uint64(0xFFFFFFFF)
    counts[at] = np.minimum(pdf["n"].to_numpy(np.int64), 2**16 - 1)
    sizes, bits = ph.dump()
    return pd.DataFrame([{"shard": int(pdf["shard"].iloc[0]), "sizes": sizes, "bits": bits, "fps": fps.tobytes(), "counts": counts.tobytes()}])


def _shard_of(hi: str, shard_bits: int) -> Column:
    return F.shiftrightunsigned(hi, 64 - shard_bits) if shard_bits else F.lit(0).cast("long")


def line_index(counts: DataFrame) -> tuple[DataFrame, int]:
    """Shard rows (shard, sizes, bits, fps, counts) over all keys, and the number of leading hash bits that name a shard."""
    counts = common.saved(counts, "line-keys")
    n, shard_bits = counts.count(), 0
    while n > SHARD_KEYS << shard_bits:
        shard_bits += 1
    fields = "shard bigint, sizes array<int>, bits binary, fps binary, counts binary"
    common.bound_batches(counts.sparkSession)
    shards = common.saved(counts.withColumn("shard", _shard_of("hi", shard_bits)).groupBy("shard").applyInPandas(_build_shard, fields), "line-shards")
    common.discard(counts)
    return shards, shard_bits


def line_probes(docs: DataFrame, min_points: int) -> DataFrame:
    """(block, hi, lo): the distinct keys of each block of documents; docs has (block, text) and blocks lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, set] = (None, set())
        out: list[tuple[int, bytes]] = []

        def rows() -> pa.RecordBatch:
            hi, lo = np.frombuffer(b"".join(d for _, d in out), ">i8").astype(np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array(hi), pa.array(lo)], ["block", "hi", "lo"])

        for b in batches:
            for block, t in zip(b.column("block").to_pylist(), common.text_bytes(b.column("text"))):
                if block != last[0] or len(last[1]) > FLUSH:  # a key sent twice does no harm
                    out += [(last[0], d) for d in last[1]]
                    last = (block, set())
                    if len(out) > FLUSH:
                        yield rows()
                        out = []
                last[1].update(xxhash.xxh3_128_digest(k) for k in set(map(line_key, t.split(b"\n"))) if _long_enough(k, min_points))
        out += [(last[0], d) for d in last[1]]
        if out:
            yield rows()

    return common.map_batches(docs.select("block", "text"), run, "block bigint, hi bigint, lo bigint")


def probe(shards: DataFrame, shard_bits: int, probes: DataFrame, min_docs: int) -> DataFrame:
    """(block, hi, lo) of the probes whose keys are in at least min_docs documents.

    A shard's row comes before its probes in one partition, so a task holds one shard at a time and probes stream past it.
    """
    null = lambda t: F.lit(None).cast(t)
    asked = probes.select(_shard_of("hi", shard_bits).alias("shard"), "block", "hi", "lo", null("array<int>").alias("sizes"), *[null("binary").alias(c) for c in ("bits", "fps", "counts")])
    index = shards.select("shard", *[null("bigint").alias(c) for c in ("block", "hi", "lo")], "sizes", "bits", "fps", "counts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: Shard | None = None
        for b in batches:
            block, hi, lo = b.column("block"), b.column("hi"), b.column("lo")
            heads = np.flatnonzero(block.is_null().to_numpy(zero_copy_only=False)).tolist()
            found = []
            for start, end in zip([-1, *heads], [*heads, b.num_rows]):
                if start >= 0:
                    shard = Shard(*(b.column(c)[start].as_py() for c in ("sizes", "bits", "fps", "counts")))
                if end > start + 1:
                    x, y = (c.slice(start + 1, end - start - 1).to_numpy().view(np.uint64) for c in (hi, lo))
                    found.append(start + 1 + np.flatnonzero(shard.count(x, y) >= min_docs))
            if found:
                yield b.take(pa.array(np.concatenate(found))).select(["block", "hi", "lo"])

    both = asked.unionByName(index).repartition("shard").sortWithinPartitions("shard", F.col("block").isNotNull())
    return common.map_batches(both.select("block", "hi", "lo", "sizes", "bits", "fps", "counts"), run, "block bigint, hi bigint, lo bigint")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_points: int = 1) -> DataFrame:
    """docs' doc_id with n_lines, n_dropped and kept_text."""
    if not 1 <= min_docs < 2**16:
        raise ValueError("min_docs must fit a 16-bit count")
    # rows of one block are neighbours in one file; the table is written once, because blocks must be the same when it is read again
    rows = common.saved(docs.select("doc_id", "text").withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS)), "line-rows")
    shards, shard_bits = line_index(line_counts(rows, min_points))
    hits = probe(shards, shard_bits, line_probes(rows, min_points), min_docs)
    null = lambda t: F.lit(None).cast(t)
    answers = hits.select("block", F.lit(False).alias("is_doc"), "hi", "lo", null(dict(rows.dtypes)["doc_id"]).alias("doc_id"), null("string").alias("text"))
    asked = rows.select("block", F.lit(True).alias("is_doc"), null("bigint").alias("hi"), null("bigint").alias("lo"), "doc_id", "text")
    both = answers.unionByName(asked).repartition("block").sortWithinPartitions("block", "is_doc")  # a block's frequent keys before its documents

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, often = None, set()
        for b in batches:
            blocks, is_doc = b.column("block").to_numpy(), b.column("is_doc").to_numpy(zero_copy_only=False)
            keys = np.stack([b.column(c).fill_null(0).to_numpy() for c in ("hi", "lo")], axis=1).astype(">i8")
            lines, dropped, kept_texts = [], [], []
            docs_at = np.flatnonzero(is_doc)
            texts = iter(common.text_bytes(b.column("text").take(pa.array(docs_at))))
            for i, (block, doc) in enumerate(zip(blocks.tolist(), is_doc.tolist())):
                if block != last:
                    last, often = block, set()
                if not doc:
                    often.add(keys[i].tobytes())
                    continue
                all_ = next(texts).split(b"\n")
                kept = all_
                if often:
                    kept = [x for x in all_ if not (_long_enough(k := line_key(x), min_points) and xxhash.xxh3_128_digest(k) in often)]
                lines.append(len(all_))
                dropped.append(len(all_) - len(kept))
                kept_texts.append(b"\n".join(kept))
            if lines:
                ids = b.column("doc_id").take(pa.array(docs_at))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept_texts, pa.binary()).cast(pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])

    return common.map_batches(both, run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_lines bigint, n_dropped bigint, kept_text string")
