"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, one per bit position that is set in over half of the XXH64 values (seed 42) of the
3-word shingles. Two fingerprints link at RADIUS = 3 or fewer differing bits.

Ball hashing of a whole 64-bit ball would need radius 2 around every fingerprint (2,081 variants) because 3 is
odd. Splitting the word in four 16-bit blocks removes the odd bit: of up to three differing bits at least one
lies in the block that differs most, so once that block is left out at most two remain, and both sides
meet in the middle with radius-1 variants of the other 48 bits. Every distinct fingerprint emits
4 x (1 + 48) = 196 variants; variants are shuffled, equal ones meet, and every colliding pair is verified on all
64 bits. Copies share one fingerprint and are folded before anything is emitted.

A bucket can hold at most 49 x 65,536 distinct fingerprints. Inside one, links are found as a spanning forest, so the
number of emitted links is below the number of members and no group's pairs are ever listed: breadth-first over
vectorised distance rows, or, in buckets of over ROW_LIMIT members, on a grid. All members are the bucket's centre
or one bit from it outside the left-out block, so a member is a cell (that bit or none, value of the block), and what
is left to try is 696 masks of one to three bits inside the block. Components are joined by star rounds.

Defined results: null, empty and blank texts have fingerprint zero and are linked like any other; fewer than
three words make one shingle of the whole sequence; repeated rows get equal answers; component_id is the
least non-null doc_id reachable; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

RADIUS = 3
BLOCKS = 4
SEED = 42
SHINGLE = 3
ROW_LIMIT = 20_000


def simhash(text: bytes, n_words: int = 1) -> list[int]:
    """Unsigned 64-bit words of the SimHash of one text in UTF-8, A-Z lower-cased; words after the first use mixes of the hashes."""
    words = text.lower().split()
    if not words:
        return [0] * n_words
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        values = np.array([h(joined, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
        values = np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, len(words) - SHINGLE + 1)
    out = []
    for _ in range(n_words):
        ones = np.zeros(64, np.int64)
        for i in range(0, len(values), 4096):
            ones += np.unpackbits(values[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0]))
        values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        values ^= values >> np.uint64(32)
    return out


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of one text."""
    return simhash(text)[0]


def _fingerprints(b: pa.RecordBatch) -> list[pa.Array]:
    values = np.array([fingerprint(t) for t in common.text_bytes(b.column("text"))], np.uint64)
    return [pa.array(values.view(np.int64))]


def variant_table() -> list[tuple[int, int]]:
    """(keep mask, flip) as signed longs; the left-out block of a key carries the block's number plus one."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    width = 64 // BLOCKS
    out = []
    for block in range(BLOCKS):
        inside = range(block * width, (block + 1) * width)
        keep = sum(1 << i for i in range(64) if i not in inside)
        tag = (block + 1) << (block * width)
        out += [(signed(keep), signed(tag | flip)) for flip in [0, *(1 << i for i in range(64) if i not in inside)]]
    return out


def spanning_links(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph 'at most radius bits differ' over distinct fingerprints, each compared with all not yet reached."""
    a, b = [], []
    rest = fps
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            f = front.pop()
            near = np.bitwise_count(rest ^ f) <= radius
            if near.any():
                got = rest[near]
                a.append(np.full(len(got), f))
                b.append(got)
                front.extend(got)
                rest = rest[~near]
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(a), np.concatenate(b)


class _Forest:
    """Edges offered in arrays; those that join two trees are kept, one for each tree that is hooked to another."""

    def __init__(self, n: int) -> None:
        self.tree = np.arange(n)
        self.kept: list[np.ndarray] = []

    def offer(self, x: np.ndarray, y: np.ndarray) -> None:
        while len(x):
            p, q = self.tree[x], self.tree[y]
            live = p != q
            x, y, high, low = x[live], y[live], np.maximum(p, q)[live], np.minimum(p, q)[live]
            hooked, at = np.unique(high, return_index=True)
            if not len(hooked):
                return
            self.kept.append(np.stack((x[at], y[at])))
            to = np.arange(len(self.tree))
            to[hooked] = low[at]  # to a lower number always, so hooks form no ring
            while (to != to[to]).any():
                to = to[to]
            self.tree = to[self.tree]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple(np.concatenate(self.kept, axis=1)) if self.kept else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _block_masks(radius: int) -> list[int]:
    """Masks of 1 to radius bits of a block."""
    return [sum(1 << i for i in c) for r in range(1, radius + 1) for c in combinations(range(64 // BLOCKS), r)]


def grid_links(fps: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links that joins all pairs within RADIUS bits that share this bucket through one left-out block.

    fps: distinct unsigned members of the bucket. Two members whose outer bits differ from the centre in different places are two
    bits apart before the block counts, so one member of each block value stands for all that are off the centre.
    """
    width = 64 // BLOCKS
    full = (1 << width) - 1
    found = []
    for block in range(BLOCKS):
        shift = width * block
        if key >> shift & full != block + 1:  # the key's mark of its left-out block
            continue
        off = (fps ^ np.uint64(key)) & ~np.uint64(full << shift)
        own = fps[np.bitwise_count(off) <= 1]
        off = off[np.bitwise_count(off) <= 1]
        lines, line = np.unique(off, return_inverse=True)
        value = (own >> np.uint64(shift) & np.uint64(full)).astype(np.int64)
        cell = np.full((len(lines), full + 1), -1, np.int32)
        cell[line, value] = np.arange(len(own))
        forest = _Forest(len(own))
        every = np.arange(len(own))
        outer = every[off != 0]
        stands = np.full(full + 1, -1, np.int64)  # a member off the centre for each value of the block
        stands[value[outer]] = outer
        centre = every[off == 0]

        def offer(x: np.ndarray, y: np.ndarray) -> None:
            forest.offer(x[y >= 0], y[y >= 0])

        if RADIUS >= 2:
            offer(outer, stands[value[outer]])
        for m in [0, *_block_masks(RADIUS)]:
            n = m.bit_count()
            if m:
                offer(every, cell[line, value ^ m])
            if n <= RADIUS - 1:
                offer(centre, stands[value[centre] ^ m])
            if m and n <= RADIUS - 2:
                offer(outer, stands[value[outer] ^ m])
        x, y = forest.edges()
        found.append((own[x], own[y]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    a, b = zip(*found)
    return np.concatenate(a), np.concatenate(b)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verified links from rows sorted by key; a bucket that a batch cuts is carried on to the next."""
    carried_k, carried_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        a, b = [], []
        pairs = start[size == 2]
        near = pairs[np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= RADIUS]
        a.append(fp[near])
        b.append(fp[near + 1])
        for s, n in zip(start[size > 2], size[size > 2]):
            x, y = spanning_links(fp[s : s + n]) if n <= ROW_LIMIT else grid_links(fp[s : s + n], int(key[s]) % 2**64)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        if not len(a):
            return None
        pair = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    for batch in batches:
        key = np.concatenate((carried_k, batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((carried_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(key):
            continue
        cut = np.searchsorted(key, key[-1])
        if cut and (out := found(key[:cut], fp[:cut])) is not None:
            yield out
        carried_k, carried_f = key[cut:], fp[cut:]
    if len(carried_k) and (out := found(carried_k, carried_f)) is not None:
        yield out


def links(fps: DataFrame) -> DataFrame:
    """Spanning links (a > b) between the distinct fingerprints in column fp."""
    spark = fps.sparkSession
    variants = F.explode(F.array(*[F.struct(F.lit(k).alias("keep"), F.lit(x).alias("flip")) for k, x in variant_table()]))
    emitted = fps.select("fp", variants.alias("v")).select(F.col("fp").bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("key"), "fp")
    return common.map_batches(emitted.repartition("key").sortWithinPartitions("key"), _links, "a bigint, b bigint")


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs."""
    rows = common.saved(common.add_columns(docs.select("doc_id", "text"), "fp bigint", _fingerprints).drop("text"), "simhash-rows")
    fps = common.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-fps")
    found = common.saved(links(fps.select("fp")), "simhash-links")
    parts = components(found)
    of = common.saved(fps.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")), "simhash-parts")
    least = of.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = common.saved(of.join(least, "comp").select("fp", "component_id"), "simhash-named")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
