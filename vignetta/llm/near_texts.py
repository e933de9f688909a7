"""Near copies of texts by ball hashing of wide SimHash fingerprints, verified on shingle sets.

The thin query links 64-bit fingerprints at 3 bits, which finds few texts with more than one changed word. Here a text
is near another if the Jaccard similarity of their sets of 5-word shingles is SIMILARITY or more. Candidates come from fingerprints of 128
bits over 3-word shingles, which near texts share in all but some 12 % of their bits. Eight tables of 32 bits each (two ways
to part 128 bits in four) meet in the middle: every distinct fingerprint emits its 1 + 32 variants within half of the radius TABLE_RADIUS = 2
in each table, variants are shuffled, and fingerprints that collide are compared on all 128 bits (FAR_BITS or fewer).

A bucket gives a forest of nearest neighbours, so no group's pairs are listed; buckets of more than BLOCK fingerprints are worked off in sorted blocks
that share a member, and all their members are tied together as one group of candidates. Candidate links are deduplicated and verified on whole texts in two
passes: first each text's nearest link, then all links between texts that the verified ones haven't joined yet.

A forest, or a block's border, may hide a link behind one that fails. So every group of candidates that verified links leave in several parts is
compared once more: of its texts outside its largest part each is compared with all of the group by sketches of HASHES minhashes over 5-word
shingles, in blocks of CHUNK texts, and what looks similar enough (SKETCHED or more) gives a maximum spanning forest, whose links are verified as well.
Verified links are joined to groups by star rounds.

A node is one distinct text, so equal fingerprints of different texts are candidates like any other. Recall is a matter of probability (measured in the README);
precision isn't: every link is verified on whole texts.
Defined results: texts without words are one group; fewer than five words make one shingle; null ids come last; repeated rows are one group; an empty table gives no row;
very long texts are compared whole; other columns are carried along, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import SEED, simhash

SIMILARITY = 0.8
SHINGLE = 5
TABLE_BITS = 32
TABLE_RADIUS = 2
FAR_BITS = 28
BLOCK = 1024
#: Bits of a link that says no more than that two texts share a large bucket.
TIED = 255
HASHES, SKETCHED, CHUNK = 128, 0.7, 1024
_ODD = np.random.default_rng(11).integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)


def _fingerprints(b: pa.RecordBatch) -> list[pa.Array]:
    values = np.array([simhash(t, 2) for t in common.text_bytes(b.column("text"))], np.uint64).reshape(-1, 2).view(np.int64)
    return [pa.array(values[:, 0]), pa.array(values[:, 1])]


def _variants(fps: DataFrame) -> DataFrame:
    """(key, node, f0, f1): the variants of every fingerprint in the eight tables.

    Tables 1 to 4 take the halves of both words, 5 to 8 every fourth bit of both; keys of different tables differ.
    """
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    low = F.lit((1 << 32) - 1)
    halves = [F.shiftrightunsigned(w, s).bitwiseAND(low).bitwiseOR(F.lit((2 * i + s // 32 + 1) << 32)) for i, w in enumerate(("f0", "f1")) for s in (0, 32)]
    every = F.lit(0x1111111111111111)
    fourths = [
        F.shiftrightunsigned("f0", t).bitwiseAND(every).bitwiseOR(F.call_function("shiftleft", F.shiftrightunsigned("f1", t).bitwiseAND(every), F.lit(1))).bitwiseOR(F.lit(signed(t << 2 | 1 << 63)))
        for t in range(4)
    ]
    flips = lambda bits: F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << b)).cast("long") for b in bits])
    # bits 2, 3 of each four are free in the last tables: bit 63 and the table's number stand there
    spread = [4 * i + j for i in range(16) for j in (0, 1)]
    base = fps.select("node", "f0", "f1", F.explode(F.array(*halves, *fourths)).alias("base"))
    flipped = base.select("node", "f0", "f1", "base", F.explode(F.when(F.col("base") < 0, flips(spread)).otherwise(flips(range(32)))).alias("flip"))
    return flipped.select(F.col("base").bitwiseXOR(F.col("flip")).alias("key"), "node", "f0", "f1")


def nearest_forest(f0: np.ndarray, f1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning forest over fingerprints at FAR_BITS or fewer: (index, index, bits)."""
    n = len(f0)
    best, to = np.full(n, 200, np.int64), np.zeros(n, np.int64)
    open_, a, b, d = np.arange(1, n), [], [], []
    at = 0
    while len(open_):
        bits = (np.bitwise_count(f0[open_] ^ f0[at]) + np.bitwise_count(f1[open_] ^ f1[at])).astype(np.int64)
        closer = bits < best[open_]
        best[open_[closer]], to[open_[closer]] = bits[closer], at
        i = int(best[open_].argmin())
        at = int(open_[i])
        if best[at] <= FAR_BITS:
            a.append(at)
            b.append(int(to[at]))
            d.append(int(best[at]))
        open_ = np.delete(open_, i)
    return np.array(a, np.int64), np.array(b, np.int64), np.array(d, np.int64)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, bits) of rows sorted by key and fingerprint; a bucket goes on in the next batch or block with its last member."""
    held = [np.zeros(0, np.int64) for _ in range(4)]
    large = None  # the key of a bucket that goes on

    def found(key, node, f0, f1) -> pa.RecordBatch | None:
        f0, f1 = f0.view(np.uint64), f1.view(np.uint64)
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(start, len(key)))
        pairs = start[size == 2]
        bits = np.bitwise_count(f0[pairs] ^ f0[pairs + 1]) + np.bitwise_count(f1[pairs] ^ f1[pairs + 1])
        near = bits <= FAR_BITS
        out = [(node[pairs[near]], node[pairs[near] + 1], bits[near].astype(np.int64))]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            for lo in range(s, s + n - 1, BLOCK - 1):
                part = slice(lo, min(lo + BLOCK, s + n))
                x, y, d = nearest_forest(f0[part], f1[part])
                out.append((node[part][x], node[part][y], d))
            if n > BLOCK or key[s] == large:
                out.append((node[s + 1 : s + n], np.full(n - 1, node[s]), np.full(n - 1, TIED)))
        a, b, d = map(np.concatenate, zip(*out))
        if not len(a):
            return None
        rows = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b), d], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["a", "b", "bits"])

    for batch in batches:
        key, node, f0, f1 = (np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if len(key) - cut > BLOCK:  # a large bucket isn't held back as a whole: its first member goes on, to tie the rest to
            if (out := found(key, node, f0, f1)) is not None:
                yield out
            held, large = [x[[cut, len(key) - 1]] for x in (key, node, f0, f1)], int(key[-1])
            continue
        elif cut and (out := found(key[:cut], node[:cut], f0[:cut], f1[:cut])) is not None:
            yield out
        held = [x[cut:] for x in (key, node, f0, f1)]
    if len(held[0]) and (out := found(*held)) is not None:
        yield out


def shingle_set(text: bytes) -> frozenset[int]:
    """Hashes of the 5-word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()
    if len(words) <= SHINGLE:
        return frozenset([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-SHINGLE] + 1)).tolist()
    return frozenset(xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist()))


def verified(links: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The links (a, b) whose texts are similar enough; texts has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, frozenset] = (None, frozenset())
        for batch in batches:
            keep = []
            for i, (b, t, u) in enumerate(zip(batch.column("b").to_pylist(), common.text_bytes(batch.column("b_text")), common.text_bytes(batch.column("a_text")))):
                if b != last[0]:
                    last = (b, shingle_set(t))
                x, y = last[1], shingle_set(u)
                both = len(x & y)
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep)).select(["a", "b"])

    first = links.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
    return common.map_batches(first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b"), run, "a bigint, b bigint")


def sketch(text: bytes) -> bytes:
    """Minhashes of a text's shingles, 32 bits each."""
    values = np.fromiter(shingle_set(text), np.uint64)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for i in range(0, len(values), 4096):
        least = np.minimum(least, ((values[i : i + 4096, None] * _ODD) >> np.uint64(32)).min(axis=0))
    return least.astype(np.uint32).tobytes()


def _sketches(b: pa.RecordBatch) -> list[pa.Array]:
    return [pa.array([sketch(t) for t in common.text_bytes(b.column("text"))], pa.binary())]


def likely_links(x: np.ndarray, y: np.ndarray, x_part: np.ndarray, y_part: np.ndarray) -> list[tuple[int, int]]:
    """Links (row of x, row of y) between different parts: each x's most similar y, and a maximum spanning forest of the parts."""
    parent: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := parent.setdefault(k, k)) != k:
            parent[k] = k = parent[up]
        return k

    best, found = [], []
    for i in range(len(x)):
        alike = (y == x[i]).mean(axis=1)
        alike[y_part == x_part[i]] = 0
        j = np.flatnonzero(alike >= SKETCHED)
        if len(j):
            best.append((i, int(j[alike[j].argmax()])))
            found += zip((-alike[j]).tolist(), [i] * len(j), j.tolist())
    forest = []
    for _, i, j in sorted(found):
        if (p := root(int(x_part[i]))) != (q := root(int(y_part[j]))):
            parent[max(p, q)] = min(p, q)
            forest.append((i, j))
    return sorted({*best, *forest})


def _compared(table: pa.Table) -> pa.Table:
    """Likely links of the texts in a block, those of side 0 against those of side 1."""
    side = table.column("side").to_numpy()
    node, part = table.column("node").to_numpy(), table.column("part").to_numpy()
    prints = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint32).reshape(-1, HASHES)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    got = likely_links(prints[x], prints[y], part[x], part[y]) if len(x) and len(y) else []
    a, b = (np.array([g[k] for g in got], np.int64) for k in (0, 1))
    a, b = node[x[a]], node[y[b]]
    return pa.table({"a": pa.array(np.maximum(a, b), pa.int64()), "b": pa.array(np.minimum(a, b), pa.int64())})


def second_look(links: DataFrame, joined: DataFrame, texts: DataFrame) -> DataFrame:
    """Likely links (a, b) inside groups of candidate links that verified ones (joined: node, comp) leave in several parts."""
    part = joined.select("node", F.col("comp").alias("part"))
    members = components(links.select("a", "b")).withColumnRenamed("comp", "group").join(part, "node", "left").withColumn("part", F.coalesce("part", "node"))
    members = common.saved(members, "near-members")
    parts = members.groupBy("group", "part").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("group").agg(F.count("*").alias("parts"), F.max(F.struct("n", "part")).alias("top"), F.sum("n").alias("size")).filter("parts > 1")
    many = lambda n: F.ceil(n / CHUNK).cast("int")
    sizes = open_.select("group", F.col("top.part").alias("top"), many(F.col("size")).alias("js"), many(F.col("size") - F.col("top.n")).alias("is_"))
    sizes = common.saved(sizes, "near-sizes")  # a plain table on this side: AQE can then split a hot group of the other
    rows = members.join(sizes, "group").join(texts, "node").select("group", "node", "part", "top", "js", "is_", "text")
    rows = common.saved(common.add_columns(rows, "sketch binary", _sketches).drop("text"), "near-sketches")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    cols = ["node", "part", "sketch"]
    left = rows.filter("part <> top").select("group", place(F.col("is_")).alias("i"), every(F.col("js")).alias("j"), F.lit(0).alias("side"), *cols)
    right = rows.select("group", every(F.col("is_")).alias("i"), place(F.col("js")).alias("j"), F.lit(1).alias("side"), *cols)
    return left.unionByName(right).groupBy("group", "i", "j").applyInArrow(_compared, "a bigint, b bigint").distinct()


def near_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, text_key (of the whole text), n rows and best, the (doc_id, text_key) of what stays, for every distinct pair of id and text."""
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = docs.select("doc_id", "text", key.alias("text_key"))
    rows = common.saved(common.add_columns(docs, "f0 bigint, f1 bigint", _fingerprints).drop("text"), "near-rows")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("best")
    fps = common.saved(rows.groupBy("text_key").agg(best, F.any_value("f0").alias("f0"), F.any_value("f1").alias("f1")).withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    sorted_ = _variants(fps).repartition("key").sortWithinPartitions("key", "f0", "f1")
    found = common.map_batches(sorted_.select("key", "node", "f0", "f1"), _candidates, "a bigint, b bigint, bits bigint")
    links = common.saved(found.groupBy("a", "b").agg(F.min("bits").alias("bits")), "near-candidates")

    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = fps.join(nodes, "node", "left_semi").select("node", F.col("best.doc_id").alias("_id"), F.col("text_key").alias("_key"))
    # a text may stand in several rows of one id: one of them is enough
    texts = docs.join(asked, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("node", "text").dropDuplicates(["node"])
    texts = common.saved(texts, "near-texts")

    near = links.filter(F.col("bits") < TIED)
    ends = near.select(F.col("a").alias("u"), F.col("b").alias("v"), "bits").unionByName(near.select(F.col("b").alias("u"), F.col("a").alias("v"), "bits"))
    nearest = ends.groupBy("u").agg(F.min(F.struct("bits", "v")).alias("m")).select(F.greatest("u", "m.v").alias("a"), F.least("u", "m.v").alias("b")).distinct()
    sure = common.saved(verified(nearest, texts, similarity), "near-sure")

    def apart(candidates: DataFrame, joined: DataFrame) -> DataFrame:
        comp = lambda end: joined.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
        return candidates.join(comp("a"), "a", "left").join(comp("b"), "b", "left").filter("coalesce(a_comp, a) <> coalesce(b_comp, b)").select("a", "b")

    left = apart(near, components(sure)).join(nearest, ["a", "b"], "left_anti")
    more = common.saved(verified(left, texts, similarity).unionByName(sure), "near-more")
    likely = second_look(links, components(more), texts).join(near, ["a", "b"], "left_anti")
    last = common.saved(verified(likely, texts, similarity).unionByName(more), "near-last")
    common.discard(texts, sure, more)

    parts = components(last).withColumnRenamed("comp", "group")
    named = common.saved(fps.join(parts, "node", "left").withColumn("group", F.coalesce("group", "node")), "near-groups")
    stays = common.saved(named.groupBy("group").agg(F.min("best").alias("best")), "near-stays")  # a plain table, as in second_look
    of = named.drop("best").join(stays, "group").select("text_key", "best")
    return rows.join(of, "text_key").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"), F.first("best").alias("best"))


def drop_near(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the row of the smallest doc_id (null ids last) of every group of near copies, columns unchanged."""
    key = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    found = common.saved(near_groups(docs, similarity).withColumnsRenamed({"doc_id": "_id", "text_key": "_key"}), "near-found")
    stays = F.col("_id").eqNullSafe(F.col("best.doc_id")) & (F.col("_key") == F.col("best.text_key"))
    return common.without(docs, key, found.filter(~stays).select("_id", "_key"), found.filter(stays & (F.col("n") > 1)).select("_id", "_key"))
