"""Near copies of embeddings by an exact metric range join.

Vectors of one label (and length) are compared as unit vectors, whose Euclidean distance is at most RADIUS = sqrt(2 - 2 * MIN_COSINE) for a cosine of
MIN_COSINE or more. A cell of more than CELL vectors is parted by pivots, vectors drawn from it by hash: a vector's home is the cell of
its nearest pivot p, and by the triangle inequality a partner of it can be at home with pivot q only if its distance to the plane between p and q,
(d(x, q)^2 - d(x, p)^2) / 2 d(p, q), is at most RADIUS. So it visits those of these cells that have a later pivot (every pair is found in one
cell), and cells are joined independently of each other. Cells that are still too large are parted again; a vector that visits one then visits all parts
of it that it may have partners in.

Vectors of high intrinsic dimension, or a crowd closer than RADIUS, can't be parted by pivots. A cell is parted only if a sample of it says that this saves SAVING
of the comparisons; otherwise it is joined in blocks: its rows are dealt in chunks of CELL, and each two chunks are one group, at most 2 * CELL rows
on average. The sample chooses the way only, results don't depend on it. A group counts the links of each of its rows and gives a spanning forest
of them, so pairs aren't listed and rows out are in proportion to rows in. Equal vectors are folded before anything else and count as many times as they stand there.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and those without a label, link with nothing; vectors of
different lengths don't link; a repeated row is another vector; component_id is the least non-null vec_id reachable; a null vec_id is kept if its
component has none; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

MIN_COSINE = 0.98
CELL = 2048
PIVOTS = 16
#: Rows of a cell that are looked at to judge a parting, on average.
SAMPLE = 512
SAVING = 0.5
LEVELS = 12
#: Distances are rounded up by so much, so that rounding never loses a pair.
SLACK = 1e-6
#: Rows of one distance table in a task.
ROWS_AT_ONCE = 1024


def _vectors(batch: pa.RecordBatch, name: str) -> list[np.ndarray | None]:
    """A list column's rows as double vectors; None where a row or a component is null or non-finite, or all are zero."""
    column = batch.column(name).cast(pa.list_(pa.float64()))
    values, ends = column.values, column.offsets.to_numpy()
    flat = values.to_numpy(zero_copy_only=False)  # null components become NaN
    valid = column.is_valid().to_pylist()
    out = []
    for ok, a, b in zip(valid, ends[:-1].tolist(), ends[1:].tolist()):
        v = flat[a:b]
        out.append(v if ok and b > a and np.isfinite(v).all() and v.any() else None)
    return out


def _units(batch: pa.RecordBatch) -> list[pa.Array]:
    """Unit vectors as bytes of doubles (null if they link with nothing), and digests of the vectors given."""
    units, digests = [], []
    for v in _vectors(batch, "embedding"):
        if v is None:
            units.append(None)
            digests.append(None)
            continue
        v = v + 0.0  # one zero
        digests.append(hashlib.sha256(v.tobytes()).digest())
        v = v / np.abs(v).max()
        units.append((v / np.sqrt(v @ v)).tobytes())
    return [pa.array(units, pa.binary()), pa.array(digests, pa.binary())]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (x @ y.T)))


def assign(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Nearest pivot of every row, and a table of the cells it is in (home or visiting)."""
    d = _distances(x, pivots)
    near = d.argmin(axis=1)
    own = d[np.arange(len(x)), near]
    between = _distances(pivots, pivots)[near]
    in_reach = d * d - (own * own)[:, None] <= 2 * between * (radius + SLACK) + SLACK
    later = np.arange(len(pivots))[None, :] > near[:, None]
    cells = in_reach & (later | ~home[:, None])
    cells[np.flatnonzero(home), near[home]] = True
    return near, cells


def saving(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, radius: float) -> float:
    """Share of a cell's comparisons that parting it by these pivots would leave, by a sample x."""
    near, cells = assign(x, home, pivots, radius)
    homes = np.bincount(near[home], minlength=len(pivots))
    visits = cells.sum(axis=0) - homes
    before = home.sum() * (home.sum() / 2 + (~home).sum())
    return float((homes * (homes / 2 + visits)).sum() / max(before, 1))


def _judge(radius: float):
    """For a cell's sample, its pivots in order of hash and whether to part by them."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("home", "descending"), ("draw", "ascending"), ("node", "ascending")])
        x, home = _matrix(table.column("unit").combine_chunks()), table.column("home").to_numpy()
        k = min(PIVOTS, int(home.sum()))
        part = k > 1 and saving(x, home, x[:k], radius) <= SAVING
        return pa.table({"cell": table.column("cell").slice(0, 1), "pivots": pa.array([x[:k].tobytes() if part else None], pa.binary()), "k": pa.array([k], pa.int64())})

    return run


def _part(radius: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Deal rows to the cells of their cell's pivots; a cell's pivots come ahead of its rows."""
    cell, pivots = None, None
    for b in batches:
        cells = b.column("cell").to_pylist()
        kinds = b.column("kind").to_numpy(zero_copy_only=False)
        cut = [i for i in range(len(cells)) if i == 0 or cells[i] != cells[i - 1] or kinds[i] != kinds[i - 1]] + [len(cells)]
        for lo, hi in zip(cut, cut[1:]):
            rows = b.slice(lo, hi - lo)
            if kinds[lo] == 0:
                raw = rows.column("unit")[0].as_py()
                cell, width = cells[lo], int(rows.column("node")[0].as_py())
                pivots = np.frombuffer(raw, np.float64).reshape(width, -1)
                continue
            for at in range(0, rows.num_rows, ROWS_AT_ONCE):
                some = rows.slice(at, ROWS_AT_ONCE)
                x, home = _matrix(some.column("unit")), some.column("home").to_numpy(zero_copy_only=False)
                near, into = assign(x, home, pivots, radius)
                row, to = np.nonzero(into)
                taken = some.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{cell}/{t}" for t in to.tolist()]), taken.column("node"), taken.column("many"), pa.array(home[row] & (near[row] == to)), taken.column("unit")], ["cell", "node", "many", "home", "unit"]
                )


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links between two lists of row numbers."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        if (p := root(x)) != (q := root(y)):
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def link_group(x: np.ndarray, many: np.ndarray, home: np.ndarray, first: np.ndarray, second: np.ndarray, min_cosine: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """How many vectors each row links with in a group, and a spanning forest of the links.

    The rows `first` are compared with the rows `second`, which are the same or quite others. Two visitors aren't compared.
    """
    one = np.array_equal(first, second)
    counts = np.zeros(len(x), np.int64)
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(first), ROWS_AT_ONCE):
        rows = first[at : at + ROWS_AT_ONCE]
        near = (x[rows] @ x[second].T >= min_cosine) & (home[rows][:, None] | home[second][None, :])
        if one:
            near &= rows[:, None] < second[None, :]
        i, j = np.nonzero(near)
        np.add.at(counts, rows[i], many[second[j]])
        np.add.at(counts, second[j], many[rows[i]])
        parts.append(_spanning(rows[i], second[j]))
    a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    return counts, _forest(a, b)


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links of a distance table's rows, fewer if they are many: a forest of them."""
    if len(a) < 4096:
        return a, b
    kept = np.array(_forest(a, b)).reshape(-1, 2)
    return kept[:, 0], kept[:, 1]


def _link(min_cosine: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        node, many = table.column("node").to_numpy(), table.column("many").to_numpy()
        chunk = table.column("chunk").to_numpy()
        first, second = (np.flatnonzero(chunk == table.column(c)[0].as_py()) for c in ("i", "j"))
        counts, forest = link_group(_matrix(table.column("unit").combine_chunks()), many, table.column("home").to_numpy(), first, second, min_cosine)
        some = np.flatnonzero(counts)
        a, b = (np.array([f[k] for f in forest], np.int64) for k in (0, 1))
        return pa.table(
            {
                "a": pa.array(np.concatenate((node[some], node[a])), pa.int64()),
                "b": pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[b], pa.int64())]),
                "links": pa.concat_arrays([pa.array(counts[some], pa.int64()), pa.nulls(len(a), pa.int64())]),
            }
        )

    return run


def cells(vectors: DataFrame, radius: float) -> DataFrame:
    """(cell, node, many, home, unit, chunk, chunks) of vectors (cell, node, many, unit): parted by pivots as far as that helps."""
    now = vectors.withColumn("home", F.lit(True))
    done = []
    for level in range(LEVELS):
        sizes = now.groupBy("cell").agg(F.count("*").alias("size"))
        large = sizes.filter(F.col("size") > CELL)
        if level == LEVELS - 1 or large.isEmpty():
            break
        draw = F.xxhash64("node", F.lit(level))
        share = F.pmod(draw, F.lit(1 << 20)) * F.col("size") < (1 << 20) * SAMPLE
        sample = now.join(large, "cell").filter(share).select("cell", "node", "home", "unit", draw.alias("draw"))
        judged = common.saved(sample.groupBy("cell").applyInArrow(_judge(radius), "cell string, pivots binary, k bigint").join(large, "cell"), "vectors-pivots")
        split = judged.filter("pivots is not null")
        if split.isEmpty():
            break
        # a large cell's rows are dealt to several tasks, each of which gets the pivots first
        tasks = F.ceil(F.col("size") / (8 * CELL)).cast("int")
        of = now.join(split, "cell").select("cell", F.pmod(F.xxhash64("node"), tasks).cast("int").alias("task"), F.lit(1).alias("kind"), "node", "many", "home", "unit")
        heads = split.select(
            "cell", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), F.lit(0).alias("kind"), F.col("k").alias("node"), F.lit(0).cast("long").alias("many"), F.lit(False).alias("home"), F.col("pivots").alias("unit")
        )
        stream = heads.unionByName(of).repartition("cell", "task").sortWithinPartitions("cell", "task", "kind")
        parted = common.map_batches(stream, partial(_part, radius), "cell string, node bigint, many bigint, home boolean, unit binary")
        done.append(now.join(split.select("cell"), "cell", "left_anti"))
        now = common.saved(parted, "vectors-cells")
        # a cell without a row at home has no pair
        now = now.join(now.filter("home").select("cell").distinct(), "cell", "left_semi")
    for d in done:
        now = now.unionByName(d)
    sizes = now.groupBy("cell").agg(F.count("*").alias("size"))
    chunks = F.ceil(F.col("size") / CELL).cast("int")
    return now.join(sizes, "cell").select("cell", "node", "many", "home", "unit", F.pmod(F.xxhash64("node", F.lit(-1)), chunks).cast("int").alias("chunk"), chunks.alias("chunks"))


def near_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    units = common.add_columns(vectors.select("vec_id", "embedding", "label"), "unit binary, digest binary", _units)
    rows = common.saved(units.drop("embedding"), "vectors-units")
    comparable = rows.filter("unit is not null and label is not null")
    folded = comparable.groupBy("label", F.octet_length("unit").alias("bytes"), "digest").agg(F.count("*").alias("many"), F.min("vec_id").alias("least"), F.any_value("unit").alias("unit"))
    nodes = common.saved(folded.withColumn("node", F.monotonically_increasing_id()), "vectors-nodes")
    cell = F.concat_ws("/", F.col("label").cast("string"), F.col("bytes").cast("string"))
    dealt = cells(nodes.select(cell.alias("cell"), "node", "many", "unit"), sqrt(2 - 2 * min_cosine))
    others = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(F.col("chunk"), j).alias("i"), F.greatest(F.col("chunk"), j).alias("j")))
    groups = dealt.select("cell", "node", "many", "home", "unit", "chunk", F.explode(others).alias("p")).select("cell", "p.i", "p.j", "node", "many", "home", "unit", "chunk")
    found = common.saved(groups.groupBy("cell", "i", "j").applyInArrow(_link(min_cosine), "a bigint, b bigint, links bigint"), "vectors-links")
    links = found.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    parts = components(found.filter("b is not null").select("a", "b"))
    named = common.saved(nodes.drop("unit").join(links, "node", "left").join(parts, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "vectors-named")
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    of = named.join(least, "comp").select("label", "bytes", "digest", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = rows.withColumn("bytes", F.octet_length("unit")).join(of, ["label", "bytes", "digest"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
