"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(pairs: DataFrame, small: bool) -> DataFrame:
    """One star round over pairs (u, v): every v is hung under the least member of u's neighbourhood."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = pairs.join(low, "u")
    if small:
        return hung.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()
    return hung.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, comp) for every node of edges (a, b); comp is the least node reachable.

    Each round is a handful of group-bys over pairs and shrinks every path by a factor; the pairs are written
    to the shared folder between rounds, so neither the plan nor the lineage grows.
    """
    now = common.saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc-pairs")
    for _ in range(max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = common.saved(_star(both, small=False), "cc-large")
        new = common.saved(_star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), small=True), "cc-small")
        settled = new.join(now, ["a", "b"], "left_anti").isEmpty() and now.join(new, ["a", "b"], "left_anti").isEmpty()
        common.discard(large, now)
        now = new
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
