"""Connected components over an edge table, by alternating large-star and small-star steps.

Labels never reach the driver. Each step reduces to one minimum per node, which combines before
the shuffle, and a join whose two sides are written tables, so that Spark can split a hub's rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b, written; what it read is deleted."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    both = staged(both, "arcs")
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    near = both.join(least, "u")
    if large:
        stars = near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        stars = near.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = staged(stars.where("a <> b").distinct(), "edges")
    drop(edges, both, least)
    return out


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b); component: the smallest node reachable.

    Loops, repeated edges and either direction are accepted; nulls are dropped. Nodes without an
    edge are not returned. Raises if ``max_rounds`` rounds do not settle the labels.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = staged(now, "edges"), None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = tuple(mark)
        for large in (True, False):
            now = _star(now, large)
    raise RuntimeError("components did not settle")
