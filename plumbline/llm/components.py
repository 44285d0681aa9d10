"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a < b.

    Large star: each node's larger neighbours go to the smallest of the node and its neighbours.
    Small star: each node and its smaller neighbours go to the smallest of them.
    """
    if large:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        linked = down.join(least, "u").where("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        out = linked.union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return out.where("a < b").distinct()


def _is_forest(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: each b hangs on one a, and no a hangs on another."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("below")), F.struct(F.col("b").alias("id"), F.lit(1).alias("below")))).alias("e"))
    seen = ends.groupBy("e.id").agg(F.sum("e.below").alias("below"), F.min("e.below").alias("least"))
    return seen.where("below > 1 OR (below = 1 AND least = 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id and component (its smallest id) of every node that has an edge; edges are (a, b), a < b.

    Each round is written to the shared folder.  The rounds grow with the logarithm of the
    longest chain; it ends when all edges are stars around their smallest node.

    Defined results: repeated edges count once, edges with a null or with a >= b are left out, and an empty table gives an empty result.
    """
    now = saved(edges.where("a < b").select("a", "b").distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    while not _is_forest(now):
        now = saved(_star(_star(now, large=True), large=False), "edges")
    leaves = now.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return leaves.union(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
