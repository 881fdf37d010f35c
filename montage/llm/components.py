"""Connected components of a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """pairs: both directions, (u, v). Links each vertex's larger (or other) neighbours to its smallest one."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = pairs.join(least, F.col("u") == F.col("w"))
    if large:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return joined.select(F.col("v").alias("a"), F.col("m").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of `edges` (a, b: long), the component being its smallest vertex.

    Each round takes two aggregates and two joins; rounds grow with the logarithm of the diameter. Neighbourhoods are
    never gathered. Each round is written to the checkpoint folder, so a lost executor costs one round at most. Loops and
    repeated edges do no harm; no edges give no rows.
    """
    now = settle(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if seen["n"] == 0 or (seen["n"], seen["s"]) == mark:
            break
        mark = (seen["n"], seen["s"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        wide = _star(both, True).filter(F.col("a") != F.col("b")).distinct()
        # after it each edge points from a vertex to a smaller one; link the smaller neighbours and the vertex to the least
        down = wide.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = _star(down, False).union(down.groupBy("u").agg(F.min("v").alias("m")).select("u", "m"))
        now = settle(near.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    # every vertex now hangs on the smallest one
    tips = now.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("component"))
    return tips.union(tips.select("component", "component").distinct())
