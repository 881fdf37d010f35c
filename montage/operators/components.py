"""Connected components inside media, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from montage.plans.checkpoints import settled

KEY = "media_id"


def _star(both: DataFrame, large: bool) -> DataFrame:
    """Edges in both directions (u, v): links each vertex's larger (or all its) neighbours to the smallest of it and them."""
    least = both.groupBy(KEY, "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, [KEY, "u"])
    return met.filter(F.col("v") > F.col("u")).select(KEY, "v", "m") if large else met.select(KEY, "v", "m")


def _edges(pairs: DataFrame) -> DataFrame:
    """Distinct edges (a > b) of pairs of any order."""
    x, y = (c for c in pairs.columns if c != KEY)
    return pairs.filter(F.col(x) != F.col(y)).select(KEY, F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """media_id, v, label of all vertices of `pairs` (media_id, a, b): the smallest vertex that each hangs together with.

    A round is one job: it is written to the checkpoint folder while its edges' number and digest are observed; rounds end
    when these stay. They grow with the logarithm of the longest chain; neighbourhoods are never gathered.
    """
    now, mark = _edges(pairs.select(KEY, "a", "b")), None
    while True:
        seen = Observation()
        digest = F.sum(F.xxhash64(KEY, "a", "b").cast("decimal(38,0)"))
        now = settled(now.observe(seen, F.count(F.lit(1)).alias("n"), digest.alias("digest")))
        found = (seen.get["n"], seen.get["digest"])
        if found[0] == 0 or found == mark:
            break
        mark = found
        both = now.select(KEY, F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(KEY, "b", "a"))
        wide = _edges(_star(both, True))
        # each vertex now looks at smaller ones only: link these and itself to the smallest
        down = wide.select(KEY, F.col("a").alias("u"), F.col("b").alias("v"))
        now = _edges(_star(down, False).union(down.groupBy(KEY, "u").agg(F.min("v").alias("m"))))
    tips = now.groupBy(KEY, F.col("a").alias("v")).agg(F.min("b").alias("label"))
    return tips.union(tips.select(KEY, "label", "label").distinct())
