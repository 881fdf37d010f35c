"""Windows over a series of scores: smoothing, peaks, rolling scores, picks.

A series has columns media_id, idx and score; idx counts a media's rows from 0, without gaps. Windows hold a stretch of a
media, never all of it; what is of a whole media (its size, a percentile) is an aggregate that is joined to its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from montage.operators.stretches import beside, overlapping, within

# Quadratic least-squares weights over five points, for the inside and the first two places.
SMOOTH = (-3, 12, 17, 12, -3)
EDGE = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5))


def sizes(series: DataFrame) -> DataFrame:
    """media_id, n."""
    return series.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))


def smoothed(series: DataFrame) -> DataFrame:
    """media_id, idx, smooth: quadratic smoothing over five points; series of under five stay as they are."""
    at = lambda k: F.lag("score", -k).over(within())

    def weighted(weights: tuple[int, ...], first: int, turn: int) -> Column:
        return sum((w * at(turn * (k - first)) for k, w in enumerate(weights)), F.lit(0.0)) / 35

    i, j = F.col("idx"), F.col("n") - 1 - F.col("idx")
    value = F.when(F.col("n") < 5, F.col("score"))
    for k in (0, 1):
        value = value.when(i == k, weighted(EDGE[k], k, 1)).when(j == k, weighted(EDGE[k], k, -1))
    value = value.otherwise(weighted(SMOOTH, 2, 1))
    rows = overlapping(beside(series.select("media_id", "idx", "score"), sizes(series)), len(SMOOTH) - 1)
    return rows.withColumn("smooth", F.round(value, 6)).filter("own").select("media_id", "idx", "smooth")


def _tips(rows: DataFrame, score: str) -> DataFrame:
    """Rows above both neighbours, with tip true, and the first and last ones of their media."""
    before, after = F.lag(score).over(within()), F.lead(score).over(within())
    met = overlapping(rows, 1).withColumns({"before": before, "after": after}).filter("own")
    tip = F.coalesce((F.col(score) > F.col("before")) & (F.col(score) > F.col("after")), F.lit(False))
    return met.withColumn("tip", tip).filter(F.col("tip") | F.col("before").isNull() | F.col("after").isNull()).select("media_id", "idx", score, "tip")


def peaks(series: DataFrame, share: float = 0.7) -> DataFrame:
    """Places of smoothed scores above both neighbours and at least at the percentile `share`; all of under three."""
    rows = smoothed(series)
    whole = rows.groupBy("media_id").agg(F.percentile("smooth", F.lit(share)).alias("low"), F.count(F.lit(1)).alias("n"))
    met = beside(_tips(rows, "smooth"), whole)
    return met.filter((F.col("n") < 3) | (F.col("tip") & (F.col("smooth") >= F.col("low")))).select("media_id", "idx", "smooth")


def raw_peaks(series: DataFrame, share: float = 0.75) -> DataFrame:
    """Places of plain scores above both neighbours and above the percentile `share`."""
    whole = series.groupBy("media_id").agg(F.percentile("score", F.lit(share)).alias("high"))
    met = beside(_tips(series.select("media_id", "idx", "score"), "score").filter("tip"), whole)
    return met.filter(F.col("score") > F.col("high")).select("media_id", "idx", "score")


def spaced_peaks(series: DataFrame) -> DataFrame:
    """Peaks that keep a distance: the highest first, lower ones strictly nearer than max(3, n / 20) are dropped.

    Series without a peak at the 70th percentile try the median with a distance of max(2, n / 30). Of equal peaks the
    earlier is kept. Series of under three keep all their places. Series with scores that are no numbers cannot be
    smoothed: they give their raw_peaks, whatever the distance. The peaks of one series fit a row.
    """
    odd = F.bool_or(F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf")))
    known = series.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), odd.alias("odd"))
    n, rough = known.filter(~F.col("odd")).drop("odd"), known.filter("odd").select("media_id")
    high, low = (
        peaks(series, share).join(n, "media_id").groupBy("media_id", "n").agg(F.collect_list(F.struct((-F.col("smooth")).alias("depth"), "idx")).alias("found"))
        for share in (0.7, 0.5)
    )

    def kept(found: DataFrame, least: int, part: int) -> DataFrame:
        apart = F.when(F.col("n") < 3, 0).otherwise(F.greatest(F.lit(least), F.floor(F.col("n") / part)))
        places = F.transform(F.array_sort("found"), lambda p: p["idx"].cast("long"))
        fits = lambda have, x: ~F.exists(have, lambda k: F.abs(k - x) < F.col("apart"))
        chosen = F.aggregate(places, F.array().cast("array<long>"), lambda have, x: F.when(fits(have, x), F.concat(have, F.array(x))).otherwise(have))
        return found.withColumn("apart", apart).select("media_id", F.explode(chosen).alias("idx"))

    plain = raw_peaks(series.join(rough, "media_id", "left_semi")).select("media_id", F.col("idx").cast("long").alias("idx"))
    return kept(high, 3, 20).union(kept(low.join(high, "media_id", "left_anti"), 2, 30)).union(plain)


def pattern_changes(series: DataFrame) -> DataFrame:
    """media_id, idx, kind: turns of the slope by over 0.5, peaks above 0.8 and valleys after over 1.0.

    The first and last two rows of a series never count. A row may be of two kinds and is then given twice.
    """
    now, b, a = F.col("score"), F.col("b"), F.col("a")
    rows = overlapping(series.select("media_id", "idx", "score"), 1)
    rows = rows.withColumns({"b": F.lag("score").over(within()), "a": F.lead("score").over(within())}).filter("own")
    turn = F.when(F.abs((now - b) - (a - now)) > 0.5, F.lit("turn"))
    tip = F.when((now > b) & (now > a) & (now > 0.8), F.lit("peak")).when((now < b) & (now < a) & (b > 1.0), F.lit("valley"))
    found = rows.select("media_id", "idx", F.explode(F.array_compact(F.array(turn, tip))).alias("kind"))
    return beside(found, sizes(series)).filter((F.col("idx") >= 2) & (F.col("idx") < F.col("n") - 2)).select("media_id", "idx", "kind")


def rolling(series: DataFrame) -> DataFrame:
    """media_id, idx, rolled: the score plus the deviation of the five around it, fewer at the ends."""
    around = F.stddev_pop("score").over(within().rowsBetween(-2, 2))
    rows = overlapping(series.select("media_id", "idx", "score"), 2).withColumn("rolled", F.round(F.col("score") + around, 6))
    return rows.filter("own").select("media_id", "idx", "rolled")


def uniform_pick(series: DataFrame, most: int = 3) -> DataFrame:
    """Up to `most` evenly spaced rows of each series, places cut to whole numbers."""
    rows = beside(series, sizes(series)).withColumn("k", F.least("n", F.lit(most)))
    wanted = F.transform(F.sequence(F.lit(0), F.col("k").cast("int") - 1), lambda i: F.floor(i * (F.col("n") - 1) / F.greatest(F.col("k") - 1, F.lit(1))))
    return rows.filter(F.array_contains(wanted, F.col("idx").cast("long"))).select("media_id", "idx", "score")


def candidates(series: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Distinct places of both ends, thirds of series of over five, peaks, and fifths where those are under three.

    `found` (media_id, idx) may stand in for the plain peaks.
    """
    rows = beside(series.select("media_id", "idx"), sizes(series))
    n, r = F.col("n"), F.col("idx")
    ends = (r == 0) | (r == n - 1) | ((n > 5) & ((r == F.floor(n / 3)) | (r == F.floor(2 * n / 3))))
    some = rows.filter(ends).select("media_id", "idx").union((peaks(series) if found is None else found).select("media_id", "idx")).distinct()
    fifth = F.floor(n / 5)
    more = rows.join(some.groupBy("media_id").agg(F.count(F.lit(1)).alias("have")), "media_id").filter(
        (F.col("have") < 3) & (n > 3) & (r > 0) & (r % F.greatest(fifth, F.lit(1)) == 0) & (r <= 4 * fifth)
    )
    return some.union(more.select("media_id", "idx")).distinct()


def sampled(rows: DataFrame, bucket: Column, key: Column, k: int) -> DataFrame:
    """k rows of each bucket in the order of the digest of `key`."""
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.md5(key.cast("string")), key))
    return rows.withColumn("bucket", bucket).withColumn("rank", rank).filter(F.col("rank") <= k)
