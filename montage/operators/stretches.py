"""Windows and running sums along one media that are many tasks, however many rows the media has.

A media's rows are cut into stretches by their place. What a row needs of its neighbours is found inside its stretch; rows
near the ends of a stretch meet those of the next one, either as copies (`overlapping`, for places without gaps) or in a
second window that holds the ends alone (`along`, for any places).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Places of a stretch.
STRETCH = 4096
#: Stretches whose sums are added up in one task.
RUN = 1024


def beside(rows: DataFrame, per_media: DataFrame) -> DataFrame:
    """`rows` with the columns of a table that has one row per media; null is a media like any other."""
    named = per_media.withColumnRenamed("media_id", "media_of")
    return rows.join(named, F.col("media_id").eqNullSafe(F.col("media_of"))).drop("media_of")


def overlapping(rows: DataFrame, reach: int, place: str = "idx") -> DataFrame:
    """`rows` plus stretch and own: each row in its stretch, and as a copy (own false) in one whose end is within `reach` rows.

    Places count a media's rows without gaps. Windows over `within` then see, for rows that are their own, every
    neighbour up to `reach` away.
    """
    at, off = F.floor(F.col(place) / STRETCH), F.pmod(F.col(place), F.lit(STRETCH))
    every = F.array_compact(F.array(at, F.when(off < reach, at - 1), F.when(off >= STRETCH - reach, at + 1)))
    return rows.withColumn("stretch", F.explode(every)).withColumn("own", F.col("stretch") == at)


def within(place: str = "idx") -> WindowSpec:
    return Window.partitionBy("media_id", "stretch").orderBy(place)


def along(rows: DataFrame, place: str, reach: int, made: Callable[[WindowSpec], dict[str, Column]]) -> DataFrame:
    """`rows` plus the columns that `made` gives for a window of a media in the order of `place`, whose values differ.

    These may look at rows up to `reach` before or after. One window holds a stretch; a second one, of the whole media,
    holds the 2 * reach rows at either end of its stretches, and decides for the outer half of these.
    """
    cut = Window.partitionBy("media_id", "stretch_at")
    first, n = F.row_number().over(cut.orderBy(place)), F.count(F.lit(1)).over(cut)
    placed = rows.withColumn("stretch_at", F.floor(F.col(place) / STRETCH)).withColumns({"from_start": first, "from_end": n - first + 1})
    near = lambda k: (F.col("from_start") <= k) | (F.col("from_end") <= k)
    middle = placed.withColumns(made(cut.orderBy(place))).filter(~near(reach))
    ends = placed.filter(near(2 * reach)).withColumns(made(Window.partitionBy("media_id").orderBy(place))).filter(near(reach))
    return middle.unionByName(ends).drop("stretch_at", "from_start", "from_end")


def running(rows: DataFrame, key: str, stretch: Column, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """`rows` plus `name` (long): the sum of `value`, null counting as 0, over the rows of its key that come before it.

    `stretch` is a whole number that never falls along `order`, in which no two rows of a key are equal. Sums are taken
    inside stretches, over runs of RUN stretches, and over these.
    """
    cut, own, run = f"{name}_cut", f"{name}_own", F.floor(F.col("cut") / RUN)
    lowest = F.lit(-(1 << 50))
    placed = rows.withColumns({cut: F.coalesce(stretch.cast("long"), lowest), own: F.coalesce(value.cast("long"), F.lit(0))})
    upto = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy(F.col(key).alias("key_of"), F.col(cut).alias("cut")).agg(F.sum(own).alias("t")).withColumn("run", run)
    runs = sums.groupBy(F.col("key_of").alias("key_run"), F.col("run").alias("run_of")).agg(F.sum("t").alias("t"))
    runs = runs.select("key_run", "run_of", upto(Window.partitionBy("key_run").orderBy("run_of"), "t").alias("outer"))
    sums = sums.withColumn("inner", upto(Window.partitionBy("key_of", "run").orderBy("cut"), "t"))
    starts = sums.join(runs, F.col("key_of").eqNullSafe(F.col("key_run")) & (F.col("run") == F.col("run_of"))).select("key_of", "cut", (F.col("inner") + F.col("outer")).alias("start_of"))
    inside = placed.withColumn(own, upto(Window.partitionBy(key, cut).orderBy(*order), own))
    out = inside.join(starts, F.col(key).eqNullSafe(F.col("key_of")) & (F.col(cut) == F.col("cut")))
    return out.select(*rows.columns, (F.col(own) + F.col("start_of")).alias(name))
