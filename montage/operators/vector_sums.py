"""Aggregates of vectors by component, in one pass and without a row per component.

Each component is an aggregate of its own, so tasks combine before the shuffle, and a group of any size is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def width_of(rows: DataFrame, vector: str) -> int:
    """Components of the longest vector; one small job."""
    return rows.agg(F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("n")).first()["n"]


def by_component(width: int, of: Callable[[int], Column]) -> Column:
    """An array of aggregates, one for each of `width` components; those without a value are left out."""
    return F.filter(F.array(*(of(i) for i in range(width))), lambda x: x.isNotNull()) if width else F.array().cast("array<double>")


def component(vector: str, i: int) -> Column:
    return F.get(F.col(vector), F.lit(i)).cast("double")


def means(rows: DataFrame, keys: Sequence[str], vector: str, width: int | None = None) -> DataFrame:
    """keys, n, mean: the mean of each component over the rows that have it."""
    width = width_of(rows, vector) if width is None else width
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), by_component(width, lambda i: F.avg(component(vector, i))).alias("mean"))


def statistics(rows: DataFrame, keys: Sequence[str], vector: str, order: str, width: int | None = None) -> DataFrame:
    """keys, n, mean, deviation, mean_delta: per component the mean, the population deviation and the mean step to the next row.

    Rows follow each other by `order`, which no two rows of a group share; as steps add up to the way from the first row
    to the last, no row has to meet the one before. A group of one row has steps of 0.
    """
    width = width_of(rows, vector) if width is None else width
    n = F.count(F.lit(1))

    def delta(i: int) -> Column:
        x = component(vector, i)
        return F.when(n > 1, (F.max_by(x, order) - F.min_by(x, order)) / (n - 1)).otherwise(F.when(F.count(x) > 0, 0.0))

    return rows.groupBy(*keys).agg(
        n.alias("n"), by_component(width, lambda i: F.avg(component(vector, i))).alias("mean"),
        by_component(width, lambda i: F.stddev_pop(component(vector, i))).alias("deviation"), by_component(width, delta).alias("mean_delta"),
    )
