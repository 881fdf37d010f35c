"""Rows by their place: distributed row numbers, and joins of tables that share no key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from montage.plans.checkpoints import settled


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """`rows` with their number (long, from 0) in the order in which they stand; sort them before if it is to be another.

    Rows are written once, so that their order holds, and numbered inside their partitions; what stands before a partition
    is told by the partitions' counts, of which a row each reaches the driver. Nothing is shuffled.
    """
    part, inside = f"{name}_part", f"{name}_inside"
    kept = settled(rows)
    # monotonically_increasing_id is the partition's number, then 33 bits of the row's number in it
    id_ = F.monotonically_increasing_id()
    placed = kept.withColumns({part: F.shiftright(id_, 33), inside: id_.bitwiseAND(F.lit((1 << 33) - 1))})
    before, n = [], 0
    for number, last in sorted(map(tuple, placed.groupBy(part).agg(F.max(inside)).collect())):
        before.append((number, n))
        n += last + 1
    starts = rows.sparkSession.createDataFrame(before, f"{part} long, {name}_before long")
    return placed.join(F.broadcast(starts), part).select(*rows.columns, (F.col(inside) + F.col(f"{name}_before")).alias(name))


def zipped(left: DataFrame, right: DataFrame, name: str = "place") -> DataFrame:
    """The n-th row of `left` beside the n-th of `right`, with their number; the longer table's other rows are left out."""
    return numbered(left, name).join(numbered(right, name), name)
