"""Helpers shared by the corpus operators: free column names, shared-folder checkpoints, packaging."""

from __future__ import annotations

import os
import re
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the counting rules: everything but the six ASCII white-space characters.
BLANK = r"\x20\x09-\x0D"
#: Upper and lower case of the 26 ASCII letters; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names made from `names` that `df` does not use yet (compared without case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        fresh = f"m_{name}"
        while fresh.lower() in used:
            fresh += "_"
        used.add(fresh.lower())
        out.append(fresh)
    return out


def quoted(name: str) -> Column:
    """A top-level column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(column: str | Column) -> Column:
    """The text of a column; null counts as empty."""
    return F.coalesce(quoted(column) if isinstance(column, str) else column, F.lit("")).cast("string")


def ascii_lower(column: Column) -> Column:
    """A-Z in lower case, other letters as they are; `lower` where all characters are ASCII, as it is the faster."""
    return F.when(F.octet_length(column) == F.char_length(column), F.lower(column)).otherwise(F.translate(column, UPPER, LOWER))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a fresh local one only where none is set and all work is local, as in tests.

    A cluster without that setting raises ValueError: its executors share no temporary folder.
    """
    sc = spark.sparkContext
    if (set_to := sc.getConf().get("spark.checkpoint.dir")) is not None:
        return set_to
    if sc.getCheckpointDir() is None:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder and read them from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started from."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: A key that holds at least this part of all rows is hot: there are at most as many such keys as its inverse.
HOT_PART = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, count: str) -> DataFrame:
    """`rows` with the columns of `groups`, one row per key; `count` is the number of rows that share the key.

    The rows of hot keys meet their groups by broadcast (1000 groups at most) and are not shuffled; the others are joined
    by key. Null keys meet each other. Both tables are read twice, so they should be settled.
    """
    (other,) = free(rows, "other")
    total = groups.agg(F.coalesce(F.sum(count), F.lit(0)).alias("n")).first()["n"]
    named = groups.withColumnRenamed(key, other)
    hot = named.filter(F.col(count) >= max(2, total * HOT_PART))
    met = F.col(key).eqNullSafe(F.col(other))
    dense = rows.join(F.broadcast(hot), met).drop(other)
    rest = rows.join(F.broadcast(hot.select(other)), met, "left_anti").join(named.filter(F.col(count) < max(2, total * HOT_PART)), met).drop(other)
    return dense.unionByName(rest)
