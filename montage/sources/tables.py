"""Media views over the test tables: frames, motion series and subtitle segments, keyed by media_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from montage.operators.stretches import STRETCH, running


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, frame_idx (from 0), clip: a video per label."""
    rows = read(spark, sf_dir, "embeddings").select(F.col("label").alias("media_id"), "vec_id", F.col("embedding").alias("clip"))
    return running(rows, "media_id", F.floor(F.col("vec_id") / STRETCH), ["vec_id"], F.lit(1), "frame_idx").select("media_id", "frame_idx", "clip")


def motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, idx (from 0), score: a series per user."""
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), "ts", "event_id", F.col("value").alias("score"))
    # times are without a zone, so that no hour comes twice
    hour = F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")
    return running(rows, "media_id", hour, ["ts", "event_id"], F.lit(1), "idx").select("media_id", "idx", "score")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, seg_index, start, end (seconds), text, speaker: a tenth of a second per character."""
    rows = read(spark, sf_dir, "conversations").withColumn("chars", F.length("text"))
    rows = running(rows, "conv_id", F.floor(F.col("turn") / STRETCH), ["turn"], F.col("chars"), "before")
    start = F.col("before") / 10
    return rows.select(
        F.col("conv_id").alias("media_id"), F.col("turn").alias("seg_index"), start.alias("start"), (start + F.col("chars") / 10).alias("end"), "text", F.col("role").alias("speaker")
    )
