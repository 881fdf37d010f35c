"""Dialogue segments by speaker: export rows, summaries, totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from montage.functions.scalars import clean_text, clock, padded

def cut_intervals(segments: DataFrame) -> DataFrame:
    start, length = padded(F.col("start"), F.col("end"))
    return segments.select("media_id", "seg_index", F.round(start, 4).alias("cut_start"), F.round(length, 4).alias("cut_duration"), F.format_string("segment_%04d", F.col("seg_index")).alias("name"))


def cleaned(segments: DataFrame) -> DataFrame:
    rows = segments.withColumn("text", clean_text(F.col("text")))
    return rows.filter(F.col("text") != "").select("media_id", "seg_index", "text")


def exported(segments: DataFrame) -> DataFrame:
    """One row per file to write: numbered from 0 per speaker by start."""
    number = F.row_number().over(Window.partitionBy("media_id", "speaker").orderBy("start", "seg_index")) - 1
    name = F.format_string("%s_%03d", F.col("speaker"), number)
    return segments.select("media_id", "speaker", "seg_index", name.alias("file"), F.round(F.col("end") - F.col("start"), 4).alias("duration"))


def summary(segments: DataFrame) -> DataFrame:
    """Per speaker: segments, seconds, mean, the first three texts, how many more, total as a clock."""
    length = F.col("end") - F.col("start")
    place = F.row_number().over(Window.partitionBy("media_id", "speaker").orderBy("start", "seg_index"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", "text")))), lambda s: s["text"])
    rows = segments.withColumn("place", place).groupBy("media_id", "speaker").agg(
        F.count(F.lit(1)).alias("segments"), F.round(F.sum(length), 4).alias("seconds"), F.round(F.avg(length), 4).alias("mean_seconds"), texts.alias("texts")
    )
    return rows.select(
        "media_id", "speaker", "segments", "seconds", "mean_seconds", F.array_join("texts", " / ").alias("first_texts"),
        F.greatest(F.lit(0), F.col("segments") - 3).cast("long").alias("more"), clock(F.col("seconds")).alias("clock"),
    )


def rollup(segments: DataFrame) -> DataFrame:
    """Per speaker over all media, and a total row whose speaker is `(all)`."""
    rows = segments.rollup("speaker").agg(F.count(F.lit(1)).alias("segments"), F.round(F.sum(F.col("end") - F.col("start")), 3).alias("seconds"), F.grouping("speaker").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "(all)").otherwise(F.col("speaker")).alias("speaker"), "segments", "seconds")


def totals(segments: DataFrame) -> DataFrame:
    """Per media: speakers, segments, seconds, mean segments of a speaker."""
    speakers, rows = F.count_distinct("speaker"), F.count(F.lit(1))
    return segments.groupBy("media_id").agg(
        speakers.alias("speakers"), rows.alias("segments"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"), F.round(rows / speakers, 4).alias("mean_segments")
    )
