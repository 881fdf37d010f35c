"""Written results: folders by speaker, summaries, reports. Every file is written by Spark tasks.

Writers fail if the folder exists. The text of one media is one row, so media are the unit that must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from montage.functions.scalars import clock, preview

RULE = "-" * 50


def write_speakers(segments: DataFrame, path: str) -> None:
    """Text of each segment in folders media_id=/speaker=; by speaker and start inside."""
    ordered = segments.repartition("media_id", "speaker").sortWithinPartitions("media_id", "speaker", "start", "seg_index")
    ordered.write.partitionBy("media_id", "speaker").parquet(path)


def export_info(segments: DataFrame) -> DataFrame:
    """One row per media: total_segments, total_duration and a map of speakers to their files and texts by start."""
    seconds = F.round(F.col("end") - F.col("start"), 4)
    number = F.row_number().over(Window.partitionBy("media_id", "speaker").orderBy("start", "seg_index")) - 1
    rows = segments.withColumns({"file": F.format_string("%s_%03d", F.col("speaker"), number), "seconds": seconds})
    files = F.array_sort(F.collect_list(F.struct("start", "seg_index", "end", "file", "text")))
    of = rows.groupBy("media_id", "speaker").agg(F.count(F.lit(1)).alias("segment_count"), F.round(F.sum("seconds"), 4).alias("total_duration"), files.alias("files"))
    entry = F.struct("speaker", F.struct("segment_count", "total_duration", "files"))
    whole = of.groupBy("media_id").agg(
        F.sum("segment_count").alias("total_segments"), F.round(F.sum("total_duration"), 4).alias("total_duration"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("speakers")
    )
    return whole


def _lines(*parts: Column) -> Column:
    return F.concat_ws("\n", *parts)


def speaker_text(segments: DataFrame) -> DataFrame:
    """media_id, value: a block per speaker with up to three sample texts, then the totals."""
    length = F.col("end") - F.col("start")
    place = F.row_number().over(Window.partitionBy("media_id", "speaker").orderBy("start", "seg_index"))
    texts = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", preview(F.col("text")).alias("text"))))), lambda s: s["text"])
    of = segments.withColumn("place", place).groupBy("media_id", "speaker").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(length), 4).alias("seconds"), texts.alias("texts"))
    samples = F.transform("texts", lambda t, i: F.concat(F.lit("    "), (i + 1).cast("string"), F.lit(". "), t))
    block = _lines(
        F.concat(F.col("speaker"), F.lit(":")), F.format_string("  segments: %d", F.col("n")), F.concat(F.lit("  duration: "), clock(F.col("seconds"))),
        F.format_string("  mean: %.2f s", F.round(F.col("seconds") / F.col("n"), 4)), samples, F.when(F.col("n") > 3, F.format_string("    ... %d more", F.col("n") - 3)),
    )
    whole = of.withColumn("block", block).groupBy("media_id").agg(
        F.count(F.lit(1)).alias("speakers"), F.sum("n").alias("n"), F.round(F.sum("seconds"), 4).alias("seconds"), F.array_sort(F.collect_list(F.struct("speaker", "block"))).alias("blocks")
    )
    total = _lines(
        F.lit(RULE), F.format_string("speakers: %d", F.col("speakers")), F.format_string("segments: %d", F.col("n")), F.concat(F.lit("duration: "), clock(F.col("seconds"))),
        F.format_string("segments per speaker: %.1f", F.col("n") / F.col("speakers")),
    )
    return whole.select("media_id", F.concat_ws("\n\n", F.transform("blocks", lambda b: b["block"]), total).alias("value"))


def keyframe_text(rows: DataFrame) -> DataFrame:
    """media_id, value: keyframes by shot, with time, confidence, method and cluster."""
    line = F.format_string(
        "  %s  %.2f s  %.3f  %s  cluster %d", F.col("filename"), F.col("timestamp"), F.col("confidence"), F.col("selection_method"), F.col("cluster_id")
    )
    of = rows.groupBy("media_id", "shot_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("frame_idx", line.alias("line")))).alias("lines"))
    block = _lines(F.format_string("shot %d (%d keyframes):", F.col("shot_id"), F.col("n")), F.transform("lines", lambda s: s["line"]))
    whole = of.withColumn("block", block).groupBy("media_id").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("shot_id", "block"))).alias("blocks"))
    return whole.select("media_id", F.concat_ws("\n\n", F.format_string("keyframes: %d", F.col("n")), F.transform("blocks", lambda b: b["block"])).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """`value` of each row in folders media_id=."""
    rows.select("media_id", "value").write.partitionBy("media_id").text(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_metadata(rows: DataFrame, path: str) -> None:
    """A JSON object per media, its keyframes by frame."""
    fields = [c for c in rows.columns if c not in ("media_id", "frame_idx")]
    rows.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", *fields))).alias("keyframes")).write.json(path)


def ranked(results: DataFrame) -> DataFrame:
    """Sweep results (name, keyframes, confidence, success) as lines of a table, successful runs by keyframes, then name.

    A sweep has as many rows as configurations were tried, so one ordered window serves.
    """
    rank = F.row_number().over(Window.orderBy(F.col("keyframes").desc(), "name"))
    line = F.format_string("| %d | %s | %d | %.3f |", F.col("rank"), F.col("name"), F.col("keyframes"), F.col("confidence"))
    return results.filter("success").withColumn("rank", rank).select("rank", line.alias("value"))
