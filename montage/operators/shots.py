"""Shot boundaries: change scores of consecutive rows, adaptive thresholds, a minimum gap, intervals, confidences.

Windows over frames hold a stretch of a media (`stretches`); folds over boundaries and windows over shots hold those of
one media in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from montage.functions.vectors import clamp, cosine, distance, pearson
from montage.operators.stretches import along, overlapping, within

MIN_GAP = 30
#: Frames of a bin in which frames and shots meet, so that one long video is many pieces of work.
BIN = 512


def by_media() -> WindowSpec:
    return Window.partitionBy("media_id")


def with_before(frames: DataFrame) -> DataFrame:
    """media_id, frame_idx, clip, before: each frame with the vector of the one before it, null for the first."""
    return along(frames.select("media_id", "frame_idx", "clip"), "frame_idx", 1, lambda w: {"before": F.lag("clip").over(w)})


def changes(frames: DataFrame) -> DataFrame:
    """media_id, idx, diff: one minus the correlation with the row before; the first row has none."""
    rows = with_before(frames).filter(F.col("before").isNotNull())
    return rows.select("media_id", F.col("frame_idx").alias("idx"), F.round(1 - pearson(F.col("before"), F.col("clip")), 6).alias("diff"))


def deltas(series: DataFrame) -> DataFrame:
    """media_id, idx, diff: absolute first difference of `score`; idx counts a media's rows without gaps."""
    step = F.abs(F.col("score") - F.lag("score").over(within()))
    rows = overlapping(series.select("media_id", "idx", "score"), 1).withColumn("diff", F.round(step, 6))
    return rows.filter(F.col("own") & F.col("diff").isNotNull()).select("media_id", "idx", "diff")


def vector_motion(frames: DataFrame) -> DataFrame:
    """media_id, idx, motion: the distance of each vector to the one before, 0 for the first row."""
    rows = with_before(frames)
    return rows.select("media_id", F.col("frame_idx").alias("idx"), F.round(F.coalesce(distance(F.col("clip"), F.col("before")), F.lit(0.0)), 6).alias("motion"))


#: Sizes of a clip vector and of a colour vector.
CLIP, COLOUR = 512, 64


def all_features(frames: DataFrame, motion: DataFrame, colours: DataFrame | None = None) -> DataFrame:
    """media_id, frame_idx, clip, motion, colour of every frame; zeros where a feature is missing.

    motion: media_id, frame_idx, score; colours: media_id, frame_idx, colour.
    """
    key = ["media_id", "frame_idx"]
    rows = frames.join(motion.select(*key, F.col("score").alias("motion")), key, "left")
    rows = rows.join(colours.select(*key, "colour"), key, "left") if colours is not None else rows.withColumn("colour", F.lit(None).cast("array<double>"))
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return rows.select(*key, F.coalesce("clip", zeros(CLIP)).alias("clip"), F.coalesce("motion", F.lit(0.0)).alias("motion"), F.coalesce("colour", zeros(COLOUR)).alias("colour"))


def histogram_threshold(diffs: DataFrame) -> DataFrame:
    """Mean and 2.5 deviations; the 95th percentile where that lies above the 98th."""
    wide = F.avg("diff") + 2.5 * F.stddev_pop("diff")
    limit = F.when(wide > F.percentile("diff", F.lit(0.98)), F.percentile("diff", F.lit(0.95))).otherwise(wide)
    return diffs.groupBy("media_id").agg(F.round(limit, 6).alias("threshold"))


def flow_threshold(diffs: DataFrame, share: float = 0.95) -> DataFrame:
    return diffs.groupBy("media_id").agg(F.round(F.percentile("diff", F.lit(share)), 6).alias("threshold"))


def spaced(found: Column, gap: int) -> Column:
    """Ascending places that each lie over `gap` after the last one kept, 0 being kept."""
    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.array_sort(found), start, lambda kept, x: F.when(x - F.element_at(kept, -1) > gap, F.concat(kept, F.array(x))).otherwise(kept))


def boundaries(diffs: DataFrame, thresholds: DataFrame, gap: int = MIN_GAP) -> DataFrame:
    """media_id, boundary: 0 and the accepted places."""
    above = F.collect_list(F.when(F.col("diff") > F.col("threshold"), F.col("idx")))
    kept = diffs.join(thresholds, "media_id").groupBy("media_id").agg(spaced(above, gap).alias("kept"))
    return kept.select("media_id", F.explode("kept").alias("boundary"))


def intervals(bounds: DataFrame, totals: DataFrame) -> DataFrame:
    """media_id, shot_id, start_frame, end_frame, duration_frames; the last shot ends at `total`."""
    order = by_media().orderBy("boundary")
    end = F.coalesce(F.lead("boundary").over(order), F.col("total"))
    rows = bounds.join(totals, "media_id").select("media_id", (F.row_number().over(order) - 1).alias("shot_id"), F.col("boundary").alias("start_frame"), end.alias("end_frame"))
    return rows.withColumn("duration_frames", F.col("end_frame") - F.col("start_frame"))


def binned(place: str) -> Column:
    return F.floor(F.col(place) / BIN)


def in_bins(shots: DataFrame) -> DataFrame:
    """A row per shot and bin that it touches."""
    return shots.withColumn("bin", F.explode(F.sequence(binned("start_frame"), binned("end_frame"))))


def confident(shots: DataFrame, diffs: DataFrame) -> DataFrame:
    """Adds confidence: one minus the mean change inside [start, end), 0.5 without any, between 0.1 and 1."""
    scores = diffs.select(F.col("media_id").alias("m"), "idx", "diff", binned("idx").alias("at"))
    inside = (F.col("media_id") == F.col("m")) & (F.col("bin") == F.col("at")) & (F.col("idx") >= F.col("start_frame")) & (F.col("idx") < F.col("end_frame"))
    mean = in_bins(shots).join(scores, inside, "left").groupBy(*shots.columns).agg(F.avg("diff").alias("mean"))
    return mean.withColumn("confidence", F.round(F.coalesce(clamp(1 - F.col("mean"), 0.1, 1.0), F.lit(0.5)), 4)).drop("mean")


def totals(frames: DataFrame) -> DataFrame:
    return frames.groupBy("media_id").agg(F.count(F.lit(1)).alias("total"))


def histogram_shots(frames: DataFrame, gap: int = MIN_GAP) -> DataFrame:
    diffs = changes(frames)
    return confident(intervals(boundaries(diffs, histogram_threshold(diffs), gap), totals(frames)), diffs)


def flow_shots(series: DataFrame, gap: int = MIN_GAP) -> DataFrame:
    diffs = deltas(series)
    found = intervals(boundaries(diffs, flow_threshold(diffs), gap), totals(series))
    return found.withColumn("confidence", F.lit(0.7))


def semantic_changes(frames: DataFrame, least: float = 0.85) -> DataFrame:
    """media_id, frame_idx, similarity of frames whose cosine with the frame before is under `least`."""
    rows = with_before(frames).filter(F.col("before").isNotNull())
    near = rows.select("media_id", "frame_idx", F.round(cosine(F.col("before"), F.col("clip")), 6).alias("similarity"))
    return near.filter(F.col("similarity") < least)


def first_found(totals: DataFrame, *found: tuple[str, DataFrame]) -> DataFrame:
    """The shots of each media by the first method that found any; one shot of the whole at 0.5 where none did.

    `found` names the methods in their order, `totals` (media_id, total) the media.
    """
    columns = ["media_id", "shot_id", "start_frame", "end_frame", "duration_frames", "confidence"]
    whole = totals.select("media_id", F.lit(0).alias("shot_id"), F.lit(0).cast("long").alias("start_frame"), F.col("total").alias("end_frame"), F.col("total").alias("duration_frames"), F.lit(0.5).alias("confidence"))
    rows = whole.withColumns({"method": F.lit("whole"), "turn": F.lit(len(found))})
    for turn, (method, shots) in enumerate(found):
        rows = rows.unionByName(shots.select(*columns).withColumns({"method": F.lit(method), "turn": F.lit(turn)}))
    return rows.withColumn("first", F.min("turn").over(by_media())).filter(F.col("turn") == F.col("first")).select(*columns, "method")


def usable(shots: DataFrame, least: int, most: int) -> DataFrame:
    """Shots of a fitting length; the longest half of a video's shots where none fits.

    The first that remains starts at 0 and the last ends at the video's end; durations stay.
    """
    fit = F.col("duration_frames").between(least, most)
    rank = F.row_number().over(by_media().orderBy(F.col("duration_frames").desc(), "shot_id"))
    rows = shots.withColumns({"fit": fit, "fits": F.count_if(fit).over(by_media()), "rank": rank, "n": F.count(F.lit(1)).over(by_media()), "total": F.max("end_frame").over(by_media())})
    kept = rows.filter(F.when(F.col("fits") > 0, F.col("fit")).otherwise(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("n") / 2))))
    place = F.when(F.col("fits") > 0, F.col("shot_id")).otherwise(F.col("rank"))
    first, last = F.min(place).over(by_media()) == place, F.max(place).over(by_media()) == place
    start, end = F.when(first, 0).otherwise(F.col("start_frame")), F.when(last, F.col("total")).otherwise(F.col("end_frame"))
    return kept.select("media_id", "shot_id", start.cast("long").alias("start_frame"), end.alias("end_frame"), "duration_frames")


def frames_in_shots(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """(media_id, shot_id, frame_idx) with both ends included: a frame on a boundary is in two shots."""
    spans = in_bins(shots.select(F.col("media_id").alias("m"), "shot_id", "start_frame", "end_frame"))
    inside = (F.col("media_id") == F.col("m")) & (F.col("bin") == binned("frame_idx")) & F.col("frame_idx").between(F.col("start_frame"), F.col("end_frame"))
    return frames.select("media_id", "frame_idx").join(spans, inside).select("media_id", "shot_id", "frame_idx")


def nearest_frame(frames: DataFrame, shots: DataFrame) -> DataFrame:
    """The frame nearest to the middle of each shot, the lower of two."""
    middle = F.floor((F.col("start_frame") + F.col("end_frame")) / 2).cast("long")
    none = F.lit(None)
    # an ordered pass over the frames and middles of each bin: the last frame up to a middle and the first one after it
    line = frames.select("media_id", F.col("frame_idx").cast("long").alias("place"), none.cast(shots.schema["shot_id"].dataType).alias("shot_id"), F.col("frame_idx").cast("long").alias("f"))
    line = line.union(shots.select("media_id", middle, "shot_id", none.cast("long"))).withColumn("bin", binned("place"))
    order = Window.partitionBy("media_id", "bin").orderBy("place", F.col("f").asc_nulls_last())
    below = F.last("f", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    above = F.first("f", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    met = line.withColumns({"below": below, "above": above}).filter(F.col("f").isNull())
    # where a bin has none, the nearest bin that has: a row per bin
    bins, along_bins = line.groupBy(F.col("media_id").alias("m"), F.col("bin").alias("at")).agg(F.min("f").alias("low"), F.max("f").alias("high")), Window.partitionBy("m").orderBy("at")
    ends = bins.select(
        "m", "at", F.last("high", ignorenulls=True).over(along_bins.rowsBetween(Window.unboundedPreceding, -1)).alias("last"),
        F.first("low", ignorenulls=True).over(along_bins.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
    )
    met = met.join(ends, (F.col("media_id") == F.col("m")) & (F.col("bin") == F.col("at"))).withColumns({"below": F.coalesce("below", "last"), "above": F.coalesce("above", "next")})
    met = met.filter(F.col("below").isNotNull() | F.col("above").isNotNull())
    low = (F.col("above").isNull()) | (F.col("place") - F.col("below") <= F.col("above") - F.col("place"))
    best = F.when(F.col("below").isNotNull() & low, F.col("below")).otherwise(F.col("above"))
    return met.select("media_id", "shot_id", best.alias("frame_idx"), F.abs(best - F.col("place")).alias("off"))


def best_per_shot(rows: DataFrame, most: int) -> DataFrame:
    """The min(most, max(1, duration / 30)) rows of highest confidence of each shot, ties to the lower frame."""
    k = F.least(F.lit(most), F.greatest(F.lit(1), F.floor(F.col("duration_frames") / 30)))
    rank = F.row_number().over(Window.partitionBy("media_id", "shot_id").orderBy(F.col("confidence").desc(), "frame_idx"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)
