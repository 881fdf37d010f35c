"""The whole keyframe plan: frames of shots, candidates, clusters, representatives, the best of each shot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from montage.functions import scalars
from montage.operators import clusters, radius, sampling, series, shots
from montage.plans.checkpoints import settled
from montage.plans.progress import Progress, settle
from montage.plans.settings import Settings

#: Distance within which candidates hang together where no two can be compared.
EPS = 0.15
#: Most keyframes of a shot.
MOST = 30


#: Stages of the plan, as they are told to a Progress.
STAGES = ("frames of shots", "scores", "candidates", "vectors", "distances", "clusters")


def keyframes(frames: DataFrame, motion: DataFrame, found: DataFrame, most: int = MOST, eps: float = EPS, progress: Progress | None = None) -> DataFrame:
    """media_id, shot_id, frame_idx, cluster_id, confidence, selection_method.

    frames: media_id, frame_idx, clip; motion: media_id, idx, score; found: shots with start_frame, end_frame and
    duration_frames. A frame on the edge of two shots belongs to both. Frames without a score count as still. Work on
    candidates is per shot; a shot without frames takes the nearest frame of its media. `eps` is the radius of shots whose
    candidates tell none; a `progress` is told of each of STAGES.
    """
    inside = settle(progress, STAGES[0], shots.frames_in_shots(frames, found))
    scored = inside.join(motion.select("media_id", F.col("idx").alias("frame_idx"), "score"), ["media_id", "frame_idx"], "left")
    # the operators below work per media_id and by place in the series: here that is a shot of a media, and a frame's place in it
    key = F.struct("media_id", "shot_id").alias("media_id")
    place = F.row_number().over(Window.partitionBy("media_id", "shot_id").orderBy("frame_idx")) - 1
    line = settle(progress, STAGES[1], scored.select(key, place.cast("long").alias("idx"), F.coalesce("score", F.lit(0.0)).alias("score"), "frame_idx"))
    scores = line.drop("frame_idx")
    picked = series.candidates(scores, series.spaced_peaks(scores)).join(line.drop("score"), ["media_id", "idx"])
    some = settle(progress, STAGES[2], picked.select(F.col("media_id").alias("shot"), "frame_idx"))
    clips = some.withColumn("media_id", F.col("shot.media_id")).join(frames.select("media_id", "frame_idx", "clip"), ["media_id", "frame_idx"])
    clips = settle(progress, STAGES[3], clips.select(F.col("shot").alias("media_id"), "frame_idx", "clip"))

    dists = settle(progress, STAGES[4], radius.near_pairs(clips, max(radius.ENOUGH, eps)))
    radii = clips.select("media_id").distinct().join(radius.adaptive_eps(clips, dists), "media_id", "left").select("media_id", F.coalesce("eps", F.lit(eps)).alias("eps"))
    close = dists.join(radii, "media_id").filter(F.col("dist") <= F.col("eps")).drop("eps")
    labelled = settle(progress, STAGES[5], clusters.density_clusters(clips, close, 2.0))
    alone = clips.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("media_id").alias("single"))
    chosen = clusters.representatives(clips, labelled).join(alone, F.col("media_id") == F.col("single"), "left")
    method = F.when(F.col("single").isNotNull(), "single").when(F.col("cluster_id") < 0, "noise_point").otherwise("cluster_center")
    chosen = chosen.select(
        "media_id.media_id", "media_id.shot_id", "frame_idx", F.col("cluster_id").cast("int").alias("cluster_id"),
        F.when(F.col("single").isNotNull(), 0.8).otherwise(F.col("confidence")).alias("confidence"), method.alias("selection_method"),
    )
    empty = found.join(inside.select("media_id", "shot_id").distinct(), ["media_id", "shot_id"], "left_anti")
    nearest = shots.nearest_frame(frames, empty).select(
        "media_id", "shot_id", "frame_idx", F.lit(0).alias("cluster_id"), F.lit(0.3).alias("confidence"), F.lit("closest_fallback").alias("selection_method")
    )
    every = chosen.unionByName(nearest).join(found.select("media_id", "shot_id", "duration_frames"), ["media_id", "shot_id"])
    return shots.best_per_shot(every, most).drop("rank", "duration_frames")


def looked_at(frames: DataFrame, videos: DataFrame, how: Settings) -> DataFrame:
    """The frames that the sampling strategy of `how` looks at. videos: media_id, fps, total (frames)."""
    if how.sampling_strategy == "random_seconds":
        drawn = sampling.random_frames(videos.select("media_id", "fps", "total"), how.random_select_count)
        return frames.join(drawn.select("media_id", "frame_idx"), ["media_id", "frame_idx"], "left_semi")
    steps = videos.select("media_id", sampling.interval(F.col("fps"), how).alias("step"))
    return frames.join(steps, "media_id").filter(F.col("frame_idx") % F.col("step") == 0).select(*frames.columns)


def extracted(frames: DataFrame, motion: DataFrame, found: DataFrame, videos: DataFrame, how: Settings, progress: Progress | None = None) -> DataFrame:
    """The keyframes of every media by one configuration, as the rows of a report, with what their pictures need.

    videos: media_id, fps, total, width, height. Columns: those of `keyframes`, and timestamp by the media's own rate,
    keyframe_idx, filename, fps, width, height (of the picture) and image_quality.
    """
    shots_used = found
    if how.enable_shot_filtering:
        kept = shots.usable(found.select("media_id", "shot_id", "start_frame", "end_frame", "duration_frames"), how.min_shot_duration, how.max_shot_duration)
        shots_used = settled(kept)
    chosen = keyframes(looked_at(frames, videos, how), motion, shots_used, how.max_keyframes_per_shot, how.cluster_eps, progress)
    rows = described(chosen, videos).join(videos.select("media_id", F.col("width").alias("w"), F.col("height").alias("h")), "media_id")
    if how.preserve_original_resolution:
        width, height = scalars.bounded(F.col("w").cast("double"), F.col("h").cast("double"), *how.max_resolution)
    else:
        width, height = (F.lit(x).cast("long") for x in how.output_resolution)
    return rows.withColumns({"width": width, "height": height, "image_quality": F.lit(how.image_quality)}).drop("w", "h")


def described(chosen: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Keyframes as the rows of a report: timestamp in seconds, number by media and a file name.

    The rate is that of the media (videos: media_id, fps), whose timestamps are 0 where it is 0; 30 without videos.
    """
    rate = F.col("fps") if videos is not None else F.lit(30.0)
    rows = chosen.join(videos.select("media_id", "fps"), "media_id") if videos is not None else chosen
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("frame_idx", "shot_id")) - 1
    rows = rows.withColumns({"keyframe_idx": number, "timestamp": F.round(sampling.frame_time(F.col("frame_idx"), rate), 4)})
    return rows.withColumn("filename", F.format_string("%s_keyframe_%04d.jpg", F.col("media_id").cast("string"), F.col("keyframe_idx")))


def processing(chosen: DataFrame, found: DataFrame, frames: DataFrame) -> DataFrame:
    """What the metadata of a media tell of the work on it: media_id, shots, frames, keyframes, their mean per shot, and statistics."""
    per_shot = F.round(F.col("total_keyframes") / F.col("total_shots"), 6)
    rows = statistics(chosen).join(found.groupBy("media_id").agg(F.count(F.lit(1)).alias("total_shots")), "media_id")
    rows = rows.join(frames.groupBy("media_id").agg(F.count(F.lit(1)).alias("total_frames_processed")), "media_id", "left")
    stats = F.struct("shots_covered", "avg_confidence", "clusters_found", "methods").alias("keyframe_selection_stats")
    return rows.select("media_id", "total_shots", F.coalesce("total_frames_processed", F.lit(0)).alias("total_frames_processed"), "total_keyframes", per_shot.alias("avg_keyframes_per_shot"), stats)


def statistics(chosen: DataFrame) -> DataFrame:
    """Per media: keyframes, shots covered, mean confidence, clusters (-1 aside), rows by method as a sorted array."""
    by = chosen.groupBy("media_id", "selection_method").agg(F.count(F.lit(1)).alias("n"))
    methods = by.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("selection_method", "n"))).alias("methods"))
    stats = chosen.groupBy("media_id").agg(
        F.count(F.lit(1)).alias("total_keyframes"), F.count_distinct("shot_id").alias("shots_covered"), F.round(F.avg("confidence"), 6).alias("avg_confidence"),
        F.count_distinct(F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))).alias("clusters_found"),
    )
    return stats.join(methods, "media_id").withColumn("methods", F.array_join(F.transform("methods", lambda m: F.concat_ws("=", m["selection_method"], m["n"].cast("string"))), ","))
