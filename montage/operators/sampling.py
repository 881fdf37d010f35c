"""Which frames of a video are looked at: strides by frame rate, seeks, random frames of a second, fallbacks.

Videos are rows of media_id, fps, total (frames); frames are generated from them, never more than a video has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from montage.operators import draws
from montage.plans.checkpoints import ship
from montage.plans.settings import Settings

#: Seconds of a video that are drawn from together.
SECONDS = 64


def duration(total: Column, fps: Column) -> Column:
    """Seconds; 0 where the frame rate is 0."""
    return F.when(fps > 0, total / fps).otherwise(0.0)


def frame_time(idx: Column, fps: Column) -> Column:
    return F.when(fps > 0, idx / fps).otherwise(0.0)


def interval(fps: Column, how: Settings) -> Column:
    """Frames from one sampled frame to the next, 1 at least, by the strategy of `how`."""
    if how.sampling_strategy == "random_seconds":
        return F.lit(1).cast("long")
    step = {"seconds": fps / how.frames_per_second, "fps_ratio": F.when(fps > 0, fps / (fps / how.fps_ratio))}.get(how.sampling_strategy, fps / how.target_fps)
    return F.greatest(F.lit(1).cast("long"), F.floor(F.coalesce(step, F.lit(0.0))))


def strided(videos: DataFrame, step: Column) -> DataFrame:
    """media_id, frame_idx: every step-th frame of each video from frame 0."""
    some = videos.filter(F.col("total") > 0).withColumn("step", step.cast("long"))
    return some.select("media_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("step"))).alias("frame_idx"))


def seek_step(most: int) -> Column:
    """A step by which under 2 * most frames of a video are read."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.col("total") / most))


def random_frames(videos: DataFrame, k: int) -> DataFrame:
    """media_id, second, frame_idx: k frames of each whole second, by digest; a last second that is not whole is dropped."""
    long = lambda x: F.lit(x).cast("long")
    whole = videos.filter((F.col("fps") > 0) & (F.col("total") >= F.col("fps"))).withColumn("seconds", F.floor(F.col("total") / F.col("fps")))
    head = F.when(F.col("media_id").isNull(), "").otherwise(F.concat(F.col("media_id").cast("string"), F.lit(":"))).cast("binary")
    # a row per SECONDS seconds is shuffled, so that a long video is many tasks; frames are drawn in arrays
    parts = whole.select("media_id", "fps", F.col("total").cast("long").alias("total"), "seconds", F.explode(F.sequence(long(0), F.col("seconds") - 1, long(SECONDS))).alias("second"))
    until = F.least(F.col("second") + SECONDS, F.col("seconds"))
    starts = F.transform(F.sequence(F.col("second"), until), lambda s: F.floor(s * F.col("fps")).cast("long"))
    # as many as are set: by their bytes, which say little of the work, small ones would be put together
    tasks = int(videos.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = parts.repartition(tasks, "media_id", "second").select("media_id", head.alias("head"), "total", "second", starts.alias("starts"))
    types = T.StructType([rows.schema["media_id"], T.StructField("second", T.LongType()), T.StructField("frame_idx", T.LongType())])
    ship(videos.sparkSession)
    return rows.mapInArrow(draws.draw(k), types)


def eighths(rows: DataFrame) -> DataFrame:
    """Every max(1, n / 8)-th row of each shot, in the order of frames: media_id, shot_id, frame_idx."""
    own = Window.partitionBy("media_id", "shot_id")
    placed = rows.withColumns({"n": F.count(F.lit(1)).over(own), "r": F.row_number().over(own.orderBy("frame_idx")) - 1})
    return placed.filter(F.col("r") % F.greatest(F.lit(1), F.floor(F.col("n") / 8)) == 0).select("media_id", "shot_id", "frame_idx")


def with_frame_info(chosen: DataFrame, videos: DataFrame, step: Column) -> DataFrame:
    """Chosen rows whose sampled_idx stands for a frame that is sampled by `step`, with its original_idx and timestamp.

    What a video's frames are follows from the video: a chosen row meets its video, and no frames are formed.
    """
    some = videos.select("media_id", "fps", "total", step.cast("long").alias("step"))
    met = chosen.join(some, "media_id").withColumn("original_idx", F.col("sampled_idx") * F.col("step"))
    inside = met.filter((F.col("sampled_idx") >= 0) & (F.col("original_idx") < F.col("total")))
    return inside.select(*chosen.columns, "original_idx", F.round(frame_time(F.col("original_idx"), F.col("fps")), 6).alias("timestamp"))


def sampled_info(videos: DataFrame, step: Column) -> DataFrame:
    """media_id, sampled_idx (from 0), original_idx, timestamp of every strided frame."""
    some = videos.filter(F.col("total") > 0).withColumn("step", step.cast("long"))
    rows = some.select("media_id", "fps", "step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total") - 1, F.col("step"))).alias("original_idx"))
    number = F.call_function("div", F.col("original_idx"), F.col("step"))
    return rows.select("media_id", number.alias("sampled_idx"), "original_idx", F.round(frame_time(F.col("original_idx"), F.col("fps")), 6).alias("timestamp"))
