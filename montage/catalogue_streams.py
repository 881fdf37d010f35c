"""Queries whose work is done by streams, over rows that Spark derives from the test tables, in an order that is not theirs."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from montage.catalogue import _FRAMES, GAP, ORACLES, query
from montage.operators import shots
from montage.plans.checkpoints import shared_folder
from montage.sources.tables import frames
from montage.streaming import media_time

#: Rate of videos whose table has none.
FPS = 30.0
#: Files that a stream reads one after the other, and frames by which a row may be late.
FILES, LATE = 3, 40


def _spread(rows: DataFrame, place: Column, folder: str, last: DataFrame) -> None:
    """Write rows as FILES files in the order of places, each row late by up to LATE places, and `last` as one more file."""
    late = (place + F.pmod(F.xxhash64(*rows.columns), F.lit(LATE))).cast("double")
    most = rows.agg(F.max(late).alias("m")).first()["m"] or 0.0
    for k in range(FILES):
        part = rows.filter(F.least(F.floor(late * FILES / (most + 1)), F.lit(FILES - 1)) == k)
        part.coalesce(1).write.mode("append").parquet(folder)
    last.coalesce(1).write.mode("append").parquet(folder)


def _streamed(spark: SparkSession, rows: DataFrame, place: Column, last: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that the stream `work` makes of `rows`, read one file a micro-batch; `last` ends all waiting."""
    folder = f"{shared_folder(spark)}/stream-{uuid4().hex}"
    _spread(rows, place, f"{folder}/in", last)
    media_time.with_store(spark)
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = work(source)
    media_time.drained(out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state"))
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(f"SELECT * FROM ({ORACLES['shot_boundaries']}) WHERE boundary > 0")
def stream_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """The boundaries of shot_boundaries after place 0, from scores that come late and out of order."""
    diffs = shots.changes(frames(spark, sf))
    rows = diffs.join(shots.histogram_threshold(diffs), "media_id").select(
        F.col("media_id").cast("long").alias("media_id"), "idx", "diff", "threshold", media_time.media_time(F.col("idx"), F.lit(FPS)).alias("at")
    )
    beyond = rows.agg(F.max("idx").alias("idx")).select(
        F.lit(-1).cast("long").alias("media_id"), (F.col("idx") + 1).alias("idx"), F.lit(1.0).alias("diff"), F.lit(0.0).alias("threshold"),
        (media_time.media_time(F.col("idx"), F.lit(FPS)) + F.expr("interval 1 hour")).alias("at"),
    )
    found = _streamed(spark, rows, F.col("idx"), beyond.filter("idx is not null"), lambda s: media_time.late_boundaries(s, "1 minute", GAP))
    return found.filter("media_id >= 0")


@query(f"""WITH {_FRAMES}, n AS (SELECT media_id, count(*) AS total, [12, 24, 25, 30, 60][media_id % 5 + 1]::DOUBLE AS fps FROM f GROUP BY media_id),
s AS (SELECT media_id, fps, total, unnest(range(0, CAST(floor(total / fps) AS BIGINT))) AS second FROM n),
r AS (SELECT media_id, second, unnest(range(CAST(floor(second * fps) AS BIGINT), CAST(floor((second + 1) * fps) AS BIGINT))) AS frame_idx FROM s)
SELECT media_id, second, frame_idx FROM r QUALIFY row_number() OVER (PARTITION BY media_id, second ORDER BY md5(media_id || ':' || frame_idx), frame_idx) <= 3""")
def stream_random_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Three frames of each whole second, drawn from a stream of frames in tumbling windows of a second."""
    rows = frames(spark, sf).select(F.col("media_id").cast("long").alias("media_id"), "frame_idx")
    rates = F.array(*map(F.lit, (12.0, 24.0, 25.0, 30.0, 60.0)))
    total = rows.groupBy("media_id").agg(F.count(F.lit(1)).alias("total"))
    rows = rows.join(total, "media_id").select("media_id", F.get(rates, F.pmod(F.col("media_id"), F.lit(5)).cast("int")).alias("fps"), "total", "frame_idx")
    beyond = rows.agg(F.max("frame_idx").alias("m")).select(F.lit(-1).cast("long").alias("media_id"), F.lit(1.0).alias("fps"), (F.col("m") + 20_000).alias("total"), (F.col("m") + 10_000).alias("frame_idx"))
    # media of different rates are at different times at the same frame: rows may be as late as the longest one lasts
    return _streamed(spark, rows, F.col("frame_idx"), beyond.filter("frame_idx is not null"), lambda s: media_time.random_frame_stream(s, 3, "1 hour"))
