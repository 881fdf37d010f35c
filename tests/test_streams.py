from __future__ import annotations

import tempfile

import numpy as np
import pytest
from agree import same
from pyspark.sql import functions as F

from montage import catalogue, catalogue_streams  # noqa: F401
from montage.operators import sampling, shots
from montage.plans.progress import Progress, StreamProgress
from montage.streaming import media_time

DIFFS = "media_id long, idx long, diff double, threshold double, at timestamp"


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs a stream over files of rows, one file a micro-batch, in the order in which they were written."""
    media_time.with_store(spark)

    def run(parts, work, name="out"):
        for rows in parts:
            rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = work(source)
        media_time.drained(out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")), 120)
        return spark.table(name).collect()

    return run


def scores(spark, rows):
    made = spark.createDataFrame(rows, "media_id long, idx long, diff double")
    return made.withColumns({"threshold": F.lit(0.5), "at": media_time.media_time(F.col("idx"), F.lit(10.0))}).select("media_id", "idx", "diff", "threshold", "at")


def test_shuffled_batches_give_the_boundaries_of_the_batch(spark, streamed):
    rng = np.random.default_rng(1)
    rows = [(m, i, float(rng.random())) for m in (1, 2, 3) for i in range(1, 400)]
    limit = spark.createDataFrame([(m, 0.5) for m in (1, 2, 3)], "media_id long, threshold double")
    wanted = {(r["media_id"], r["boundary"]) for r in shots.boundaries(scores(spark, rows).drop("threshold", "at"), limit, 7).collect() if r["boundary"] > 0}
    # a row is up to 60 places (6 s) late; files come in order
    late = sorted(rows, key=lambda r: r[1] + rng.integers(0, 60))
    parts = [scores(spark, late[k : k + 200]) for k in range(0, len(late), 200)] + [scores(spark, [(9, 10_000, 0.9)])]
    got = streamed(parts, lambda s: media_time.late_boundaries(s, "10 seconds", 7), "shuffled")
    assert len(got) == len(wanted) and {(r["media_id"], r["boundary"]) for r in got} == wanted


def test_rows_behind_the_watermark_are_not_taken_up(spark, streamed):
    parts = [scores(spark, [(1, 50, 0.9)]), scores(spark, [(1, 500, 0.9)]), scores(spark, [(1, 20, 0.9), (1, 470, 0.9)]), scores(spark, [(2, 5000, 0.9)])]
    got = streamed(parts, lambda s: media_time.late_boundaries(s, "10 seconds", 30), "behind")
    # 20 comes when 50 has been sent; 470 comes late but in time, and 500 is too close to it
    assert sorted(r["boundary"] for r in got) == [50, 470]


def test_nothing_is_sent_before_its_time_is_over(spark, streamed):
    assert streamed([scores(spark, [(1, 50, 0.9), (1, 90, 0.9)])], lambda s: media_time.late_boundaries(s, "10 seconds", 30), "early") == []


def test_random_frames_of_a_stream(spark, streamed):
    made = [(1, 24.0, 100), (2, 12.5, 61), (3, 0.0, 30), (4, 60.0, 59), (5, 29.97, 95)]
    videos = spark.createDataFrame(made, "media_id long, fps double, total long")
    wanted = {tuple(r) for r in sampling.random_frames(videos, 3).collect()}
    rng = np.random.default_rng(3)
    frames = [(m, i, fps, total) for m, fps, total in made for i in range(total)]
    rng.shuffle(frames)
    frames = [(int(m), int(i), float(f), int(t)) for m, i, f, t in frames] + [(1, 7, 24.0, 100)]
    schema = "media_id long, frame_idx long, fps double, total long"
    parts = [spark.createDataFrame(frames[k : k + 90], schema) for k in range(0, len(frames), 90)] + [spark.createDataFrame([(9, 10_000, 1.0, 20_000)], schema)]
    got = streamed(parts, lambda s: media_time.random_frame_stream(s, 3, "20 seconds"), "drawn")
    assert len(got) == len(wanted) and {tuple(r) for r in got} == wanted


@pytest.mark.parametrize("fps", [12.0, 12.5, 29.97, 59.94, 0.5])
def test_seconds_are_those_of_the_batch(spark, fps):
    rows = spark.range(2000).withColumn("second", media_time.second_of(F.col("id"), F.lit(fps)))
    assert rows.filter(~((F.floor(F.col("second") * fps) <= F.col("id")) & (F.col("id") < F.floor((F.col("second") + 1) * fps)))).count() == 0


@pytest.mark.parametrize("name", ["stream_boundaries", "stream_random_frames"])
def test_streams_agree_with_sql(spark, small, name):
    same(spark, small, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_progress_is_told_while_a_plan_runs(spark):
    seen = []
    progress = Progress(3, lambda s: seen.append((s.step, s.stage, s.rows, s.percent, len(progress.log))))
    rows = progress.settle("numbers", spark.range(100).toDF("n"))
    assert seen == [(1, "numbers", 100, 33, 1)]
    few = progress.settle("few", rows.filter("n < 7"))
    progress.settle("none", few.filter("n > 50"))
    assert [s[:4] for s in seen] == [(1, "numbers", 100, 33), (2, "few", 7, 66), (3, "none", 0, 100)]
    assert [(r["stage"], r["rows"], r["percent"]) for r in progress.table(spark).orderBy("step").collect()] == [("numbers", 100, 33), ("few", 7, 66), ("none", 0, 100)]


def test_an_error_of_the_listener_ends_the_plan(spark):
    def stop(step):
        raise InterruptedError(step.stage)

    with pytest.raises(InterruptedError, match="first"):
        Progress(2, stop).settle("first", spark.range(3))


def test_progress_of_a_stream(spark, streamed):
    heard = StreamProgress("watched", expected=30)
    spark.streams.addListener(heard)
    try:
        parts = [spark.range(k, k + 10) for k in (0, 10, 20)]
        streamed(parts, lambda s: s.observe("ids", F.max("id").alias("most")), "watched")
        for _ in range(100):
            if sum(s.rows for s in heard.log) == 30:
                break
            __import__("time").sleep(0.1)
        assert [s.percent for s in heard.log if s.rows] == [33, 66, 100]
        assert max(o["ids"]["most"] for o in heard.observed if "ids" in o) == 29
    finally:
        spark.streams.removeListener(heard)
