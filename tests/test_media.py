from __future__ import annotations

import json
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from montage.operators import clusters, series, shots
from montage.plans import keyframes
from montage.sources import results, sinks
from montage.streaming.boundaries import boundary_stream


def test_threshold_clusters_overwrite(spark):
    angle = lambda d: [float(np.cos(np.radians(d))), float(np.sin(np.radians(d)))]
    made = [(1, i, angle(d)) for i, d in enumerate((0, 30, 60, 180))]
    rows = spark.createDataFrame(made, "media_id int, frame_idx long, clip array<double>")
    # 0 takes itself and 1; 2 resembles 1 and takes it over; 3 is alone
    assert [r["cluster_id"] for r in clusters.threshold_clusters(rows).orderBy("frame_idx").collect()] == [0, 1, 1, -1]


@pytest.mark.parametrize(("n", "wanted"), [(5, [0, 0, 1, 2, 3]), (6, [0, 0, -1, -1, -1, -1])])
def test_rows_alone_are_clusters_in_small_groups(spark, n, wanted):
    made = [(1, i, [float(j == max(i, 1)) for j in range(7)]) for i in range(n)]
    rows = spark.createDataFrame(made, "media_id int, frame_idx long, clip array<double>")
    found = clusters.density_clusters(rows, clusters.pairs(rows), 0.2).orderBy("frame_idx").collect()
    assert [r["cluster_id"] for r in found] == wanted


def test_peaks_keep_their_distance(spark):
    rng = np.random.default_rng(3)
    scores = rng.random(120)
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(scores)], "media_id int, idx long, score double")
    plain = sorted(((-r["smooth"], r["idx"]) for r in series.peaks(rows).collect()))
    kept: list[int] = []
    for _, i in plain:
        if all(abs(i - k) >= 6 for k in kept):
            kept.append(i)
    assert sorted(r["idx"] for r in series.spaced_peaks(rows).collect()) == sorted(kept)


def test_first_found(spark):
    schema = "media_id long, shot_id int, start_frame long, end_frame long, duration_frames long, confidence double"
    a = spark.createDataFrame([(1, 0, 0, 5, 5, 0.9)], schema)
    b = spark.createDataFrame([(1, 0, 0, 9, 9, 0.7), (2, 0, 0, 4, 4, 0.7)], schema)
    totals = spark.createDataFrame([(1, 9), (2, 4), (3, 7)], "media_id long, total long")
    out = {r["media_id"]: (r["method"], r["end_frame"]) for r in shots.first_found(totals, ("a", a), ("b", b)).collect()}
    assert out == {1: ("a", 5), 2: ("b", 4), 3: ("whole", 7)}


def test_keyframe_plan(spark):
    clip = lambda k: [float(j == k) for j in range(3)]
    rows = spark.createDataFrame([(1, i, clip(0 if i < 6 else 1)) for i in range(0, 12)] + [(2, 0, clip(2))], "media_id long, frame_idx long, clip array<double>")
    still = spark.createDataFrame([], "media_id long, idx long, score double")
    found = spark.createDataFrame(
        [(1, 0, 0, 11, 900), (1, 1, 50, 60, 10), (2, 0, 0, 1, 1)], "media_id long, shot_id int, start_frame long, end_frame long, duration_frames long"
    )
    out = keyframes.keyframes(rows, still, found)
    got = sorted((r["media_id"], r["shot_id"], r["frame_idx"], r["selection_method"], r["confidence"]) for r in out.collect())
    # candidates 0, 4, 8, 11: two clusters; a shot without frames takes the nearest, one frame alone is kept
    assert got == [(1, 0, 0, "cluster_center", 1.0), (1, 0, 8, "cluster_center", 1.0), (1, 1, 11, "closest_fallback", 0.3), (2, 0, 0, "single", 0.8)]
    stats = {r["media_id"]: r for r in keyframes.statistics(out).collect()}
    assert (stats[1]["total_keyframes"], stats[1]["shots_covered"], stats[1]["methods"]) == (3, 2, "closest_fallback=1,cluster_center=2")


def test_sinks_and_read_back(spark, tmp_path):
    segments = spark.createDataFrame([(1, 0, 0.0, 1.5, "hello", "a"), (1, 1, 2.0, 3.0, "x" * 60, "b"), (1, 2, 4.0, 5.0, "again", "a")], "media_id long, seg_index long, start double, end double, text string, speaker string")
    sinks.write_speakers(segments, f"{tmp_path}/speakers")
    back = spark.read.parquet(f"{tmp_path}/speakers")
    assert back.filter("speaker = 'a'").count() == 2
    info = sinks.export_info(segments).first()
    assert info["total_segments"] == 3 and info["speakers"]["a"]["files"][1]["file"] == "a_001"
    text = sinks.speaker_text(segments).first()["value"]
    assert "x" * 50 + "..." in text and "speakers: 2" in text and "segments per speaker: 1.5" in text
    chosen = keyframes.described(spark.createDataFrame([(1, 0, 30, 0, 0.5, "single")], "media_id long, shot_id int, frame_idx long, cluster_id int, confidence double, selection_method string"))
    assert "1.00 s" in sinks.keyframe_text(chosen).first()["value"]
    sinks.write_text(sinks.speaker_text(segments), f"{tmp_path}/text")
    sinks.write_csv(chosen, f"{tmp_path}/csv")
    sinks.write_metadata(chosen, f"{tmp_path}/meta")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["filename"] == "1_keyframe_0000.jpg"
    assert spark.read.json(f"{tmp_path}/meta").first()["keyframes"][0]["frame_idx"] == 30
    sweep = spark.createDataFrame([("b", 3, 0.5, True), ("a", 9, 0.25, True), ("c", 0, 0.0, False)], "name string, keyframes long, confidence double, success boolean")
    assert [r["value"] for r in sinks.ranked(sweep).orderBy("rank").collect()] == ["| 1 | a | 9 | 0.250 |", "| 2 | b | 3 | 0.500 |"]


def test_report(spark, tmp_path):
    def run(name: str, meta: str | None, rows: str | None) -> None:
        (tmp_path / name).mkdir()
        if meta is not None:
            (tmp_path / name / "metadata.json").write_text(meta)
        if rows is not None:
            (tmp_path / name / "keyframes.csv").write_text(rows)
        (tmp_path / name / "a.jpg").write_bytes(b"x" * 1048576)

    run("one", json.dumps({"keyframes": [{"shot_id": 1, "confidence": 0.5}, {"shot_id": 2, "confidence": 1.0}]}), "shot_id,confidence\n7,0.1\n")
    run("two", json.dumps({"keyframes": []}), "shot_id,confidence\n1,0.2\n1,0.4\n")
    run("three", "{broken", "shot_id,confidence\n1,bad\n")
    got = {r["run"]: (r["shots_covered"], r["avg_confidence"]) for r in results.report(spark, str(tmp_path)).collect()}
    assert got == {"one": (2, 0.75), "two": (1, 0.3), "three": (1, 0.0)}
    sizes = {r["run"]: (r["files"], r["megabytes"]) for r in results.folder_sizes(results.listing(spark, str(tmp_path), "*.jpg")).collect()}
    assert sizes == {k: (1, 1.0) for k in ("one", "two", "three")}


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("start\n成功提取 12 个关键帧\n覆盖镜头数: 4\n平均置信度: 0.75\n", encoding="utf-8")
    row = results.logs(spark, str(tmp_path)).first()
    assert (row["keyframes"], row["shots"], row["confidence"]) == (12, 4, 0.75)


def test_boundary_stream_keeps_its_place(spark, tmp_path):
    for k, places in enumerate(((0, 30, 31), (61, 62, 92))):
        part = spark.createDataFrame([(1, i, 1.0) for i in places], "media_id long, idx long, diff double")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    diffs = spark.readStream.schema("media_id long, idx long, diff double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = boundary_stream(diffs, 0.5, 30).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-")).trigger(availableNow=True).start()
    assert query.awaitTermination(60) and query.exception() is None
    assert sorted(r["boundary"] for r in spark.table("kept").select(F.col("boundary")).collect()) == [31, 62]
