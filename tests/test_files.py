from __future__ import annotations

import csv
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from montage.plans import settings
from montage.sources import documents, named_files, results

SRT = "1\n00:00:01,000 --> 00:00:03,500\nFirst line\nmore\n\n2\n00:00:04,000 --> 00:00:06,000\n \n\n3\n01:00:07,000 --> 01:00:09,000\nLast\n"
SEGMENTS = "media_id long, seg_index int, start double, end double, text string, speaker string"
WHEN = "2024-05-06 07:08:09"


def every_file(root) -> list[str]:
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


def test_named_files_hold_their_lines_in_order(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("d/"), (F.col("id") % 7).cast("string"), F.lit(".txt")).alias("file"), (-F.col("id")).alias("at"), F.col("id").cast("string").alias("line"))
    named_files.write_files(rows.repartition(9), str(tmp_path), "at")
    assert every_file(tmp_path) == [f"d/{k}.txt" for k in range(7)]
    for k in range(7):
        assert (tmp_path / "d" / f"{k}.txt").read_text().split() == [str(i) for i in range(4999, -1, -1) if i % 7 == k]


def test_nothing_is_left_after_a_failed_task(spark, tmp_path):
    rows = spark.range(1000).select(F.concat((F.col("id") % 20).cast("string"), F.lit(".txt")).alias("file"), F.col("id").alias("at"), F.lit("x").alias("line"))
    bad = rows.withColumn("line", F.when(F.col("at") == 777, F.raise_error(F.lit("broken row"))).otherwise("x"))
    with pytest.raises(PySparkException):
        named_files.write_files(bad, str(tmp_path), "at")
    assert every_file(tmp_path) == [] and os.listdir(tmp_path) == []
    with pytest.raises(PySparkException):
        named_files.write_files(rows.withColumn("file", F.lit("../out.txt")), str(tmp_path / "in"), "at")
    assert every_file(tmp_path) == []


def test_files_that_exist_are_kept_unless_told_otherwise(spark, tmp_path):
    row = lambda line: spark.createDataFrame([("a.txt", line)], "file string, line string")
    named_files.write_files(row("first"), str(tmp_path))
    with pytest.raises(PySparkException):
        named_files.write_files(row("second"), str(tmp_path))
    assert (tmp_path / "a.txt").read_text() == "first\n" and every_file(tmp_path) == ["a.txt"]
    named_files.write_files(row("second"), str(tmp_path), overwrite=True)
    assert (tmp_path / "a.txt").read_text() == "second\n" and every_file(tmp_path) == ["a.txt"]


def test_one_broken_subtitle_file_is_one_row(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿" + SRT, encoding="utf-8")
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.srt").write_bytes("1\n00:00:00,000 --> 00:00:01,000\n你好\n".encode("gbk"))
    (tmp_path / "c.srt").write_bytes(b"1\n00:00:00,000 --> 00:00:01,000\n\xff\xff\x81\n")
    (tmp_path / "d.txt").write_text(SRT)
    rows = named_files.read_subtitles(spark, str(tmp_path), splitBytes=50)
    assert rows.rdd.getNumPartitions() == 3
    got = {(os.path.basename(r["media"]), r["seg_index"], r["start"], r["end"], r["text"]) for r in rows.filter("error is null").collect()}
    assert got == {("a.srt", 1, 1.0, 3.5, "First line more"), ("a.srt", 3, 3607.0, 3609.0, "Last"), ("b.srt", 1, 0.0, 1.0, "你好")}
    outcomes = {os.path.basename(r["media"]): (r["segments"], r["error"] is None) for r in documents.batch_outcomes(rows).collect()}
    assert outcomes == {"a.srt": (2, True), "b.srt": (1, True), "c.srt": (0, False)}
    assert tuple(documents.outcome_counts(documents.batch_outcomes(rows)).first()) == (3, 2, 1)


def test_one_broken_json_file_is_one_row(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"keyframes": [{"shot_id": 1}], "名": 2}', encoding="utf-8")
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_bytes(b"\xff\xfe\x00")
    rows = named_files.read_json_files(spark, str(tmp_path)).collect()
    assert [(os.path.basename(r["path"]), r["error"] is None) for r in sorted(rows, key=lambda r: r["path"])] == [("a.json", True), ("b.json", False), ("c.json", False)]
    assert [json.loads(r["value"])["名"] for r in rows if r["value"]] == [2]


@pytest.fixture
def segments(spark):
    rows = [(1, i, i * 70.0, i * 70.0 + 1.25, f'line "{i}", 声' + "x" * (60 if i == 2 else 0), "speaker_01" if i == 1 else "speaker_00") for i in range(6)]
    return spark.createDataFrame(rows + [(2, 0, 0.0, 2.0, None, "speaker_00")], SEGMENTS)


def test_speaker_documents(spark, segments, tmp_path):
    heard = segments.withColumn("has_audio", F.col("seg_index") != 2)
    documents.write(str(tmp_path), documents.speaker_files(heard), documents.export_info(heard, WHEN), documents.speaker_summary(segments, WHEN))
    names = every_file(tmp_path)
    # the number of the segment without audio is not given to another
    assert [n for n in names if n.startswith("1/speaker_00/")] == [f"1/speaker_00/speaker_00_{i:03d}.txt" for i in (0, 2, 3, 4)]
    assert names[-3:] == ["2/export_info.json", "2/speaker_00/speaker_00_000.txt", "2/summary.txt"]
    assert (tmp_path / "1/speaker_00/speaker_00_002.txt").read_text(encoding="utf-8").splitlines() == ["片段: 3", "时间: 03:30.00 - 03:31.25", "时长: 1.25秒", '字幕: line "3", 声', "原始索引: 3"]
    info = json.loads((tmp_path / "1/export_info.json").read_text(encoding="utf-8"))
    assert (info["timestamp"], info["total_segments"], info["total_duration"]) == (WHEN, 6, 6.25)
    assert [f["audio"] for f in info["speakers"]["speaker_00"]["files"]] == [f"speaker_00_{i:03d}.wav" for i in (0, 2, 3, 4)]
    assert info["speakers"]["speaker_00"]["segment_count"] == 5 and info["speakers"]["speaker_01"]["subtitles"] == ['line "1", 声']
    assert info["speakers"]["speaker_01"]["files"][0] == {"audio": "speaker_01_000.wav", "subtitle": "speaker_01_000.txt", "text": 'line "1", 声', "start_time": 70.0, "end_time": 71.25, "duration": 1.25}
    text = (tmp_path / "1/summary.txt").read_text(encoding="utf-8").splitlines()
    assert text[:4] == ["动漫角色对话提取结果", "=" * 50, "", f"处理时间: {WHEN}"]
    assert text[5:15] == ["speaker_00:", "  片段数量: 5", "  总时长: 00:06.25", "  平均片段长度: 1.25秒", "  示例字幕:", '    1. line "0", 声', '    2. line "2", 声' + "x" * 39 + "...", '    3. line "3", 声', "    ... 还有 2 个片段", ""]
    assert text[-6:] == ["-" * 50, "总计:", "  说话人数量: 2", "  总片段数量: 6", "  总时长: 00:07.50", "  平均每个说话人: 3.0 个片段"]


@pytest.fixture
def chosen(spark):
    rows = [(1, f"film_keyframe_{i:04d}.jpg", i * 10, i / 3, i // 2, -1 if i == 3 else 0, 0.5 + i / 10, "cluster_center, near") for i in range(4)] + [(2, "other.jpg", 5, 1.0, 0, 0, 0.25, "single")]
    return spark.createDataFrame(rows, "media_id long, filename string, frame_idx long, timestamp double, shot_id int, cluster_id int, confidence double, selection_method string")


def test_keyframe_documents_can_be_read_back(spark, chosen, tmp_path):
    videos = spark.createDataFrame([(1, "/in/my.film.mp4"), (2, "plain"), (3, "/in/none.mp4")], "media_id long, path string")
    info = spark.createDataFrame([(1, 2, 0.5)], "media_id long, total_shots int, processing_time_seconds double")
    how = settings.preset("fast")
    documents.write(
        str(tmp_path / "named"), documents.metadata(chosen, videos, how, WHEN, info), documents.keyframes_csv(chosen, videos), documents.keyframe_summary(chosen, videos, WHEN, info)
    )
    assert every_file(tmp_path / "named") == ["my.film/my.film_keyframes.csv", "my.film/my.film_metadata.json", "my.film/my.film_summary.txt", "plain/plain_keyframes.csv", "plain/plain_metadata.json", "plain/plain_summary.txt"]
    got = json.loads((tmp_path / "named/my.film/my.film_metadata.json").read_text(encoding="utf-8"))
    assert list(got) == ["video_info", "processing_info", "extraction_time", "config", "total_keyframes", "keyframes"]
    assert got["video_info"] == {"path": "/in/my.film.mp4", "name": "my.film"} and got["processing_info"] == {"total_shots": 2, "processing_time_seconds": 0.5}
    assert got["config"]["cluster_eps"] == 0.2 and got["config"]["output_resolution"] == [512, 512] and got["total_keyframes"] == 4
    assert [k["frame_idx"] for k in got["keyframes"]] == [0, 10, 20, 30] and got["keyframes"][3]["cluster_id"] == -1
    assert json.loads((tmp_path / "named/plain/plain_metadata.json").read_text())["processing_info"] == {}
    with open(tmp_path / "named/my.film/my.film_keyframes.csv", encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader(f))
    assert len(rows) == 4 and rows[1]["selection_method"] == "cluster_center, near" and float(rows[1]["confidence"]) == 0.6
    text = (tmp_path / "named/my.film/my.film_summary.txt").read_text(encoding="utf-8")
    assert text.startswith("=" * 60 + "\n视频关键帧提取摘要\n") and "\n处理信息:\n  total_shots: 2\n" in text
    assert "\n镜头 1 (2 个关键帧):\n  film_keyframe_0002.jpg\n    时间戳: 0.67s\n    置信度: 0.700\n    方法: cluster_center, near\n    聚类ID: 0\n" in text
    # under plain names they are what the comparison of runs reads
    documents.write(str(tmp_path / "runs"), documents.metadata(chosen, videos, how, WHEN, plain=True), documents.keyframes_csv(chosen, videos, plain=True))
    back = {r["run"]: (r["shots_covered"], r["avg_confidence"]) for r in results.report(spark, str(tmp_path / "runs")).collect()}
    assert back == {"my.film": (2, 0.65), "plain": (1, 0.25)}


def test_sweep_documents(spark, tmp_path):
    schema = "name string, description string, params map<string,string>, success boolean, keyframes_count long, shots_covered long, avg_confidence double, processing_time double, error string"
    made = [
        ("min_shot_5", "short", {"min_shot_duration": "5", "fps": "2"}, True, 9, 3, 0.5, 1.5, None), ("max_frames_3", "few", {}, True, 12, 4, 0.25, 2.0, None),
        ("bad", "bad", {}, False, 0, 0, 0.0, 0.0, "no shots"), ("worse", "bad", {}, False, 0, 0, 0.0, 0.0, None),
    ]
    runs = spark.createDataFrame(made, schema)
    documents.write(str(tmp_path), documents.sweep_results(runs), documents.sweep_report(runs, "/in/film.mp4", WHEN))
    assert {r["name"] for r in json.loads((tmp_path / "test_results.json").read_text(encoding="utf-8"))} == {r[0] for r in made}
    text = (tmp_path / "test_report.md").read_text(encoding="utf-8")
    assert "**总测试数**: 4\n**成功**: 2, **失败**: 2\n" in text and "| max_frames_3 | few | 12 | 4 | 0.25 | 2.0 |\n| min_shot_5 | short | 9 | 3 | 0.5 | 1.5 |" in text
    assert "- **5帧**: 9个关键帧, 3个镜头" in text and "- **unknown帧/镜头**: 12个关键帧, 平均置信度0.25" in text
    assert "**最佳测试**: max_frames_3" in text and "- **bad**: no shots\n- **worse**: 未知错误" in text
    done = spark.createDataFrame([("short_a", 10, 2, 0.5, 1.0), ("baseline", 4, 2, 0.9, 2.0), ("similar_b", 6, 1, 0.9, 1.0), ("empty", 0, 0, 0.0, 0.0)], "name string, keyframes_count long, shots_covered long, avg_confidence double, file_size_mb double")
    documents.write(str(tmp_path), documents.comparison_report(done, "/here"))
    text = (tmp_path / "analysis_report.md").read_text(encoding="utf-8")
    assert "| short_a | 10 | 2 | 0.5 | 1.0 | 5.0 |" in text and "empty" not in text
    assert "### 关键帧数量最多\n- **short_a**: 10个关键帧" in text and "### 置信度最高\n- **similar_b**: 平均置信度0.9" in text and "### 综合效率最佳\n- **similar_b**: 效率评分5.4" in text
    assert "### 镜头长度设置影响\n- **short_a**" in text and "### 相似度阈值影响\n- **similar_b**" in text
    # a sweep without any success
    documents.write(str(tmp_path), documents.sweep_report(runs.filter("not success"), "v", WHEN, "failed.md"))
    assert "测试结果对比" not in (tmp_path / "failed.md").read_text(encoding="utf-8")
