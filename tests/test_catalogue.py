from __future__ import annotations

import numpy as np
import pytest
from agree import same
from pyspark.sql import functions as F

import __spark_entry__
from montage import catalogue
from montage.functions import scalars, vectors
from montage.operators import clusters, series, shots
from montage.sources.subtitles import read_srt


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, small, name):
    same(spark, small, catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_gap_counts_from_the_last_kept_place(spark):
    diffs = spark.createDataFrame([(1, i, 1.0) for i in (0, 30, 31, 61, 62, 92)], "media_id int, idx long, diff double")
    limit = spark.createDataFrame([(1, 0.5)], "media_id int, threshold double")
    assert sorted(r["boundary"] for r in shots.boundaries(diffs, limit, 30).collect()) == [0, 31, 62]


def test_boundary_frame_is_in_both_shots(spark):
    frames = spark.createDataFrame([(1, 0), (1, 10), (1, 20)], "media_id int, frame_idx long")
    found = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 20)], "media_id int, shot_id int, start_frame long, end_frame long")
    assert sorted((r["shot_id"], r["frame_idx"]) for r in shots.frames_in_shots(frames, found).collect()) == [(0, 0), (0, 10), (1, 10), (1, 20)]


def test_smoothing_keeps_short_series_and_parabolas(spark):
    made = [(1, i, float(i)) for i in range(4)] + [(2, i, float(i * i)) for i in range(7)]
    out = {(r["media_id"], r["idx"]): r["smooth"] for r in series.smoothed(spark.createDataFrame(made, "media_id int, idx long, score double")).collect()}
    assert out == pytest.approx({(m, i): s for m, i, s in made}, abs=1e-6)


def test_average_linkage():
    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.1, 0.99]])
    assert clusters.average_linkage(v, 2).tolist() == [0, 0, 1, 1]
    assert clusters.average_linkage(v, 5).tolist() == [0, 0, 0, 0]
    assert clusters.average_linkage(v[:0], 1).tolist() == []


def test_vectors(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    out = row.select(vectors.cosine(a, b), vectors.cosine(a, a), vectors.distance(a, b), vectors.pearson(b, a)).first()
    assert list(out) == [0.0, 1.0, 1.0, 1.0]


def test_scalars(spark):
    row = spark.range(1).select(scalars.timecode(F.lit("01:02:03,500")), scalars.clock(F.lit(3725.5)), scalars.preview(F.lit("x" * 51)), scalars.has_kind(F.lit("A.MP4"), scalars.VIDEO_KINDS)).first()
    assert list(row) == [3723.5, "62:05.50", "x" * 50 + "...", True]


def test_srt(spark, tmp_path):
    text = "﻿1\n00:00:01,000 --> 00:00:03,000\nFirst line\nmore\n\n2\n00:00:04,000 --> 00:00:06,000\n \n\n3\n00:00:07,000 --> 00:00:09,000\nLast\n"
    (tmp_path / "a.srt").write_text(text, encoding="utf-8")
    got = [(r["seg_index"], r["start"], r["end"], r["text"]) for r in read_srt(spark, str(tmp_path)).orderBy("seg_index").collect()]
    assert got == [(1, 1.0, 3.0, "First line more"), (3, 7.0, 9.0, "Last")]
