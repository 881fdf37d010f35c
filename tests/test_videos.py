from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from montage.operators import clusters, draws, sampling, shots
from montage.plans import dialogue, settings
from montage.sources.subtitles import read_srt


def test_settings():
    fast = settings.preset("fast")
    assert (fast.target_fps, fast.cluster_eps, fast.output_resolution) == (5, 0.2, (512, 512)) and fast.as_dict()["image_quality"] == 95
    with pytest.raises(ValueError, match="no such preset"):
        settings.preset("slow")
    with pytest.raises(ValueError, match="image_quality"):
        settings.Settings(image_quality=0)
    with pytest.raises(TypeError):
        fast.changed(nothing=1)


def test_sampling_of_odd_videos(spark):
    videos = spark.createDataFrame([(1, 0.0, 5), (2, 25.0, 0), (3, 2.5, 9), (4, 10.0, 25)], "media_id long, fps double, total long")
    got = {r["media_id"]: r["n"] for r in sampling.strided(videos, sampling.interval(F.col("fps"), settings.Settings())).groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {1: 5, 3: 9, 4: 25}
    rows = sampling.random_frames(videos, 3).collect()
    # 9 frames at 2.5 a second are 3 whole seconds: 2, 3 and 2 frames, of which the last one and a half are dropped
    assert sorted((r["second"], r["frame_idx"]) for r in rows if r["media_id"] == 3) == [(0, 0), (0, 1), (1, 2), (1, 3), (1, 4), (2, 5), (2, 6)]
    assert sorted(r["second"] for r in rows if r["media_id"] == 4) == [0, 0, 0, 1, 1, 1] and max(r["frame_idx"] for r in rows if r["media_id"] == 4) < 20
    assert {r["media_id"] for r in rows} == {3, 4}


def test_nearest_frame_at_ends_and_ties(spark):
    frames = spark.createDataFrame([(1, 2), (1, 4), (1, 10)], "media_id long, frame_idx long")
    found = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 2, 4), (1, 2, 6, 9), (1, 3, 30, 40), (2, 0, 0, 9)], "media_id long, shot_id int, start_frame long, end_frame long")
    assert sorted(map(tuple, shots.nearest_frame(frames, found).collect())) == [(1, 0, 2, 2), (1, 1, 2, 1), (1, 2, 4, 3), (1, 3, 10, 25)]


def test_vectors_with_nan_do_not_resemble_all(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, 0, [nan, 0.0]), (1, 1, [1.0, 0.0]), (1, 2, [0.0, float("inf")])], "media_id int, frame_idx long, clip array<double>")
    assert sorted((r["a"], r["b"], r["dist"]) for r in clusters.pairs(rows).collect()) == [(0, 1, 1.0), (0, 2, 1.0), (1, 2, 1.0)]
    assert {r["cluster_id"] for r in clusters.threshold_clusters(rows).collect()} == {-1}


def test_dialogue(spark):
    """Two voices told apart; segments without text, without a vector or too short are left out."""
    rng = np.random.default_rng(2)
    segments, voices, wanted = [], [], {}
    for i in range(20):
        voice = i % 3 == 0
        segments.append((1, i, float(i), i + (0.4 if i == 7 else 0.9), " \n" if i == 5 else f"text {i}", "role"))
        vector = [1.0 - voice + rng.normal(0, 0.01), float(voice) + rng.normal(0, 0.01)]
        voices.append((1, i, None if i == 4 else vector))
        if i not in (4, 5, 7):
            wanted[i] = voice
    segments = spark.createDataFrame(segments, "media_id long, seg_index int, start double, end double, text string, speaker string")
    voices = spark.createDataFrame(voices[:19], "media_id long, seg_index int, vector array<double>")
    rows = dialogue.exports(segments, voices, 2).collect()
    wanted.pop(19)
    assert {r["seg_index"]: r["speaker"] == "speaker_00" for r in rows} == wanted
    for s in ("speaker_00", "speaker_01"):
        own = sorted((r["start"], r["file"]) for r in rows if r["speaker"] == s)
        assert [f for _, f in own] == [f"{s}_{k:03d}" for k in range(len(own))]


def test_subtitle_encodings(spark, tmp_path):
    cue = "1\n00:00:01,000 --> 00:00:02,500\n你好 朋友\n\n2\n00:00:03,000 --> 00:00:04,000\n\n"
    for name, data in (("a", cue.encode("gbk")), ("b", cue.encode("utf-8-sig")), ("c", cue.replace("\n", "\r\n").encode())):
        (tmp_path / f"{name}.srt").write_bytes(data)
    rows = read_srt(spark, str(tmp_path)).collect()
    assert [(r["seg_index"], r["start"], r["end"], r["text"]) for r in rows] == [(1, 1.0, 2.5, "你好 朋友")] * 3


def test_frame_info_forms_no_frames(spark):
    """A video of more frames than could be formed; places before, at and after the ends."""
    videos = spark.createDataFrame([(1, 30.0, 10**15), (2, 0.0, 4), (3, 25.0, 0)], "media_id long, fps double, total long")
    chosen = spark.createDataFrame([(1, 0), (1, 10**14), (1, 10**15), (1, -1), (2, 3), (2, 4), (3, 0), (4, 0)], "media_id long, sampled_idx long")
    got = sampling.with_frame_info(chosen, videos, sampling.interval(F.col("fps"), settings.Settings())).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0), (1, 10**14, 3 * 10**14, 10.0**13), (2, 3, 3, 0.0)]


def test_random_frames_are_those_of_least_md5(spark):
    """Short and long names, one of null, names of several blocks of MD5, seconds of one frame and of very many."""
    made = [("7", 24.0, 100), ("é" * 24, 30.0, 65), ("n" * 52, 29.97, 200), ("m" * 300, 12.0, 1201), (None, 25.0, 60), ("", 1.0, 12), ("big", 90_000.0, 180_001), ("b:2", 2.5, 9), ("l", 1.5, 400)]
    videos = spark.createDataFrame(made, "media_id string, fps double, total long")
    want = set()
    for m, fps, total in made:
        for second in range(int(total // fps)):
            frames = range(int(second * fps // 1), min(int((second + 1) * fps // 1), total))
            order = sorted(frames, key=lambda i: (hashlib.md5((f"{m}:{i}" if m is not None else f"{i}").encode()).hexdigest(), i))
            want |= {(m, second, i) for i in order[:3]}
    got = [tuple(r) for r in sampling.random_frames(videos, 3).collect()]
    assert len(got) == len(want) and set(got) == want


def test_digests_of_many_frames_at_once():
    rng = np.random.default_rng(16)
    heads = [b"x" * int(n) for n in rng.integers(0, 70, 200)]
    row, idx = np.arange(draws.MESSAGES + 500) % 200, rng.integers(0, 10 ** rng.integers(1, 19, draws.MESSAGES + 500))
    idx[:4] = 0, 9, 10, 10**18
    high, low = draws.digests(heads, row, idx)
    for r, i, h, s in zip(row, idx, high, low):
        assert f"{h:016x}{s:016x}" == hashlib.md5(heads[r] + str(i).encode()).hexdigest()
    # the chosen are the same where only the last bits of a digest's half differ
    same = np.zeros(6, np.uint64)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(draws, "digests", lambda *_: (same, np.array([5, 1, 3, 9, 9, 2], np.uint64)))
        assert [x.tolist() for x in draws.least([b"a"], np.array([0, 0]), np.array([0, 10]), np.array([3, 3]), 2)] == [[0, 0, 1, 1], [1, 2, 12, 10]]
