"""A configuration changes what the keyframe plan does: every field of Settings, and the plan's progress."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from montage.operators import series, shots
from montage.plans import keyframes
from montage.plans.progress import Progress
from montage.plans.settings import PRESETS, Settings, preset
from montage.sources import documents, results

SHOTS = "media_id long, shot_id int, start_frame long, end_frame long, duration_frames long"


@pytest.fixture(scope="module")
def film(spark):
    """Two media: one of 240 frames in shots of many kinds, one of two opposite frames without a rate."""
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(8, 6))
    made = [(1, i, (middle[i // 30] + 0.02 * rng.normal(size=6)).tolist()) for i in range(240)] + [(2, 0, [1.0] * 6), (2, 1, [-1.0] * 6)]
    frames = spark.createDataFrame(made, "media_id long, frame_idx long, clip array<double>").cache()
    motion = spark.createDataFrame([(1, i, float(abs(np.sin(i / 3)) + (i % 17 == 0))) for i in range(240)], "media_id long, idx long, score double").cache()
    found = spark.createDataFrame([(1, 0, 0, 90, 90), (1, 1, 90, 95, 5), (1, 2, 95, 240, 4000), (2, 0, 0, 2, 20)], SHOTS).cache()
    videos = spark.createDataFrame([(1, 24.0, 240, 3840, 2160), (2, 0.0, 2, 640, 480)], "media_id long, fps double, total long, width int, height int").cache()
    return frames, motion, found, videos


BASE = Settings(max_shot_duration=5000, target_fps=12)


@pytest.fixture(scope="module")
def plain(film):
    return rows_of(film, BASE)


def rows_of(film, how: Settings) -> list:
    return sorted(keyframes.extracted(*film, how).collect(), key=lambda r: (r["media_id"], r["shot_id"], r["frame_idx"]))


def test_timestamps_are_those_of_the_media(plain):
    assert {r["media_id"] for r in plain} == {1, 2}
    assert all(r["timestamp"] == (round(r["frame_idx"] / 24, 4) if r["media_id"] == 1 else 0.0) and r["fps"] == (24.0 if r["media_id"] == 1 else 0.0) for r in plain)
    assert all(r["frame_idx"] % 2 == 0 for r in plain if r["media_id"] == 1)
    # the shot of five frames is too short, so it has no keyframes
    assert {(r["media_id"], r["shot_id"]) for r in plain} == {(1, 0), (1, 2), (2, 0)}


@pytest.mark.parametrize("change", [{"max_keyframes_per_shot": 1}, {"cluster_eps": 2.0}, {"enable_shot_filtering": False}])
def test_settings_of_the_plan(film, plain, change):
    got = rows_of(film, BASE.changed(**change))
    if "max_keyframes_per_shot" in change:
        assert len(got) == 3 and len(plain) > 4
    elif "cluster_eps" in change:
        # two opposite frames tell no radius of their own
        assert len([r for r in got if r["media_id"] == 2]) == len({r["cluster_id"] for r in got if r["media_id"] == 2}) == 1
        assert [r["cluster_id"] for r in keyframes.keyframes(film[0].filter("media_id = 2"), film[1], film[2].withColumn("duration_frames", F.lit(900)), 30).collect() if r["shot_id"] == 0] in ([0, 1], [1, 0])
    else:
        assert {(r["media_id"], r["shot_id"]) for r in got} == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_settings_of_lengths(film):
    kept = lambda how: {(r["media_id"], r["shot_id"]) for r in shots.usable(film[2], how.min_shot_duration, how.max_shot_duration).collect()}
    assert kept(BASE) == {(1, 0), (1, 2), (2, 0)}
    assert kept(BASE.changed(min_shot_duration=5)) == {(1, 0), (1, 1), (1, 2), (2, 0)} and kept(Settings()) == {(1, 0), (2, 0)}


def test_settings_of_sampling(film):
    frames, _, _, videos = film
    seen = lambda **change: [r["frame_idx"] for r in keyframes.looked_at(frames, videos, Settings(**change)).filter("media_id = 1").orderBy("frame_idx").collect()]
    assert seen(target_fps=12) == list(range(0, 240, 2)) and seen(target_fps=6) == list(range(0, 240, 4))
    assert seen(sampling_strategy="seconds") == list(range(0, 240, 24)) and seen(sampling_strategy="seconds", frames_per_second=3) == list(range(0, 240, 8))
    assert seen(sampling_strategy="fps_ratio", fps_ratio=4.0) == list(range(0, 240, 4)) and seen(sampling_strategy="fps_ratio") == list(range(0, 240, 3))
    assert len(seen(sampling_strategy="random_seconds")) == 30 and len(seen(sampling_strategy="random_seconds", random_select_count=5)) == 50


def test_settings_of_pictures(film):
    frames, motion, found, videos = film
    few = (frames.filter("media_id = 2"), motion, found.filter("media_id = 2"), videos.withColumns({"width": F.lit(3840), "height": F.lit(2160)}))
    sizes = lambda **change: {(r["width"], r["height"], r["image_quality"]) for r in rows_of(few, Settings(**change))}
    assert sizes() == {(512, 512, 95)}
    assert sizes(output_resolution=(768, 700), image_quality=80) == {(768, 700, 80)}
    assert sizes(preserve_original_resolution=True) == {(1920, 1080, 95)} and sizes(preserve_original_resolution=True, max_resolution=(400, 400)) == {(400, 225, 95)}


def test_every_field_is_read():
    """Each is one of those that the tests above change."""
    tested = {
        "max_keyframes_per_shot", "cluster_eps", "enable_shot_filtering", "min_shot_duration", "max_shot_duration", "target_fps", "sampling_strategy", "frames_per_second",
        "fps_ratio", "random_select_count", "output_resolution", "image_quality", "preserve_original_resolution", "max_resolution",
    }
    assert set(Settings().as_dict()) == tested and all(set(v) <= tested for v in PRESETS.values())
    assert preset("quality").output_resolution == (768, 768)


def test_progress_and_metadata_of_a_plan(spark, film, tmp_path):
    frames, motion, found, videos = film
    seen = []
    progress = Progress(len(keyframes.STAGES), lambda s: seen.append((s.stage, s.percent)))
    chosen = keyframes.extracted(frames, motion, found, videos, BASE, progress)
    assert seen == [(stage, 100 * (i + 1) // 6) for i, stage in enumerate(keyframes.STAGES)]
    assert next(s.rows for s in progress.log if s.stage == "frames of shots") > 100
    info = keyframes.processing(chosen, found, frames)
    named = spark.createDataFrame([(1, "a.mp4"), (2, "b.mp4")], "media_id long, path string")
    documents.write(str(tmp_path), documents.metadata(chosen, named, BASE, "now", info, plain=True), documents.keyframes_csv(chosen, named, plain=True))
    got = results.report(spark, str(tmp_path)).collect()
    assert {(r["run"], r["shots_covered"]) for r in got} == {("a", 2), ("b", 1)}


def test_scores_that_are_no_numbers_give_raw_peaks(spark):
    made = [(1, i, x) for i, x in enumerate([0.0, 5.0, 0.0, 4.0, 0.0, float("nan"), 0.0, 9.0, 0.0])] + [(2, i, float(i % 5 == 2)) for i in range(60)]
    rows = spark.createDataFrame(made, "media_id long, idx long, score double")
    got = {m: sorted(r["idx"] for r in series.spaced_peaks(rows).collect() if r["media_id"] == m) for m in (1, 2)}
    assert got[1] == sorted(r["idx"] for r in series.raw_peaks(rows).filter("media_id = 1").collect())
    assert got[2] and all(b - a >= 3 for a, b in zip(got[2], got[2][1:], strict=False))


def test_sizes_of_folders_hold_what_lies_below(spark, tmp_path):
    for name, n in (("a.bin", 1), ("x/b.bin", 10), ("x/y/c.bin", 100), ("x/y/d.bin", 1000), ("z/w/v/e.bin", 10_000)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * n)
    got = {r["folder"]: (r["files"], r["bytes"]) for r in results.tree_sizes(results.listing(spark, str(tmp_path)), str(tmp_path)).collect()}
    assert got == {"": (5, 11111), "x": (3, 1110), "x/y": (2, 1100), "z": (1, 10_000), "z/w": (1, 10_000), "z/w/v": (1, 10_000)}
