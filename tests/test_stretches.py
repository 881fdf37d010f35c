"""Windows and sums along one media that is cut into short stretches, against plain windows over the whole of it."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from montage.operators import series, shots, stretches

SCORES, VECTORS = "media_id long, idx long, score double", "media_id long, frame_idx long, clip array<double>"
SMOOTH = ((31, 9, -3, -5, 3), (9, 13, 12, 6, -5), (-3, 12, 17, 12, -3))


@pytest.fixture
def short(monkeypatch):
    """Stretches of five places: shorter than what some windows look at on both sides."""
    monkeypatch.setattr(stretches, "STRETCH", 5)
    monkeypatch.setattr(stretches, "RUN", 3)


def made_scores() -> dict[int, list[float]]:
    rng = np.random.default_rng(11)
    return {m: np.round(rng.uniform(0, 3, n), 3).tolist() for m, n in {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 9, 8: 10, 9: 11, 10: 16, 11: 200}.items()}


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([(m, i, x) for m, xs in made_scores().items() for i, x in enumerate(xs)], SCORES).repartition(5)


def smooth(x: list[float]) -> list[float]:
    n = len(x)
    if n < 5:
        return x
    out = []
    for i in range(n):
        if i < 2:
            out.append(np.dot(SMOOTH[i], x[:5]) / 35)
        elif n - 1 - i < 2:
            out.append(np.dot(SMOOTH[n - 1 - i], x[::-1][:5]) / 35)
        else:
            out.append(np.dot(SMOOTH[2], x[i - 2 : i + 3]) / 35)
    return np.round(out, 6).tolist()


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()))


def test_smoothing_and_peaks(short, scores):
    got = rows_of(series.smoothed(scores))
    wanted = [(m, i, y) for m, xs in made_scores().items() for i, y in enumerate(smooth(xs))]
    assert [g[:2] for g in got] == [w[:2] for w in wanted] and np.allclose([g[2] for g in got], [w[2] for w in wanted], atol=2e-6)
    found = []
    for m, xs in made_scores().items():
        y = smooth(xs)
        low = np.percentile(y, 70)
        found += [(m, i) for i in range(len(y)) if len(y) < 3 or (0 < i < len(y) - 1 and y[i] > y[i - 1] and y[i] > y[i + 1] and y[i] >= low - 1e-9)]
    assert [g[:2] for g in rows_of(series.peaks(scores))] == found
    raw = [(m, i) for m, x in made_scores().items() for i in range(1, len(x) - 1) if x[i] > x[i - 1] and x[i] > x[i + 1] and x[i] > np.percentile(x, 75)]
    assert [g[:2] for g in rows_of(series.raw_peaks(scores))] == raw


def test_rolling_patterns_and_steps(short, scores):
    rolled = {g[:2]: g[2] for g in rows_of(series.rolling(scores))}
    kinds, steps = [], {}
    for m, x in made_scores().items():
        for i in range(len(x)):
            assert rolled.pop((m, i)) == pytest.approx(x[i] + np.std(x[max(0, i - 2) : i + 3]), abs=2e-6)
            if i:
                steps[m, i] = pytest.approx(abs(x[i] - x[i - 1]), abs=2e-6)
            if 2 <= i < len(x) - 2:
                b, now, a = x[i - 1 : i + 2]
                kinds += [(m, i, "turn")] * (abs((now - b) - (a - now)) > 0.5)
                kinds += [(m, i, "peak")] * (now > b and now > a and now > 0.8) + [(m, i, "valley")] * (now < b and now < a and b > 1.0)
    assert not rolled and rows_of(series.pattern_changes(scores)) == sorted(kinds)
    assert {g[:2]: g[2] for g in rows_of(shots.deltas(scores))} == steps


def test_candidates_and_picks(short, scores):
    tops, found, picked = {}, [], []
    for m, i, _ in rows_of(series.peaks(scores)):
        tops.setdefault(m, set()).add(i)
    for m, x in made_scores().items():
        n = len(x)
        some = {0, n - 1} | ({n // 3, 2 * n // 3} if n > 5 else set()) | tops.get(m, set())
        if len(some) < 3 and n > 3:
            some |= {k for k in range(1, n) if k % max(n // 5, 1) == 0 and k <= 4 * (n // 5)}
        found += [(m, i) for i in sorted(some)]
        k = min(n, 3)
        picked += [(m, i) for i in sorted({i * (n - 1) // max(k - 1, 1) for i in range(k)})]
    assert rows_of(series.candidates(scores)) == found
    assert [g[:2] for g in rows_of(series.uniform_pick(scores))] == picked


@pytest.mark.parametrize("reach", [1, 2, 3, 7])
def test_places_with_gaps_see_their_neighbours(short, spark, reach):
    rng = np.random.default_rng(12)
    places = {1: rng.choice(4000, 300, replace=False), 2: np.arange(0, 4000, 37), 3: np.arange(3), 4: np.array([17]), 5: rng.choice(250, 200, replace=False), None: np.arange(23)}
    rows = spark.createDataFrame([(m, int(p)) for m, ps in places.items() for p in ps], "media_id long, place long").repartition(4)

    def made(w):
        around = F.collect_list("place").over(w.rowsBetween(-reach, reach))
        return {"around": around, "before": F.lag("place", reach).over(w), "after": F.lead("place", reach).over(w)}

    wanted = rows.withColumns(made(Window.partitionBy("media_id").orderBy("place")))
    text = lambda df: sorted(str(tuple(r)) for r in df.collect())
    got = stretches.along(rows, "place", reach, made)
    assert got.columns == wanted.columns and text(got) == text(wanted)


def test_running_sums_over_stretches(short, spark):
    rng = np.random.default_rng(13)
    data = [(m, int(p), None if p % 7 == 0 else int(p) % 11) for m in (1, 2, None) for p in rng.choice(900, 120, replace=False)] + [(3, None, 4), (3, 2, 5), (3, 1, None)]
    rows = spark.createDataFrame(data, "k long, p long, v int").repartition(6)
    before = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    for value in (F.lit(1), F.col("v")):
        wanted = rows.withColumn("s", F.coalesce(F.sum(value).over(before), F.lit(0)))
        got = stretches.running(rows, "k", F.floor(F.col("p") / stretches.STRETCH), ["p"], value, "s")
        assert got.columns == wanted.columns and sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    none = rows.filter("false")
    assert stretches.running(none, "k", F.col("p"), ["p"], F.lit(1), "s").count() == 0 and stretches.along(none.withColumnRenamed("k", "media_id"), "p", 1, lambda w: {"x": F.lag("p").over(w)}).count() == 0


@pytest.mark.parametrize("size", [3, 64])
def test_nearest_frames_across_bins(spark, monkeypatch, size):
    monkeypatch.setattr(shots, "BIN", size)
    rng = np.random.default_rng(14)
    held = {1: sorted(int(p) for p in rng.choice(500, 25, replace=False)), 2: [400], 3: []}
    spans = [(m, s, int(a), int(a) + 9) for m in held for s, a in enumerate(rng.integers(0, 500, 30))]
    frames = spark.createDataFrame([(m, p) for m, ps in held.items() for p in ps], "media_id long, frame_idx long")
    got = rows_of(shots.nearest_frame(frames, spark.createDataFrame(spans, "media_id long, shot_id long, start_frame long, end_frame long")))
    wanted = []
    for m, s, a, b in spans:
        if held[m]:
            middle = (a + b) // 2
            best = min(held[m], key=lambda p: (abs(p - middle), p))
            wanted.append((m, s, best, abs(best - middle)))
    assert got == sorted(wanted)


def test_one_huge_media_is_many_tasks(spark):
    """Twenty stretches of one media: every window of the plan but that of the ends is spread over all partitions."""
    n = 20 * stretches.STRETCH
    scores = spark.range(n).select(F.lit(1).cast("long").alias("media_id"), F.col("id").alias("idx"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("score"))
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.enabled": "false"}
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        for out in (series.rolling(scores), series.smoothed(scores), shots.deltas(scores)):
            per = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
            assert len(per) == 4 and max(per) < n / 2
        clips = scores.select("media_id", F.col("idx").alias("frame_idx"), F.array("score").alias("clip"))
        assert shots.with_before(clips).filter("before is null").count() == 1
    finally:
        for key in off:
            spark.conf.unset(key)
