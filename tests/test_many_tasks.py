"""Operators whose work on one media is spread over many tasks, against brute force."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from montage.functions.vectors import unit_cosine
from montage.operators import clusters, components, linkage, places, radius, vector_sums

VECTORS = "media_id long, frame_idx long, clip array<double>"


def made_vectors(rng, n: int, centres: int, spread: float, dims: int = 16) -> list[list[float]]:
    middle = rng.normal(size=(centres, dims))
    return (middle[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dims))).tolist()


def test_rows_are_numbered_in_their_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x")).orderBy("x").repartitionByRange(9, "x").sortWithinPartitions("x")
    assert places.numbered(rows).filter("x <> place").count() == 0
    left, right = spark.range(10, 30, numPartitions=4).toDF("a"), spark.range(5, numPartitions=3).select((-F.col("id")).alias("b"))
    assert sorted(map(tuple, places.zipped(left, right).select("place", "a", "b").collect())) == [(i, 10 + i, -i) for i in range(5)]
    assert places.zipped(left, right.filter("false")).count() == 0


def test_vector_statistics(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 13)) + 100
    rows = spark.createDataFrame([(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, 5, [1.0, 2.0])] + [(3, 1, [1.0]), (3, 2, [3.0, 4.0])], VECTORS).repartition(8)
    got = {r["media_id"]: r for r in vector_sums.statistics(rows, ["media_id"], "clip", "frame_idx").collect()}
    assert got[1]["mean"] == pytest.approx(x.mean(0).tolist()) and got[1]["deviation"] == pytest.approx(x.std(0).tolist())
    assert got[1]["mean_delta"] == pytest.approx(np.diff(x, axis=0).mean(0).tolist(), abs=1e-9)
    assert (got[2]["n"], got[2]["mean"], got[2]["deviation"], got[2]["mean_delta"]) == (1, [1.0, 2.0], [0.0, 0.0], [0.0, 0.0])
    assert got[3]["mean"] == [2.0, 4.0]
    plan = vector_sums.means(rows, ["media_id"], "clip", 13)._jdf.queryExecution().executedPlan().toString()
    assert "partial_avg" in plan and "SortAggregate" not in plan


def brute_pairs(v: list[list[float]], most: float) -> set:
    u = np.array(v)
    n = np.linalg.norm(u, axis=1, keepdims=True)
    u = u / np.where(n == 0, 1, n)
    d = np.round(1 - np.clip(u @ u.T, -1, 1), 6)
    return {(a, b) for a in range(len(u)) for b in range(a + 1, len(u)) if d[a, b] <= most}


@pytest.mark.parametrize("most", [0.02, 0.15, 0.4, 1.0, 1.3])
def test_near_pairs_against_brute_force(spark, most):
    rng = np.random.default_rng(4)
    groups = {1: made_vectors(rng, 150, 5, 0.2), 2: made_vectors(rng, 40, 40, 1.0), 3: [[0.0] * 16, *made_vectors(rng, 3, 1, 0.1), [0.0] * 16], 4: [[1.0] * 16] * 12 + [[-1.0] * 16] * 2, 5: [[1.0] * 16]}
    rows = spark.createDataFrame([(m, i, v) for m, vs in groups.items() for i, v in enumerate(vs)], VECTORS)
    found = radius.near_pairs(rows, most).collect()
    got = {(r["media_id"], r["a"], r["b"]) for r in found}
    assert len(found) == len(got)
    assert got == {(m, *p) for m, vs in groups.items() for p in brute_pairs(vs, most)}
    plain = {(r["media_id"], r["a"], r["b"]): r["dist"] for r in clusters.pairs(rows).collect()}
    assert all(plain[(r["media_id"], r["a"], r["b"])] == r["dist"] for r in found)


def test_few_pairs_are_formed_of_clustered_vectors(spark):
    """Of one media of 1500 rows in 40 clusters, under a tenth of the square; labels are those of all pairs."""
    rng = np.random.default_rng(5)
    n = 1500
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(made_vectors(rng, n, 40, 0.05, 32))], VECTORS)
    assert radius.met_pairs(rows, 0.15).count() < n * n / 10
    near = radius.near_pairs(rows, 0.15)
    # cells and rings are dealt to tasks, not media
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for key, value in off.items():
        spark.conf.set(key, value)
    try:
        assert radius.near_pairs(rows, 0.15).select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        for key in off:
            spark.conf.unset(key)
    found = [r["cluster_id"] for r in clusters.density_clusters(rows, near, 0.15).orderBy("frame_idx").collect()]
    every = clusters.pairs(rows)
    assert found == [r["cluster_id"] for r in clusters.density_clusters(rows, every, 0.15).orderBy("frame_idx").collect()] and max(found) == 39


def test_adaptive_eps_without_all_pairs(spark):
    rng = np.random.default_rng(6)
    groups = {1: made_vectors(rng, 60, 4, 0.2), 2: made_vectors(rng, 30, 30, 1.0), 3: [[1.0] * 16, [-1.0] * 16], 4: [[1.0] * 16], 5: [[1.0] * 16] * 3 + [[-1.0] * 16], 6: made_vectors(rng, 9, 3, 0.7), 7: made_vectors(rng, 2, 2, 0.5)}
    groups[8] = [[1.0, 0.1] + [0.0] * 14, [1.0] + [0.0] * 15, [0.6, 0.8] + [0.0] * 14, [0.0] * 15 + [1.0]]
    rows = spark.createDataFrame([(m, i, v) for m, vs in groups.items() for i, v in enumerate(vs)], VECTORS)
    plain = {r["media_id"]: r["eps"] for r in clusters.adaptive_eps(clusters.pairs(rows)).collect()}
    assert {r["media_id"]: r["eps"] for r in radius.adaptive_eps(rows, radius.near_pairs(rows, radius.ENOUGH)).collect()} == plain
    assert 3 not in plain and 4 not in plain and len(set(plain.values())) > 3


def test_components_of_chains_stars_and_loops(spark):
    rng = np.random.default_rng(7)
    edges = [(1, i, i + 1) for i in range(100)] + [(2, 0, i) for i in range(1, 50)] + [(2, 60, 60), (3, 5, 4), (3, 4, 5), (3, 9, 8), (3, 8, 5)]
    edges += [(4, int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2))]
    head: dict = {}

    def find(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for m, a, b in edges:
        if a != b:
            x, y = find((m, a)), find((m, b))
            head[max(x, y)] = min(x, y)
    got = {(r["media_id"], r["v"]): r["label"] for r in components.components(spark.createDataFrame(edges, "media_id long, a long, b long")).collect()}
    assert got == {k: find(k)[1] for k in head}
    assert components.components(spark.createDataFrame([], "media_id long, a long, b long")).count() == 0


def test_linkage_by_rounds_is_average_linkage(spark):
    rng = np.random.default_rng(8)
    groups = {1: (made_vectors(rng, 60, 6, 0.6, 8), 3), 2: (rng.normal(size=(30, 5)).tolist(), 1), 3: (rng.normal(size=(12, 3)).tolist(), 12), 4: ([[1.0, 0.0]], 1), 5: (rng.normal(size=(25, 6)).tolist(), 7)}
    rows = spark.createDataFrame([(m, i, v) for m, (vs, _) in groups.items() for i, v in enumerate(vs)], VECTORS)
    wanted = {m: clusters.average_linkage(np.array(vs), k).tolist() for m, (vs, k) in groups.items()}
    counts = spark.createDataFrame([(m, len(vs), k) for m, (vs, k) in groups.items()], "media_id long, n long, k long")
    found = linkage.linked(rows, counts).orderBy("media_id", "frame_idx").collect()
    assert {m: [r["cluster_id"] for r in found if r["media_id"] == m] for m in groups} == wanted


def test_large_media_are_linked_by_rounds(spark):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(m, i, v) for m, n in ((1, 50), (2, 20)) for i, v in enumerate(made_vectors(rng, n, 4, 0.4, 8))], VECTORS)
    one = {tuple(r) for r in clusters.speaker_clusters(rows).collect()}
    assert {tuple(r) for r in clusters.speaker_clusters(rows, whole=30).collect()} == one and len(one) == 70


def test_blocks_give_all_pairs_links_and_nearest_of_odd_vectors(spark, monkeypatch):
    """Several blocks and strips of a media; null vectors, null components, unlike lengths, zeros, copies, rows without a media."""
    monkeypatch.setattr(radius, "LEAST", 16)
    rng = np.random.default_rng(10)
    some = made_vectors(rng, 90, 8, 0.4)
    odd = [None, [1.0] * 15 + [None], [1.0, 2.0], [0.0] * 16, [float("nan")] * 16, *[some[0]] * 5]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(some)] + [(2, i, v) for i, v in enumerate(some + odd)] + [(None, i, v) for i, v in enumerate(some[:3])], VECTORS)
    units = radius.units(rows)
    one, two = units.toDF("media_id", "a", "u"), units.toDF("media_id", "b", "v")
    dist = F.round(1 - unit_cosine(F.col("u"), F.col("v")), 6).alias("dist")
    plain = {tuple(r) for r in one.join(two, "media_id").filter("a < b").select("media_id", "a", "b", dist).collect()}
    every = [tuple(r) for r in radius.every_pair(rows).collect()]
    assert set(every) == plain and len(every) == len(plain) == 90 * 89 // 2 + 100 * 99 // 2
    assert {tuple(r) for r in radius.near_pairs(rows, 0.3).collect()} == {p for p in plain if p[3] <= 0.3}
    by_pairs = clusters.density_clusters(rows, radius.every_pair(rows), 0.3)
    assert {tuple(r) for r in clusters.labelled(rows, radius.links(rows, 0.3)).collect()} == {tuple(r) for r in by_pairs.collect()}
    assert {tuple(r) for r in clusters.eps_of(radius.nearest(rows)).collect()} == {tuple(r) for r in clusters.adaptive_eps(radius.every_pair(rows)).collect()}


def test_rounding_is_that_of_spark(spark):
    x = np.concatenate([np.arange(2000) / 2e6, np.random.default_rng(11).random(5000) * 2, np.nextafter(np.arange(500) / 2e6, 1), [2.675e-6, 1.0000005, 1.9999995]])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double")
    assert [r[0] for r in rows.select(F.round("x", 6)).collect()] == radius.rounded(x).tolist()


def test_links_of_a_dense_media_are_a_forest(spark):
    """All pairs of 1500 rows are near; a block pair gives a row at most for each of its rows, not for each pair."""
    rng = np.random.default_rng(12)
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(made_vectors(rng, 1500, 1, 0.01))], VECTORS)
    assert radius.links(rows, 0.7).count() < 1500 * 7


def test_linkage_rounds_with_copies_and_zeros(spark):
    """Every merge but the last few by rounds, copies and zero vectors among the rows."""
    rng = np.random.default_rng(13)
    groups = {1: (made_vectors(rng, 80, 6, 0.6, 8), 5), 2: (rng.normal(size=(40, 5)).tolist(), 2), 3: (rng.normal(size=(12, 3)).tolist(), 12)}
    copied = [v for v in made_vectors(rng, 12, 12, 0.1, 8) for _ in range(9)]
    groups |= {4: (copied, 4), 5: ([[1.0, 0.0]] * 30, 28), 6: ([*made_vectors(rng, 20, 2, 0.1, 4), [0.0] * 4, [0.0] * 4], 3)}
    rows = spark.createDataFrame([(m, i, v) for m, (vs, _) in groups.items() for i, v in enumerate(vs)], VECTORS)
    counts = spark.createDataFrame([(m, len(vs), k) for m, (vs, k) in groups.items()], "media_id long, n long, k long")
    found = linkage.linked(rows, counts, 20).orderBy("media_id", "frame_idx").collect()
    got = {m: [r["cluster_id"] for r in found if r["media_id"] == m] for m in groups}
    assert got == {m: clusters.average_linkage(np.array(vs), k).tolist() for m, (vs, k) in groups.items()}


def test_linkage_of_thousands_of_rows_is_a_few_jobs(spark):
    """A media over the size of a table of distances is one task, whose tree is that of the distances; no job per round."""
    rng = np.random.default_rng(14)
    vectors = made_vectors(rng, 2100, 2100, 1.0)
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(vectors)], VECTORS)
    spark.sparkContext.setJobGroup("linkage", "")
    try:
        found = clusters.speaker_clusters(rows).orderBy("frame_idx").collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("linkage")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) < 12
    assert [int(r["speaker_id"][-2:]) for r in found] == clusters.average_linkage(np.array(vectors), 8).tolist()


def test_linkage_by_rounds_over_blocks(spark, monkeypatch):
    """Rounds ask only for the nearest of clusters that have lost theirs; blocks, copies, zeros and rings give the same tree."""
    monkeypatch.setattr(linkage, "BLOCK", 32)
    rng = np.random.default_rng(15)
    groups = {1: made_vectors(rng, 90, 90, 1.0), 2: [v for v in made_vectors(rng, 50, 3, 0.5) for _ in range(3)], 3: [*made_vectors(rng, 40, 4, 0.1), [0.0] * 16, [0.0] * 16], 4: made_vectors(rng, 15, 3, 0.5)}
    rows = spark.createDataFrame([(m, i, v) for m, vs in groups.items() for i, v in enumerate(vs)], VECTORS)
    asked, plain = [], linkage.nearest

    def counted(now):
        asked.append(now.filter("asks").count())
        return plain(now)

    monkeypatch.setattr(linkage, "nearest", counted)
    found = clusters.speaker_clusters(rows, whole=10, most=35).orderBy("media_id", "frame_idx").collect()
    wanted = {m: clusters.average_linkage(np.array(vs), min(8, max(2, len(vs) // 15))).tolist() for m, vs in groups.items()}
    assert {m: [int(r["speaker_id"][-2:]) for r in found if r["media_id"] == m] for m in groups} == wanted
    assert len(asked) > 2 and asked[0] == 182 and asked[-1] < 60
    # each is nearest to the next one, as rounding may have it
    near = spark.createDataFrame([(1, 0, 1, 0.5, 0.0), (1, 1, 2, 0.5, 0.0), (1, 2, 0, 0.5, 0.0), (2, 3, 4, 0.2, 0.3), (2, 4, 3, 0.2, 0.0)], "media_id long, i long, j long, height double, high double")
    assert {tuple(r) for r in linkage.reciprocal(near, 3).collect()} == {(1, 0, 1, 0.5, 3), (2, 3, 4, 0.3, 3)}


def test_tree_keeps_no_distances():
    rng = np.random.default_rng(16)
    u = np.array(made_vectors(rng, 6000, 6000, 1.0, 4))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    tracemalloc.start()
    height = linkage.tree(u, np.ones(len(u)), np.zeros(len(u)))[2]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(height) == 5999 and most < 6000**2 * 8 / 2


def test_labels_of_odd_vectors():
    some = [None, [1.0, None], [1.0], [0.0, 2.0], [float("inf"), 0.0]]
    assert linkage.labels(linkage.matrix(some), 3).tolist() == [0, 1, 1, 2, 1]
    assert linkage.labels(linkage.matrix([]), 1).tolist() == [] and linkage.matrix([None, None]).shape == (2, 0)


def test_all_pairs_of_large_blocks_leave_by_distance(spark, monkeypatch):
    """Groups of many pairs come in the order of their distances, which halves their files; rows are those of small groups."""
    rng = np.random.default_rng(17)
    some = made_vectors(rng, 300, 20, 0.4)
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(some)] + [(2, i, v) for i, v in enumerate(some[:40] + [None, [1.0, 2.0], [0.0] * 16])], VECTORS)
    plain = [tuple(r) for r in radius.every_pair(rows).collect()]
    monkeypatch.setattr(radius, "IN_ORDER", 5000)
    found = radius.every_pair(rows)
    told = [tuple(r) for r in found.collect()]
    assert sorted(told) == sorted(plain) and len(told) == 300 * 299 // 2 + 43 * 42 // 2
    falls = [sum(a > b for a, b in zip(d, d[1:], strict=False)) for d in ([r[0] for r in part] for part in found.filter("media_id = 1").select("dist").rdd.glom().collect())]
    assert sum(falls) <= 2


def test_distances_from_matrices_are_those_of_sums():
    """To the last bit, also where a sum in another order is rounded otherwise."""
    rng = np.random.default_rng(18)
    u = rng.normal(size=(150, 64))
    # products of a half of the last place and about it
    x = 1 - (rng.integers(0, 2_000_000, 300) + 0.5) / 1e6
    parts = rng.normal(size=(300, 63)) * 0.1
    v = np.concatenate([parts, (x - parts.sum(1))[:, None]], axis=1)
    one = radius.Rows(np.arange(151), np.concatenate([u / np.linalg.norm(u, axis=1, keepdims=True), np.ones((1, 64))]), np.full(151, 64))
    two = radius.Rows(np.arange(300), v, np.full(300, 64))
    i, j = np.repeat(np.arange(151), 300), np.tile(np.arange(300), 151)
    wanted = radius.distances(radius.summed(one.u, two.u, i, j))
    assert np.concatenate([d.ravel() for _, d in radius.strips(one, two)]).tolist() == wanted.tolist()
    for made in (radius.as_they_come, radius.in_order):
        i, j, dist = (np.concatenate(p) for p in zip(*made(one, two, False), strict=True))
        assert dist.tolist() == wanted.reshape(151, 300)[i, j].tolist() and len(set(zip(i.tolist(), j.tolist(), strict=True))) == 151 * 300
