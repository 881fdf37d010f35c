"""The keyframe plan on a test table, against one written frame by frame."""

from __future__ import annotations

from collections import defaultdict

import numpy as np

from montage import catalogue
from montage.operators import shots
from montage.plans import keyframes
from montage.sources.tables import frames, motion

SF = "/root/testdata/sf0.01"


def smoothed(x: np.ndarray) -> np.ndarray:
    if len(x) < 5:
        return np.round(x, 6)
    out = np.convolve(x, np.array([-3, 12, 17, 12, -3]) / 35, "same")
    t = np.arange(5)
    out[:2], out[-2:] = np.polyval(np.polyfit(t, x[:5], 2), [0, 1]), np.polyval(np.polyfit(t, x[-5:], 2), [3, 4])
    return np.round(out, 6)


def spaced(x: np.ndarray) -> list[int]:
    n, s = len(x), smoothed(x)
    if n < 3:
        return list(range(n))
    for share, least, part in ((70, 3, 20), (50, 2, 30)):
        tops = [i for i in range(1, n - 1) if s[i] > s[i - 1] and s[i] > s[i + 1] and s[i] >= np.percentile(s, share)]
        if tops:
            kept: list[int] = []
            for i in sorted(tops, key=lambda i: (-s[i], i)):
                if all(abs(i - k) >= max(least, n // part) for k in kept):
                    kept.append(i)
            return kept
    return []


def candidate_places(x: np.ndarray) -> list[int]:
    n = len(x)
    some = {0, n - 1} | ({n // 3, 2 * n // 3} if n > 5 else set()) | set(spaced(x))
    if len(some) < 3 and n > 3:
        some |= {r for r in range(1, n) if r % max(n // 5, 1) == 0 and r <= 4 * (n // 5)}
    return sorted(some)


def chosen_of(places: list[int], clips: np.ndarray, eps: float) -> list[tuple]:
    """(frame, cluster, confidence, method) of a shot's candidates."""
    n = len(places)
    u = clips / np.linalg.norm(clips, axis=1, keepdims=True)
    d = np.round(1 - np.clip(u @ u.T, -1, 1), 6)
    near = [min((d[i, j] for j in range(n) if j != i), default=2.0) for i in range(n)]
    near = [x for x in near if x < 2.0]
    radius = round(min(0.3, max(0.05, 1.5 * float(np.median(near)))), 6) if near else eps
    head = list(range(n))
    for _ in range(n):
        head = [min([head[i]] + [head[j] for j in range(n) if j != i and d[i, j] <= radius]) for i in range(n)]
    alone = {i for i in range(n) if head.count(head[i]) == 1 and not any(j != i and d[i, j] <= radius for j in range(n))}
    names = sorted({head[i] for i in range(n) if n < 6 or i not in alone})
    out = []
    for c, h in enumerate(names):
        mine = [i for i in range(n) if head[i] == h]
        far = np.linalg.norm(u[mine] - u[mine].mean(axis=0), axis=1)
        best = min(range(len(mine)), key=lambda k: (round(far[k], 9), places[mine[k]]))
        most = 1.0 if len(mine) == 1 else far.max()
        out.append((places[mine[best]], c, round(min(1.0, max(0.3, 1 - round(far[best], 9) / (most + 1e-8))), 4), "cluster_center"))
    out += [(places[i], -1, 0.6, "noise_point") for i in alone if n >= 6]
    return [(p, c, 0.8, "single") for p, c, _, _ in out] if n == 1 else out


def test_keyframes_frame_by_frame(spark):
    rows, scores, found = frames(spark, SF), motion(spark, SF), shots.histogram_shots(frames(spark, SF), catalogue.GAP)
    clip, moves = defaultdict(dict), defaultdict(dict)
    for r in rows.collect():
        clip[r["media_id"]][r["frame_idx"]] = np.array(r["clip"], dtype=float)
    for r in scores.collect():
        moves[r["media_id"]][r["idx"]] = r["score"]
    want, every = set(), found.collect()
    for r in every:
        m, k = r["media_id"], min(4, max(1, r["duration_frames"] // 30))
        inside = sorted(i for i in clip[m] if r["start_frame"] <= i <= r["end_frame"])
        if inside:
            places = [inside[i] for i in candidate_places(np.array([moves[m].get(i, 0.0) for i in inside]))]
            best = chosen_of(places, np.array([clip[m][i] for i in places]), keyframes.EPS)
        else:
            middle = (r["start_frame"] + r["end_frame"]) // 2
            best = [(min(clip[m], key=lambda i: (abs(i - middle), i)), 0, 0.3, "closest_fallback")]
        want |= {(m, r["shot_id"], *b) for b in sorted(best, key=lambda b: (-b[2], b[0]))[:k]}
    got = {(r["media_id"], r["shot_id"], r["frame_idx"], r["cluster_id"], r["confidence"], r["selection_method"]) for r in keyframes.keyframes(rows, scores, found, 4).collect()}
    assert got == want and len(want) >= len(every)
