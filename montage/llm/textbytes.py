"""Words and shingles of many texts at once, as 64-bit hashes computed by numpy over their joined bytes.

Inside tasks only: a batch of texts becomes one byte array, so there is no Python loop over words. A word's hash is
sum(T[byte] * P^k) mod 2^64 with a random table T and odd P, taken from prefix sums, then mixed; a shingle's hash mixes
its words' hashes. Equal inputs always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once (one longer text is handled alone); arrays in use are some 60 times as large at most.
CHUNK = 1 << 19

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_COEFFICIENTS = _RNG.integers(1, 2**63, size=64, dtype=np.uint64) * U(2) + U(1)
#: The six white-space bytes, and bytes with A-Z in lower case.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWERED_TABLE = _TABLE[_LOWER]
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0 .. P^n and their inverses mod 2^64."""
    if "p" not in _powers or len(_powers["p"]) <= n:
        size = max(n + 1, CHUNK + (CHUNK >> 2))
        for k, base in (("p", _BASE), ("q", pow(_BASE, -1, 2**64))):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers["p"], _powers["q"]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string array; nulls are empty."""
    a = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    offsets = np.frombuffer(a.buffers()[1], dtype=np.int64, count=len(a) + 1, offset=a.offset * 8) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], dtype=np.uint8) if len(a) and a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most `most` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def separators(kept: str) -> np.ndarray:
    """Bytes that end a word: all ASCII ones but those of `kept`; what is beyond ASCII belongs to words."""
    out = np.arange(256) < 128
    out[[ord(c) for c in kept]] = False
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True, blank: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, n + 1 offsets of each text's words); `blank` marks the bytes between words."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~blank[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    before[first] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = first[first > 0] - 1
    after[last] = False
    end = np.flatnonzero(inside & ~after) + 1
    p, q = _power(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWERED_TABLE if lower else _TABLE)[data] * p[:n], out=sums[1:])
    h = mix((sums[end] - sums[start]) * q[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, offsets, side="left")


def shingles(h: np.ndarray, at: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its `width`-word shingles; fewer words make one shingle."""
    n = len(h) - width + 1
    if n > 0:
        s = np.zeros(n, np.uint64)
        for k in range(width):
            s += h[k : k + n] * _COEFFICIENTS[k]
        s = mix(s)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if j - i >= width:
            own = np.sort(s[i : j - width + 1])
            yield own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif j > i:
            yield mix((h[i:j] * _COEFFICIENTS[: j - i]).sum(dtype=np.uint64, keepdims=True) ^ _COEFFICIENTS[width + j - i])
        else:
            yield h[:0]


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code point of every character, n + 1 offsets of each text's); a blank is put after each text."""
    lead = (data & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    out = np.full(len(points) + len(offsets) - 1, 32, np.uint32)
    out[np.arange(len(points)) + np.repeat(np.arange(len(offsets) - 1), np.diff(at))] = points
    return out, at + np.arange(len(offsets))


def grams(points: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hash of every gram of n characters of a word, n + 1 offsets of each text's grams).

    A word has a blank before and after it, so grams tell its beginning and its end; none reaches beyond these.
    """
    m = len(points) - n + 2
    if m <= 0 or not len(points):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    c = np.concatenate(([32], np.where(blank, 32, points))).astype(np.uint32)
    inside = np.concatenate(([0], np.cumsum(np.concatenate(([True], blank)))))
    start = np.flatnonzero(inside[n - 1 : n - 1 + m] - inside[1 : 1 + m] == 0)
    h = np.zeros(len(start), np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + c[start + k] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h, np.searchsorted(start, offsets)


def segment_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of values[at[i]:at[i+1]] for each i."""
    sums = np.concatenate((np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)))
    return sums[at[1:]] - sums[at[:-1]]
