"""Frames drawn by the MD5 digests of "media_id:frame_idx", many at a time in arrays.

A digest per frame is what the draw costs: an expression over a second's frames takes microseconds for each, while arrays
of short messages, one block of MD5 each, are hashed together. Texts of over 55 bytes, which have several blocks, go to
hashlib one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Frames that are ordered at once (a row of more frames stays whole), and messages that are hashed at once.
FRAMES, MESSAGES = 1 << 16, 1 << 14
#: Longest message of a single block.
SHORT = 55
_SINES = np.floor(np.abs(np.sin(np.arange(1, 65, dtype=np.float64))) * 2.0**32).astype(np.uint32)
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TENS = 10 ** np.arange(1, 19, dtype=np.int64)


def _texts(form: bytes) -> np.ndarray:
    return np.array([form % i for i in range(10_000)], "S8").view("<u8")


#: Four digits as text, in the byte order of a word: without and with leading zeros; the last four with MD5's end mark.
_LEADING, _LATER, _LAST_LEADING, _LAST = map(_texts, (b"%d", b"%04d", b"%d\x80", b"%04d\x80"))


def md5_of_blocks(words: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
    """The four words of the MD5 of one block per column: `words` are its first words, the others are zero; lengths in bits."""
    a, b, c, d = (np.full(len(bits), x, np.uint32) for x in _BEGIN)
    f, turned = np.empty_like(a), np.empty_like(a)
    for t in range(64):
        # into arrays that are there already: new ones would cost more than the sums
        if t < 16:
            g = t
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f), d, out=f)
        elif t < 32:
            g = (5 * t + 1) % 16
            np.bitwise_xor(np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f), c, out=f)
        elif t < 48:
            g = (3 * t + 5) % 16
            np.bitwise_xor(np.bitwise_xor(b, c, out=f), d, out=f)
        else:
            g = 7 * t % 16
            np.bitwise_xor(np.bitwise_or(np.invert(d, out=f), b, out=f), c, out=f)
        f += a
        f += _SINES[t]
        if g == 14 or g < len(words):
            f += bits if g == 14 else words[g]
        np.right_shift(f, np.uint32(32 - _TURNS[t]), out=turned)
        f <<= np.uint32(_TURNS[t])
        f |= turned
        f += b
        a, b, c, d, f = d, f, b, c, a
    return [x + np.uint32(begin) for x, begin in zip((a, b, c, d), _BEGIN)]


def digests(heads: list[bytes], row: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves, as numbers in the order of the hex digits, of the MD5 of heads[row] and the decimal digits of idx (0 or more)."""
    padded = np.ascontiguousarray(np.array(heads, "S56").view("<u4").reshape(len(heads), 14).T)
    sizes = np.fromiter(map(len, heads), np.int64, len(heads))
    high, low = np.empty(len(row), np.uint64), np.empty(len(row), np.uint64)
    for at in range(0, len(row), MESSAGES):
        r, i = row[at : at + MESSAGES], idx[at : at + MESSAGES]
        digits, size = np.searchsorted(_TENS, i, side="right") + 1, sizes[r]
        long = np.flatnonzero(size + digits > SHORT)
        size[long] = 0  # what is made of these is not used
        used = int((size + digits).max()) // 4 + 1
        words = np.zeros((used + 1, len(r)), np.uint32)
        for w in range(min(used, len(padded))):
            np.take(padded[w], r, out=words[w])
        flat = words.reshape(-1)
        for k in range(0, 19, 4):  # four digits at a time, from the last
            some = np.arange(len(r)) if k == 0 else np.flatnonzero(digits > k)
            if not len(some):
                break
            four, first = i[some] // 10**k % 10_000, digits[some] <= k + 4
            text = np.where(first, _LAST_LEADING[four], _LAST[four]) if k == 0 else np.where(first, _LEADING[four], _LATER[four])
            place = size[some] + np.maximum(digits[some] - k - 4, 0)
            text <<= (place % 4 * 8).astype(np.uint64)
            spot = place // 4 * len(r) + some
            flat[spot] |= text.astype(np.uint32)
            flat[spot + len(r)] |= (text >> np.uint64(32)).astype(np.uint32)
        a, b, c, d = (x.byteswap().astype(np.uint64) for x in md5_of_blocks(words[:used], ((size + digits) * 8).astype(np.uint32)))
        high[at : at + len(r)], low[at : at + len(r)] = a << np.uint64(32) | b, c << np.uint64(32) | d
        for j in long:
            whole = hashlib.md5(heads[r[j]] + b"%d" % i[j], usedforsecurity=False).digest()
            high[at + j], low[at + j] = int.from_bytes(whole[:8], "big"), int.from_bytes(whole[8:], "big")
    return high, low


def least(heads: list[bytes], head: np.ndarray, first: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(second, frame) of the k frames of each second with the least digests, frames being n >= 1 from `first` on."""
    start = np.cumsum(n) - n
    row = np.repeat(np.arange(len(n)), n)
    idx = np.arange(len(row)) + (first - start)[row]
    high, low = digests(heads, head[row], idx)
    key = row.astype(np.uint64) << np.uint64(48) | high >> np.uint64(16)
    order = np.argsort(key)
    if (np.diff(key[order]) == 0).any():
        order = np.lexsort((idx, low, high, row))
    places = np.arange(min(k, int(n.max())))
    chosen = order[(start[:, None] + places)[places < n[:, None]]]
    return row[chosen], idx[chosen]


def draw(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of media_id, head (binary), total, second (the first one), starts (first frames of it, of the next ones and of
    the one after the last) to media_id, second, frame_idx."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column("starts")
            ends = starts.offsets.to_numpy()
            frames, size = starts.values.to_numpy(), np.diff(ends)
            # every start but a row's last one begins a second
            video = np.repeat(np.arange(len(size)), size - 1)
            at = np.arange(len(video)) + video + ends[0]
            second = batch.column("second").to_numpy()[video] + at - ends[video]
            first = frames[at]
            n = np.minimum(frames[at + 1], batch.column("total").to_numpy()[video]) - first
            some = n > 0
            video, second, first, n = video[some], second[some], first[some], n[some]
            heads = batch.column("head").to_pylist()
            parts = np.flatnonzero(np.diff((np.cumsum(n) - 1) // FRAMES)) + 1
            for a, b in zip([0, *parts], [*parts, len(n)]):
                if a == b:
                    continue
                low, high = video[a], video[b - 1] + 1
                row, idx = least(heads[low:high], video[a:b] - low, first[a:b], n[a:b], k)
                kept = pc.take(batch.column("media_id"), pa.array(video[a + row]))
                yield pa.RecordBatch.from_arrays([kept, pa.array(second[a + row]), pa.array(idx)], ["media_id", "second", "frame_idx"])

    return run
