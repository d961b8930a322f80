"""XXH64 of many slices of one buffer at a time, and the words of many texts as such slices."""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

from .analysis import TOKEN

#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Slices of this length or more are hashed one by one.
LONG = 32


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def xxh64(buffer: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64, with seed 0, of the slices from ``starts`` to ``ends``."""
    b = np.frombuffer(buffer + bytes(8), np.uint8)
    lanes = b[: len(buffer) + 1].astype(np.uint64)  # the 8 bytes from each place on, the first lowest
    for k in range(1, 8):
        lanes |= b[k : len(buffer) + 1 + k].astype(np.uint64) << np.uint64(8 * k)
    size = ends - starts
    h, at = P5 + size.astype(np.uint64), starts.copy()
    for k in range(LONG // 8 - 1):
        some = np.flatnonzero(size >= 8 * k + 8)
        x = _rotated(lanes[at[some]] * P2, 31) * P1
        h[some] = _rotated(h[some] ^ x, 27) * P1 + P4
        at[some] += 8
    some = np.flatnonzero((size & 4) > 0)
    h[some] = _rotated(h[some] ^ ((lanes[at[some]] & np.uint64(0xFFFFFFFF)) * P1), 23) * P2 + P3
    at[some] += 4
    for k in range(3):
        some = np.flatnonzero((size & 3) > k)
        h[some] = _rotated(h[some] ^ (b[at[some] + k].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size >= LONG):
        h[i] = xxhash.xxh64_intdigest(buffer[starts[i] : ends[i]])
    return h


@cache
def _of_words() -> np.ndarray:
    """Which code points words consist of."""
    table = np.zeros(0x110000, bool)
    for m in TOKEN.finditer("".join(map(chr, range(len(table))))):
        table[m.start() : m.end()] = True
    return table


def words(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, starts, ends, number of the text) of the lower-cased words of all texts, one space between two words of a text."""
    points = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    inside = _of_words()[points]
    points[~inside] = 32
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    # Words are lower-cased together: what stands beyond a space has no influence.
    b = np.frombuffer(points.tobytes().decode("utf-32-le").lower().encode(), np.uint8)
    b = b[(b != 32) | (np.concatenate([[32], b[:-1]]) != 32)]
    inside = np.concatenate([[False], b != 32, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return b.tobytes(), edges[::2], edges[1::2], np.searchsorted(begins, first, side="right") - 1
