"""Hashes of words for numpy tasks."""

from __future__ import annotations

import numpy as np

GAP = np.zeros(256, dtype=bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = [np.ones(1, dtype=np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> np.ndarray:
    """The first powers of the base, ``n`` or more."""
    if len(_POWERS[0]) < n:
        more = np.full(max(n, 256), _BASE, dtype=np.uint64)
        more[0] = 1
        _POWERS[0] = np.cumprod(more, dtype=np.uint64)
    return _POWERS[0]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of the texts, one text after the other, and the number of words of each."""
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    gap = GAP[buf]
    begins = ~gap
    begins[1:] &= gap[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    last = np.zeros(len(buf), dtype=np.int64)
    last[starts] = starts
    place = np.arange(len(buf)) - np.maximum.accumulate(last)
    place[gap] = 0
    value = (buf.astype(np.uint64) + np.uint64(1)) * _powers(int(place.max()) + 1)[place]
    value[gap] = 0
    ends = np.cumsum(size)
    count = np.diff(np.searchsorted(starts, ends), prepend=0)
    return mixed(np.add.reduceat(value, starts)), count

