"""Words of many texts as 64-bit hashes, in whole-array steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 20
_powers: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, _PIECE), x, np.uint64))]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of the data after space characters, about _PIECE apart."""
    lo = 0
    while lo < len(data):
        hi = min(len(data), lo + _PIECE)
        while hi < len(data) and not SPACE[data[hi - 1]]:
            found = np.flatnonzero(SPACE[data[hi : hi + _PIECE]])
            hi = hi + int(found[0]) + 1 if len(found) else min(len(data), hi + _PIECE)
        yield lo, hi
        lo = hi


def word_hashes(texts: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, number of words of each text). Words are runs of bytes other than ASCII white space;
    fold: A-Z count as a-z. Words are told apart by 64 bits of hash."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined.lower() if fold else joined, np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for lo, hi in _pieces(data):
        own = data[lo:hi]
        edge = np.diff(np.concatenate([[True], SPACE[own], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        up, down = _power(len(own))
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE[own] * up[: len(own)], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        counts += np.bincount(np.searchsorted(begins, starts + lo, "right") - 1, minlength=len(texts))[: len(texts)]
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts
