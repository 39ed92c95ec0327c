"""64-bit hashes of any stretch of a byte array, many at once. Plain numpy, no Spark."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes that end a word.
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's and its inverse's powers from 0 to n."""
    if len(_powers[0]) <= n:
        m = 1 << int(n + 1).bit_length()
        for i, b in enumerate((_BASE, _INVERSE)):
            p = np.full(m, np.uint64(b), np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Stretches:
    """Hashes of stretches of data; equal bytes give equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        up, self._down = powers(len(data))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mix((self._sums[end] - self._sums[start]) * self._down[start] + length * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, size: int) -> np.ndarray:
        """The hash of every window of that size."""
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self._sums[size:] - self._sums[:n]) * self._down[:n])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    space = np.concatenate([[True], IS_SPACE[data], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    starts, ends = word_bounds(data)
    return Stretches(data)(starts, ends)
