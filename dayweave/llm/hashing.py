"""Polynomial hashes of stretches of bytes, many at a time."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BASE = 0xB5026F5AA96619E9
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(32)


class Powers:
    """Powers of the base and of its inverse modulo 2 ** 64, as many as were asked for."""

    step = 0xD6E8FEB86659FD93

    def __init__(self):
        self.inverse = pow(BASE, -1, 1 << 64)
        self.up, self.down = self._filled(BASE, 1), self._filled(self.inverse, 1)

    @staticmethod
    def _filled(base: int, n: int) -> np.ndarray:
        out = np.full(n, np.uint64(base), dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = self._filled(BASE, 2 * n), self._filled(self.inverse, 2 * n)
        return self.up[:n], self.down[:n]


class Hashed:
    """Prefix hashes of some bytes; the hash of any stretch then takes two look-ups."""

    letters = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __init__(self, data: np.ndarray, powers: Powers):
        up, self.down = powers.upto(len(data) + 1)
        self.prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.letters[data] * up[: len(data)], out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.prefix[end] - self.prefix[start]) * self.down[start]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the differences of hashes over all bits; one to one."""
    h = (h ^ (h >> _SHIFT)) * _ODD
    h = (h ^ (h >> _SHIFT)) * _ODD
    return h ^ (h >> _SHIFT)


def blocks(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of at most `most` bytes, or one longer text: first and last row (exclusive),
    the bytes of all, and where each text ends. A missing text is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(ends, ends[first] + most, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first]
        first = last
