"""Suffixes of a buffer in order, and hashes of its stretches.

Suffixes are read up to a given size, so they are sorted as strings of that size, by their bytes. The hash
of any stretch comes from prefix sums of bytes times powers.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """The powers of an odd base from 0 to n at least, modulo 2^64."""
    if base not in _powers or len(_powers[base]) <= n:
        many = np.full(max(n, 1 << 16) + 1, base, np.uint64)
        many[0] = 1
        _powers[base] = np.multiply.accumulate(many)
    return _powers[base]


class Hashed:
    """A buffer with its prefix hashes."""

    def __init__(self, buffer: np.ndarray):
        self.bytes = buffer
        self._up = powers(len(buffer))
        self._down = powers(len(buffer), pow(_BASE, -1, 2**64))
        terms = (buffer.astype(np.uint64) + np.uint64(1)) * self._up[: len(buffer)]
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])

    def at(self, i: np.ndarray, n: np.ndarray | int) -> np.ndarray:
        """Hashes of n bytes from i; they depend on those bytes only."""
        return (self._sums[i + n] - self._sums[i]) * self._down[i]


def sorted_suffixes(text: Hashed, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes (starts ``at``, read up to ``size`` bytes) and what each shares with the one before it."""
    n, widest = len(at), int(size.max(initial=0))
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    column = np.arange(widest)
    inside = column[None, :] < size[:, None]
    where = np.minimum(at[:, None] + column[None, :], max(0, len(text.bytes) - 1))
    rows = np.where(inside, text.bytes[where].astype(np.int16) + 1, 0)  # 0: past the end
    # Two bytes a place, the greater one first: compared as strings in C they stand in the order of the numbers.
    order = np.argsort(rows.astype(">u2").view(f"S{2 * widest}").ravel(), kind="stable") if widest else np.arange(n)
    shared = _shared(rows[order])
    return order, np.minimum(shared, np.concatenate([[0], np.minimum(size[order][1:], size[order][:-1])]))


def _shared(rows: np.ndarray) -> np.ndarray:
    """What neighbours share, byte by byte."""
    differ = rows[1:] != rows[:-1]
    at = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1]) if rows.shape[1] else np.zeros(len(differ), int)
    return np.concatenate([[0], at])
