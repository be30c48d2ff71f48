"""Hashes of any run of words, over Arrow batches of word hashes.

A run's hash is a polynomial of its word hashes modulo 2**64. Prefix sums give the
hash of every run in constant time per run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_WORDS_AT_ONCE = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, dtype=np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


class Runs:
    """Prefix sums over the word hashes of one or more texts laid end to end."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 1
        self.powers, inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        terms = words.view(np.uint64) * inverse[: len(words)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the words in [start, stop), the same wherever the run stands."""
        run = (self.sums[stop] - self.sums[start]) * self.powers[start]
        # The sums carry inverse powers: multiplied by the start's power, only the distance from it is left.
        return _mixed(run + (stop - start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def list_parts(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column; the offsets start at 0."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), (offsets - offsets[0]).astype(np.int64)


def slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that together hold a bounded number of values (a single long row stays whole)."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + _WORDS_AT_ONCE, side="right")) - 1
        last = min(max(last, first + 1), len(offsets) - 1)
        yield first, last
        first = last
