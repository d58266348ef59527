"""Words and rolling hashes of UTF-8 bytes in numpy, shared by the operators' tasks."""

from __future__ import annotations

import numpy as np

#: The bytes that separate words.
SPACES = b" \t\n\x0b\x0c\r"
#: The same words as a pattern for Spark's and DuckDB's regular expressions.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, kept for the longest text so far."""
    global _powers, _inverses
    if n > len(_powers):
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("_powers", _MULTIPLIER), ("_inverses", _INVERSE)):
                steps = np.full(size, base, dtype=np.uint64)
                steps[0] = 1
                globals()[name] = np.multiply.accumulate(steps)
    return _powers, _inverses


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit values over all bits."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any spans of one byte string after one pass over it."""

    def __init__(self, data: np.ndarray):
        powers, self._inverses = _tables(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_BYTE_VALUES[data] * powers[: len(data)], out=self._sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans; equal spans of equal length hash alike wherever they stand."""
        with np.errstate(over="ignore"):
            return mixed((self._sums[ends] - self._sums[starts]) * self._inverses[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a byte array."""
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = ~IS_SPACE[data]
    edges = np.flatnonzero(np.diff(inside))
    return edges[0::2], edges[1::2]


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word."""
    data = np.frombuffer(text, dtype=np.uint8)
    starts, ends = word_bounds(data)
    return Rolling(data).spans(starts, ends), starts, ends
