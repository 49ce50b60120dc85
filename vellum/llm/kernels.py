"""Array kernels over texts: word and shingle hashes without a Python loop over words."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.default_rng(20_240_901)
#: A random odd 64-bit value for each byte; A-Z share those of a-z.
_EXACT = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * U64(2) + U64(1)


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _power_table(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1 << 16, 1 << int(n).bit_length()))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text starts (one more entry than texts)."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of words before each text (one more entry than texts)."""
    solid = ~_IS_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    first[inner] = solid[inner]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:][offsets[1:] > 0] - 1
    last[inner] = solid[inner]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of the bytes of each span: a polynomial over random byte values, taken from one running sum."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _EXACT)[data] * _power_table(_BASE, len(data))[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * _power_table(_BASE_INVERSE, len(data) + 1)[starts])


def word_hashes(column: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of each text in order, and the number of words before each text."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    return span_hashes(data, starts, ends, lower), bounds


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, text borders not heeded."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes[:n] * _STEP[0]
    for i in range(1, width):
        total += hashes[i : i + n] * _STEP[i]
    return mix(total + _STEP[32 + width % 32])


def shingles(column: pa.Array, width: int, lower: bool = True) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer words than ``width`` has its whole word sequence as its
    one shingle; a text without words has none.
    """
    hashes, bounds = word_hashes(column, lower)
    wide = window_hashes(hashes, width)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(wide[a : b - width + 1]))
        elif b > a:
            out.append(window_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
