"""Words and rolling hashes over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np

from .common import MASK64, mix64

#: Bases of the polynomial hashes (odd, so they can be inverted modulo 2**64).
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64, kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 20), base, np.uint64)
        have[0] = 1
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _slices(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[start:end] for each pair: the sum of values[start + k] * base ** k."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values)), out=sums[1:])
    back = _powers(pow(base, -1, MASK64 + 1), len(values) + 1)
    return (sums[ends] - sums[starts]) * back[starts]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data``, and the n + 1 offsets of the texts' words among them.

    A word is a longest run of bytes other than 0x20 and 0x09 to 0x0D in one text.
    """
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | first[1:]
    ends = inside[:-1] & (~inside[1:] | first[1:])
    at = np.flatnonzero(starts)
    return at, np.flatnonzero(ends) + 1, np.searchsorted(at, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length."""
    h = _slices(data.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)
    return mix64(h + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` consecutive words, as if all were one text."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    at = np.arange(len(words) - size + 1)
    return mix64(_slices(words, at, at + size, WORD_BASE))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have, m = 1, values
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:-step], m[step:])
        have += step
    return m
