"""Words and word windows of many texts at once, as 64-bit hashes in numpy.

A word's hash is a polynomial in a random value per byte, taken from prefix
sums modulo 2**64, so that no Python object is made per word. The same text
gives the same hash in every process.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15
_INVERSE = pow(_ROOT, -1, 1 << 64)
_PIECE = 1 << 22
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(1 << 20)) * _U(_ROOT))


@functools.cache
def _bytes_values(fold: bool) -> np.ndarray:
    values = constants(256, 7) | _U(1)
    if fold:
        values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


@functools.cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(1 << bits, base, _U)
        out[0] = 1
        return np.cumprod(out, dtype=_U)

    return of(_ROOT), of(_INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(max(12, int(n).bit_length()))
    return up[:n], down[:n]


@dataclass
class Words:
    """Words of consecutive texts: hash, byte range, and the range of words of each text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # text d has words bounds[d] to bounds[d + 1]

    def lengths(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.lengths())


def split(raw: np.ndarray, offs: np.ndarray, fold: bool = False, breaks: np.ndarray = _SPACE) -> Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of the texts raw[offs[d]:offs[d+1]]; ``fold``: A-Z count as a-z.

    ``breaks``: which bytes lie between words, if others do.
    """
    hashes, starts, ends = [], [], []
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + _PIECE)
        if end < n:  # not inside a word
            while end < n and not breaks[raw[end - 1]]:
                ahead = np.flatnonzero(breaks[raw[end : end + _PIECE]])
                end = end + int(ahead[0]) + 1 if len(ahead) else min(n, end + _PIECE)
        h, s, e = _split_piece(raw[at:end], offs[(offs > at) & (offs < end)] - at, fold, breaks)
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = end
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    s = join(starts, np.int64)
    return Words(join(hashes, _U), s, join(ends, np.int64), np.searchsorted(s, offs))


def _split_piece(raw: np.ndarray, cuts: np.ndarray, fold: bool, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw)
    inside = ~breaks[raw]
    first, last = inside.copy(), inside.copy()
    fresh = ~inside[:-1]
    fresh[cuts - 1] = True
    first[1:] &= fresh
    stop = ~inside[1:]
    stop[cuts - 1] = True
    last[:-1] &= stop
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_bytes_values(fold)[raw] * up, out=sums[1:])
    return mix((sums[e] - sums[s]) * down[s]), s, e


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive words: n - k + 1 values, without regard to where texts end."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, _U)
    up, down = powers(n)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + _U(k))


def window_counts(bounds: np.ndarray, k: int) -> np.ndarray:
    """How many k-word windows each text has."""
    return np.maximum(np.diff(bounds) - k + 1, 0)


def inner(bounds: np.ndarray, k: int) -> np.ndarray:
    """Starts of the windows of k words that lie within one text, ascending."""
    counts = window_counts(bounds, k)
    base = np.cumsum(counts) - counts
    return np.repeat(bounds[:-1] - base, counts) + np.arange(counts.sum())
