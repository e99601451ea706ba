"""64-bit hashes of words and word shingles of whole texts, without a Python step per word."""

from __future__ import annotations

import numpy as np

#: Fixed numbers of the hash: byte values and the base come from a seeded generator, the rest are splitmix64's.
_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_VALUE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_A, _B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that are hashed at once; longer texts are cut at white space.
_STEP = 1 << 20

_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(size: int) -> None:
    """Powers of the base and of its inverse modulo 2^64."""
    global _powers, _inverse
    if len(_powers) < size:
        size = 1 << (size - 1).bit_length()
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.full(size, _BASE, np.uint64)) * np.uint64(pow(_BASE, -1, 1 << 64))
            back = pow(_BASE, -1, 1 << 64)
            _inverse = np.cumprod(np.full(size, back, np.uint64)) * np.uint64(_BASE)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A hash per word (words are parted by ASCII white space)."""
    data = np.frombuffer(text, np.uint8)
    space = _IS_SPACE[data]
    edge = np.diff(np.concatenate(([1], space.view(np.int8), [1])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(data) <= _STEP:
        return _hash(data, starts, ends)
    parts, first = [], 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _STEP, side="right")))
        at = starts[first]
        parts.append(_hash(data[at : ends[last - 1]], starts[first:last] - at, ends[first:last] - at))
        first = last
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    _grow(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _inverse[starts] + (ends - starts).astype(np.uint64))


#: A hash per slice of ``data`` between ``starts`` and ``ends``; memory follows the length of ``data``.
slice_hashes = _hash


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash per window of ``width`` words, in order; none if there are fewer words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out = mix(out * _C + words[k : k + n])
    return out


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct shingles, ascending; the whole sequence as one shingle if it is shorter, nothing without words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(words, min(width, len(words))))
