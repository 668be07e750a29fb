"""Rolling and word hashes of the bytes of an Arrow batch, in numpy.

A polynomial with an odd base modulo 2**64 over random byte values; prefix
sums give the hash of any slice, whose place is divided out with the inverse
base, and a final mix spreads the bits.  Two seeds give 128 bits.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03) + U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... (n of them); the longest so far is kept."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base % (1 << 64), U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _POWERS[base] = have
    return have[:n]


class Prefix:
    """Hashes of slices of data."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(byte_values(seed)[data] * powers(BASE, len(data)), out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * powers(INVERSE, len(self.sums))[start] + (end - start).astype(U))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each ends; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def runs(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, within texts that end at ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(inside) + 1, bool)
    edge[0] = True
    edge[ends] = True
    edge[1:-1] |= inside[1:] != inside[:-1]
    at = np.nonzero(edge)[0]
    starts, stops = at[:-1], at[1:]
    own = inside[starts]
    return starts[own], stops[own]


def owner(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Number of the text that holds each position."""
    return np.searchsorted(ends, at, "right")
