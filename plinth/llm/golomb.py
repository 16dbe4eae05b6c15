"""Golomb-Rice codes of sorted distinct integers, coded and decoded without a loop over values.

Unary quotients and fixed-width remainders go to two streams, so both directions are array operations.
"""

from __future__ import annotations

import struct

import numpy as np


def encode(values: np.ndarray) -> bytes:
    """Code strictly rising unsigned integers."""
    n = len(values)
    if not n:
        return struct.pack("<IBI", 0, 0, 0)
    gaps = np.diff(values.astype(np.int64), prepend=-1) - 1
    k = max(0, int(np.log2(max(1.0, 0.6931 * (gaps.mean() + 1)))))
    quotient = gaps >> k
    stops = np.cumsum(quotient + 1) - 1
    unary = np.ones(int(stops[-1]) + 1, np.uint8)
    unary[stops] = 0
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    head = np.packbits(unary).tobytes()
    return struct.pack("<IBI", n, k, len(head)) + head + np.packbits(rest).tobytes()


def decode(code: bytes) -> np.ndarray:
    n, k, size = struct.unpack_from("<IBI", code)
    if not n:
        return np.empty(0, np.int64)
    unary = np.unpackbits(np.frombuffer(code, np.uint8, size, 9))
    stops = np.flatnonzero(unary == 0)[:n]
    gaps = (np.diff(stops, prepend=-1) - 1) << k
    if k:
        rest = np.unpackbits(np.frombuffer(code, np.uint8, offset=9 + size), count=n * k).reshape(n, k)
        gaps = gaps + rest.astype(np.int64) @ (1 << np.arange(k))
    return np.cumsum(gaps + 1) - 1
