"""A 64-bit Murmur hash (variant 64A) of bytes, over Arrow batches."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values.
MULTIPLIER, SEED, SHIFT = 0xC6A4A7935BD1E995, 3782874213, 47
_MASK = (1 << 64) - 1


def hash_bytes(data: bytes) -> int:
    whole = len(data) // 8 * 8
    h = SEED ^ (len(data) * MULTIPLIER & _MASK)
    for (k,) in struct.iter_unpack("<Q", data[:whole]):
        k = k * MULTIPLIER & _MASK
        k = (k ^ k >> SHIFT) * MULTIPLIER & _MASK
        h = (h ^ k) * MULTIPLIER & _MASK
    if tail := data[whole:]:
        h = (h ^ int.from_bytes(tail, "little")) * MULTIPLIER & _MASK
    h = (h ^ h >> SHIFT) * MULTIPLIER & _MASK
    return h ^ h >> SHIFT


def hash_many(rows: list[bytes]) -> np.ndarray:
    """hash_bytes of each row: all rows that have a k-th word take their step with it at once."""
    rows = [bytes(x) for x in rows]
    size = np.array([len(x) for x in rows], np.int64)
    order = np.argsort(-size, kind="stable")
    words, tail = size[order] // 8, np.array([int.from_bytes(rows[i][size[i] // 8 * 8 :], "little") for i in order], np.uint64)
    flat = np.frombuffer(b"".join(rows[i][: size[i] // 8 * 8] for i in order), "<u8")
    first = np.cumsum(words) - words
    m, shift = np.uint64(MULTIPLIER), np.uint64(SHIFT)
    with np.errstate(over="ignore"):
        h = np.uint64(SEED) ^ (size[order].astype(np.uint64) * m)
        live = np.searchsorted(-words, -np.arange(1, (int(words[0]) if len(words) else 0) + 1), "right")
        for k, n in enumerate(live.tolist()):
            x = flat[first[:n] + k] * m
            h[:n] = (h[:n] ^ ((x ^ (x >> shift)) * m)) * m
        rest = size[order] % 8 > 0
        h[rest] = (h[rest] ^ tail[rest]) * m
        h = (h ^ (h >> shift)) * m
        h ^= h >> shift
    out = np.empty_like(h)
    out[order] = h
    return out


@F.pandas_udf(T.DecimalType(20, 0))
def murmur64(data: pd.Series) -> pd.Series:
    from decimal import Decimal

    known = data.notna()
    out = pd.Series([None] * len(data), dtype=object)
    out[known.to_numpy()] = [Decimal(int(x)) for x in hash_many(list(data[known]))]
    return out
