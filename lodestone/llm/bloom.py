"""Bloom filters of a bounded size over 64-bit keys: they keep rows from being moved, never decide a result."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits at most: 16 MB to broadcast, however many keys. A fuller filter lets more rows pass; results stay the same.
MOST_BITS = 1 << 27


def build(keys: DataFrame, col: str) -> np.ndarray:
    """The filter's bytes for a column of longs, made by a grouped bit_or; two bits a key, 16 bits of room for each."""
    n = keys.count()
    bits = min(MOST_BITS, max(1 << 16, 1 << (16 * max(1, n) - 1).bit_length()))
    at = F.explode(F.array(F.col(col).bitwiseAND(bits - 1), F.shiftrightunsigned(F.col(col), 32).bitwiseAND(bits - 1)))
    byte = keys.select(at.alias("b")).groupBy(F.shiftright("b", 5).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 31 AS INT))")).alias("v"))
    got = byte.toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[got["i"].to_numpy()] = got["v"].to_numpy().astype(np.uint32)
    return out


def holds(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the uint64 keys may be in it."""
    mask = np.uint64(len(filter_) * 32 - 1)
    out = np.ones(len(keys), bool)
    for at in (keys & mask, (keys >> np.uint64(32)) & mask):
        out &= (filter_[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
    return out
