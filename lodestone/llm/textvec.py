"""Word and n-gram hashes of Arrow text columns, whole blocks at a time, in numpy.

A word is a run of anything but ASCII white space. Its hash is a polynomial over random 64-bit values of its bytes,
read off running sums modulo 2^64; n-grams are hashed alike over the words' hashes. Two given n-grams meet by chance
with a probability of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.default_rng(20240229)
_BYTES = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + _RNG.integers(0, 2, 256, dtype=np.uint64)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Bases of the polynomials over bytes and over words, odd so that they can be divided by.
_BASES = (6364136223846793005, 2862933555777941757)
#: Bytes hashed at a time: 4 MB for each 64-bit array.
_SEGMENT = 1 << 19
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        n = max(n, _SEGMENT + 1)
        up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole word (a bijection)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def blocks(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of the rows in them) of runs of rows of about `size` bytes; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + size, side="right")) - 1)
        yield row, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def words(data: np.ndarray, bounds: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: first byte, end, row and hash. fold: A-Z count as a-z."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[bounds] = True
    starts, ends = ~space, ~space
    starts[1:] &= space[:-1] | edge[1:n]
    ends[:-1] &= space[1:] | edge[1:n]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(bounds, first, side="right") - 1
    values = _BYTES[_FOLD] if fold else _BYTES
    hashes = np.empty(len(first), np.uint64)
    i = 0
    while i < len(first):
        j = max(i + 1, int(np.searchsorted(last, first[i] + _SEGMENT, side="right")))
        seg = data[first[i] : last[j - 1]]
        up, down = _powers(_BASES[0], len(seg) + 1)
        sums = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(values[seg] * up[: len(seg)], out=sums[1:])
        a, b = first[i:j] - first[i], last[i:j] - first[i]
        hashes[i:j] = (sums[b] - sums[a]) * down[a]
        i = j
    return first, last, row, mix(hashes)


def ngrams(row: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of each run of n words of one row."""
    m = len(hashes)
    if m < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    up, down = _powers(_BASES[1], m + 1)
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum(hashes * up[:m], out=sums[1:])
    at = np.flatnonzero(row[: m - n + 1] == row[n - 1 :])
    return at, mix((sums[at + n] - sums[at]) * down[at] + np.uint64(n))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x
