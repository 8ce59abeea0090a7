"""Words of whole Arrow batches as 64-bit hashes, by array operations over the bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: An odd multiplier and its inverse modulo 2**64, and odd constants that mix bits; any such numbers would do.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 19), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def byte_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array without nulls, and the offsets of its values."""
    big = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each value the index of its first word (one more at the end).

    ``table`` maps a byte to what it counts as, 0 for a separator. Values are separated from each other. Equal words
    have equal hashes wherever they stand: the weighted byte sum of a word is scaled back to its start.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    seen = table[data]
    inner = seen != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inner.copy()
    starts[1:] &= ~inner[:-1] | edge[1:-1]
    ends = inner.copy()
    ends[:-1] &= ~inner[1:] | edge[1:-1]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(seen.astype(np.uint64) * _powers(BASE, len(data)), out=sums[1:])
    raw = (sums[last] - sums[first]) * _powers(INVERSE, len(data))[first]
    return mix(raw + (last - first).astype(np.uint64) * MIX_A), np.searchsorted(first, offsets)
