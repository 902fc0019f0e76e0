"""Words and their hashes for many texts at once, on the bytes of Arrow columns.

Used inside tasks.  Texts lie end to end in one byte array; ``offsets`` has their borders.  No
result spans two texts.  Slices are bounded in bytes, so that memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): rows of about ``limit`` bytes, one row at least.  Null is empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low, rows = 0, len(texts)
    while low < rows:
        high = max(low + 1, int(np.searchsorted(ends, ends[low] + limit, "right")) - 1)
        high = min(high, rows)
        yield low, high, data[ends[low] : ends[high]], ends[low : high + 1] - ends[low]
        low = high


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for at, step in ((0, _BASE), (1, _INVERSE)):
            _powers[at] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, step)]), dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


class Prefix:
    """Hashes of any stretches of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        """data: bytes, or 64-bit values to be hashed instead."""
        power, self.back = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE[data] if data.dtype == np.uint8 else data) * power[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, border): bytes of each word; words border[i]..border[i+1]-1 belong to text i."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    border = offsets[1:-1]
    opens = border[border < len(data)]
    first[opens] = inside[opens]
    closes = border[border > 0] - 1
    last[closes] = inside[closes]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def shingles(word_hash: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each word on; those that would pass the end are missing."""
    n = len(word_hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out + word_hash[k : k + n]) * _BASE
        out ^= out >> np.uint64(29)
    return mixed(out)


def per_text(flags: np.ndarray, border: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` between consecutive borders."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[border[1:]] - total[border[:-1]]
