"""Text columns as numpy arrays: bytes, words and hashes of a bounded slice of rows.

A slice is a few megabytes of text, so that every temporary array stays small however
many rows an Arrow batch or a partition holds. A text is never cut: one that is longer
than a slice makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 3 << 20
U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, 9, 10, 11, 12, 13]] = True


def slices(
    batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows of about `limit` bytes of text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(size.astype(np.int64)) - size) // limit
        cuts = np.concatenate([[0], np.nonzero(np.diff(group))[0] + 1, [batch.num_rows]])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's start (null: empty)."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row of every element, from the rows' offsets."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


@lru_cache(maxsize=8)
def _byte_values(seed: int, lower: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95) + U64(seed))
    if lower:
        values[65:91] = values[97:123]
    return values


#: One pair of tables per worker, as long as its longest slice so far.
_TABLES: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse."""
    if not _TABLES or len(_TABLES[0]) < n:
        size = n + n // 8 + 1024
        _TABLES.clear()
        for step in (_BASE, _INVERSE):
            table = np.full(size, step, U64)
            table[0] = 1
            _TABLES.append(np.multiply.accumulate(table, out=table))
    return _TABLES[0][:n], _TABLES[1][:n]


def prefix_hashes(raw: np.ndarray, seed: int = 0, lower: bool = False) -> np.ndarray:
    """Running polynomial hash of the bytes; `lower` folds A-Z."""
    out = np.zeros(len(raw) + 1, U64)
    if len(raw):
        np.cumsum(_byte_values(seed, lower)[raw] * powers(len(raw))[0], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of bytes, wherever it stands."""
    down = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, offsets per row) of the words, which are runs of bytes other than
    space and 0x09 to 0x0D, and end with their row."""
    n = len(raw)
    inside = np.zeros(n + 1, bool)
    inside[:n] = ~SEPARATORS[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.nonzero(inside & (~before | first))[0]
    ends = np.nonzero(before & (~inside | first))[0]
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(
    raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0, lower: bool = False
) -> np.ndarray:
    return range_hashes(prefix_hashes(raw, seed, lower), starts, ends)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of `width` consecutive values from each position on that has so many."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out = out * U64(0xD6E8FEB86659FD93) + hashes[k:k + n]
    return mix(out + U64(width))


def whole_windows(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions from which `width` elements lie in one row."""
    n = int(offsets[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    fits = np.ones(n, bool)
    for k in offsets[1:-1]:
        fits[max(0, k - width + 1):k] = False
    return np.nonzero(fits)[0]


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Mask of the `n` elements that lie in a window from one of `starts`."""
    edges = np.bincount(starts, minlength=n + 1)[:n + 1].astype(np.int64)
    edges[width:] -= np.bincount(starts, minlength=n + 1)[:n + 1 - width] if n + 1 > width else 0
    return np.cumsum(edges)[:n] > 0


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0..k-1 for each length k, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)
