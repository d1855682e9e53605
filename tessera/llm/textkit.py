"""Vectorised words, word hashes and shingles over the UTF-8 bytes of an Arrow column.

Words are runs of bytes other than space and \\x09-\\x0D; A-Z are lower-cased. A hash is 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 2 << 20  # bytes of text that are hashed at a time
_GOLDEN = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers after which every bit depends on all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def series(n: int, salt: int) -> np.ndarray:
    """n odd pseudo-random multipliers."""
    return mix((np.arange(n, dtype=np.uint64) + np.uint64(salt)) * np.uint64(_GOLDEN)) | np.uint64(1)


BYTE_VALUE = series(256, 1_000_003)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1] if offsets is not None and len(column) else np.zeros(1, dtype=np.int64)
    return ends.astype(np.int64), np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)


def chunks(offsets: np.ndarray, data: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Whole rows of about ``size`` bytes: first and last row, offsets from 0, bytes."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def pieces(batch: pa.RecordBatch, column: str | int = "text", size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows of about ``size`` bytes of text, in order: what is made of a slice is small, however long a batch's texts."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def give_back() -> None:
    """Freed memory goes back to the system; a worker that waits for its next task would keep what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc's
        trim(0)


def spans(offsets: np.ndarray, data: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the row of each."""
    inside = ~space[data]
    if not len(inside):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    begin[first] = inside[first]
    end[last] = inside[last]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(offsets, starts, side="right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each span of bytes; spans don't overlap and aren't empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    size = ends - starts
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    value = table[data[place + np.repeat(starts, size)]]
    value *= series(int(size.max()), 77)[place]
    return mix(np.add.reduceat(value, at) + size.astype(np.uint64) * np.uint64(_GOLDEN))


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every lower-cased word."""
    starts, ends, row = spans(offsets, data)
    return hash_spans(LOWER[data], starts, ends), row


def ngrams(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of every run of n words in one row."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    factor, total = series(n, 4_242), np.zeros(len(words) - n + 1, dtype=np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * factor[j]
    at = np.flatnonzero(row[: len(words) - n + 1] == row[n - 1 :])
    return mix(total[at] + np.uint64(n)), at


def shingle_sets(words: np.ndarray, row: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each row, ascending within it: hashes, and len(rows)+1 offsets.

    A row of fewer words has them all as its one shingle; one without words has none.
    """
    value, at = ngrams(words, row, n)
    owner = row[at]
    count = np.bincount(row, minlength=rows)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(row, few)
        factor, total = series(n, 4_242), np.zeros(len(few), dtype=np.uint64)
        for j in range(n - 1):
            some = count[few] > j
            total[some] += words[first[some] + j] * factor[j]
        value = np.concatenate([value, mix(total + count[few].astype(np.uint64))])
        owner = np.concatenate([owner, few])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(rows + 1))
