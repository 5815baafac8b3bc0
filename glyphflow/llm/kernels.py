"""Numpy kernels over the UTF-8 bytes of an Arrow string column.

A batch is cut into slices of about a quarter of a megabyte (always whole rows), so memory
does not follow the batch size; after each batch a worker gives back what it has freed,
because it stays alive, idle, beside the joins that follow. Hashes are polynomial prefix hashes modulo 2**64 followed by a
mixing step; equality of two 64-bit values stands for equality of two words or lines of
one text, which errs about once in 10**12 texts of a thousand words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_cache = {"n": 0, "p": np.ones(0, np.uint64), "q": np.ones(0, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse."""
    if _cache["n"] < n:
        _cache.update(n=n, p=_powers(_P, n), q=_powers(_PINV, n))
    return _cache["p"][:n], _cache["q"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about so many bytes of text each (one row at least)."""
    bounds = _offsets(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Returns freed memory to the system, where the C library can."""
    _cache.update(n=0, p=np.ones(0, np.uint64), q=np.ones(0, np.uint64))
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _offsets(col: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    return np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)


class Bytes:
    """The bytes of a string column and the rows' bounds in them; null counts as empty."""

    def __init__(self, col: pa.Array):
        if col.null_count:
            col = col.fill_null("")
        bounds = _offsets(col) if len(col) else np.zeros(1, np.int64)
        data = col.buffers()[2] if len(col) else None
        whole = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
        self.rows = len(col)
        self.data = whole[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]

    def row_of(self, at: np.ndarray) -> np.ndarray:
        """The row of each byte position."""
        return np.searchsorted(self.bounds, at, "right") - 1

    def words(self, lower: bool = True) -> "Words":
        return Words(self, lower)


class Words:
    """Maximal runs of bytes other than space and 0x09-0x0D: start, end, row and hash."""

    def __init__(self, source: Bytes, lower: bool = True):
        data = source.data
        n = len(data)
        solid = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[1:n] = solid[1:] != solid[:-1]
        first = source.bounds[:-1]
        if n:
            edge[0], edge[n] = solid[0], solid[-1]
            # a row that follows another directly also begins and ends words
            inner = first[(first > 0) & (first < n)]
            joined = inner[solid[inner] & solid[inner - 1]]
        else:
            joined = np.zeros(0, np.int64)
        marks = np.flatnonzero(edge)
        if len(joined):
            marks = np.sort(np.concatenate((marks, np.unique(joined), np.unique(joined))))
        self.starts, self.ends = marks[0::2], marks[1::2]
        self.row = source.row_of(self.starts)
        self.first = np.searchsorted(self.starts, source.bounds)  # of each row, and the end
        self.hash = span_hash(_LOWER[data] if lower else data, self.starts, self.ends)

    def __len__(self) -> int:
        return len(self.starts)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever it lies."""
    n = len(data)
    p, q = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of all runs of n values; one value fewer for each beyond the first."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        out *= np.uint64(_P)
        out += h[k : len(h) - n + 1 + k]
    return mix(out)
