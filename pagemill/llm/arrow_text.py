"""Vectorised words of Arrow string columns, for use inside Spark tasks.

A column is viewed as one byte array; words, their 64-bit hashes and the row of each word come
from a handful of numpy passes over it.  Batches are cut into slices of about ``SLICE_BYTES``
so that memory follows the slice (or the one text that is longer), never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_BASE_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=_U) * _BASE)
_VALUE_LOWER = _VALUE[LOWER]
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64 for i below n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, factor in (("up", _BASE), ("down", _BASE_INVERSE)):
            table = np.full(size, factor, _U)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    n = len(column)
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch whose texts take about ``limit`` bytes (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < len(sizes):
        before = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


class Words(NamedTuple):
    start: np.ndarray
    """Byte where each word begins."""
    end: np.ndarray
    row: np.ndarray
    """Row of each word, ascending."""
    hash: np.ndarray
    bounds: np.ndarray
    """Words of row r: ``bounds[r]`` to ``bounds[r + 1]``."""


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte run, equal runs only being equal but for chance."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((_VALUE_LOWER if lower else _VALUE)[data] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U) * _BASE)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Maximal runs of bytes other than white space; with ``lower``, A-Z hash like a-z."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, _U), np.zeros(len(offsets), np.int64))
    inside = ~SPACE[data]
    edge = offsets[(offsets > 0) & (offsets < n)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(start, end, row, run_hashes(data, start, end, lower), bounds)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for every k consecutive hashes, the order of words mattering."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, _U)
    total = np.zeros(n, _U)
    for i in range(k):
        total = total * _BASE + hashes[i : i + n]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned hashes as the signed longs of Spark."""
    return x.view(np.int64)


def list_column(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def runs_before(cut: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the runs between cuts; a row that is not empty begins a run."""
    n = len(cut)
    first = cut.copy()
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], n)[: len(start)]
    row = np.searchsorted(offsets[1:], start, "right")
    return start, end, row


def gather(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some runs after one another, and their bounds."""
    size = end - start
    bounds = np.concatenate([[0], np.cumsum(size)])
    return data[np.arange(bounds[-1]) - np.repeat(bounds[:-1] - start, size)], bounds


def binary_column(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Byte runs as an Arrow binary column."""
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(bounds, np.int32)), pa.py_buffer(np.ascontiguousarray(values))],
    )
