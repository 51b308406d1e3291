"""Vectorised text primitives over the UTF-8 bytes of Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D. Word hashes are 64-bit
polynomial hashes taken from prefix sums, so their cost does not depend on word length.
All constants are fixed: hashes are equal across tasks, executors and runs.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C libraries have it
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_Q = [pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(64)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)

BLOCK = 1 << 19  # bytes that are hashed at once

_powers: list[np.ndarray] = [np.ones(0, U64), np.ones(0, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64; a worker keeps 2 * BLOCK of them and makes longer runs anew."""
    if not len(_powers[0]):
        for k, base in enumerate((_P, _P_INV)):
            step = np.full(2 * BLOCK, base, U64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    size = len(_powers[0])
    if n <= size:
        return _powers[0][:n], _powers[1][:n]
    out = []
    for k, base in enumerate((_P, _P_INV)):
        steps = np.array([pow(base, size * j, 1 << 64) for j in range(-(-n // size))], U64)
        out.append((steps[:, None] * _powers[k][None, :]).ravel()[:n])
    return out[0], out[1]


Batches = Iterator[pa.RecordBatch]


def release() -> None:
    """Return what the worker has freed to the system: workers outlive their tasks and share the executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that lets go of its memory when the task ends."""

    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            release()

    return wrapped


def tidy_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow, at the end of every group."""

    def wrapped(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    if column.null_count:
        column = column.fill_null(b"" if large == pa.large_binary() else "")
    column = column.cast(large)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole rows with about ``most`` bytes."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """Words of a chunk: byte ranges, 64-bit hashes, and word offsets of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = SAME, inside: np.ndarray | None = None):
        n = len(data)
        part = inside[data] if inside is not None else ~SPACE[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:] = part[:-1]
        after[:-1] = part[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[edges] = False
        after[edges[1:] - 1] = False
        self.part = part
        self.starts = np.flatnonzero(part & ~before)
        self.ends = np.flatnonzero(part & ~after) + 1
        self.rows = np.searchsorted(self.starts, offsets)
        self.hashes = ranges_hash(data, self.starts, self.ends, fold)


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end), whose starts and ends rise; a run of ranges over about BLOCK bytes at a time."""
    value = np.zeros(len(starts), U64)
    k = 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + 2 * BLOCK, "right")))
        a, b = int(starts[k]), int(ends[stop - 1])
        if b > a:
            power, inverse = powers(b - a)
            sums = np.zeros(b - a + 1, U64)
            np.cumsum((fold[data[a:b]].astype(U64) + U64(1)) * power, out=sums[1:])
            value[k:stop] = (sums[ends[k:stop] - a] - sums[starts[k:stop] - a]) * inverse[np.minimum(starts[k:stop] - a, b - a - 1)]
        k = stop
    return mix(value + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def windows_hash(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive values; shorter than the input by width - 1."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.full(n, width, U64)
    for k in range(width):
        total += hashes[k : k + n] * U64(_Q[k + 1])
    return mix(total)


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes): A-Z folded; one shingle of all words if fewer than ``width``."""
    for row, _, data, offsets in chunks(column):
        words = Words(data, offsets, LOWER)
        wide = windows_hash(words.hashes, width)
        for k in range(len(offsets) - 1):
            a, b = int(words.rows[k]), int(words.rows[k + 1])
            if b - a >= width:
                found = wide[a : b - width + 1].copy()
                found.sort()
                keep = np.ones(len(found), bool)
                np.not_equal(found[1:], found[:-1], out=keep[1:])
                yield row + k, found[keep]
            else:
                yield row + k, windows_hash(words.hashes[a:b], b - a) if b > a else np.zeros(0, U64)


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[k]:offsets[k + 1]] for every k."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]
