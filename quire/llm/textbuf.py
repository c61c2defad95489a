"""Vectorised work on the UTF-8 bytes of an Arrow text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RNG = np.random.default_rng(20240229)
BYTE64 = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def slices(column: pa.Array, max_bytes: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents; null counts as empty.

    A run has ``max_bytes`` at most, or is one document.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def runs_of(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, after the last) of runs of items whose sizes add up to ``most``, or that are one item."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def words(buf: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the maximal runs of bytes that ``sep`` does not mark."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~sep[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    p, q = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE64[buf] * p[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * q[starts] + (ends - starts).astype(np.uint64) * BYTE64[0])


def grouped(batches: Iterator[pa.RecordBatch], key: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.Table]:
    """Tables that end where a group ends, of a partition sorted by group; ``key`` gives a row's group."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = key(batch)
        cut = np.flatnonzero(k[1:] != k[:-1])
        if last is not None and k[0] != last:
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            at = int(cut[-1]) + 1
            held.append(batch.slice(0, at))
            yield pa.Table.from_batches(held)
            held = [batch.slice(at)]
        else:
            held.append(batch)
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held)


def binary_rows(column: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    """A matrix from a binary column whose values have ``width`` items each."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), dtype)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(dtype).reshape(len(column), width)


def pack_rows(matrix: np.ndarray) -> pa.Array:
    """A binary column of a matrix's rows."""
    matrix = np.ascontiguousarray(matrix)
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize if len(matrix) else 0
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(matrix.tobytes())])


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def batch(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], [f"c{k}" for k in range(len(columns))])


def with_columns(docs: DataFrame, text_col: str, run: Callable, new: dict[str, str]) -> DataFrame:
    """The rows of ``docs`` with new columns that ``run`` appends to batches whose last column is the text.

    Columns go by their places, so any names can be given; a given column named like a new one is replaced.
    """
    names = [c for c in docs.columns if c not in new]
    kinds = dict(docs.dtypes)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"c{k} {kind}" for k, kind in enumerate([*(kinds[c] for c in names), *new.values()]))
    return rows.mapInArrow(run, schema).toDF(*names, *new)
