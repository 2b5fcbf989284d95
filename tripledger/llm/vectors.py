"""Vectors in Arrow batches as matrices of whole numbers, and exact sums over them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows whose whole numbers are multiplied at a time.
BLOCK = 1 << 14


def whole_rows(column: pa.Array, scale: float, size: int | None = None) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """(row numbers, floor(scale * entry) of these rows) of the vectors without null or non-finite entries.

    Given ``size``, only vectors of that many entries, as one int64 matrix; else a list of vectors. Entries of 2**31 and more
    after scaling are an error, since sums over them would not fit.
    """
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)
    end = np.cumsum(np.maximum(length, 0))
    begin = end - np.maximum(length, 0)
    rows = np.flatnonzero(length >= 0 if size is None else length == size)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    rows = rows[bad[end[rows]] == bad[begin[rows]]]
    whole = np.floor(flat * scale)
    if size is None:
        taken = np.repeat(False, len(flat))
        for r in rows:
            taken[begin[r]:end[r]] = True
        _bounded(whole[taken])
        return rows, [whole[begin[r]:end[r]].astype(np.int64) for r in rows]
    picked = whole[begin[rows][:, None] + np.arange(size)]
    _bounded(picked)
    return rows, picked.astype(np.int64)


def _bounded(values: np.ndarray) -> None:
    if values.size and np.abs(values).max() >= 1 << 31:
        raise OverflowError("a vector entry is too large for whole-number arithmetic")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of ``size`` entries each, none null, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as an Arrow column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).ravel()))


def added(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], *columns: str | Column) -> list[int]:
    """Entry by entry the sum of ``make`` of every batch: an array of whole numbers, always of one length.

    A task adds its batches up and hands on one row per entry; these meet in a shuffle by entry. Decimals of 38 digits keep
    every sum exact, so it does not depend on how the rows were split. The result has as many numbers as one array.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = make(batch).astype(object)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array([*map(int, total)], pa.decimal128(38, 0))], ["entry", "value"])

    sums = df.select(*columns).mapInArrow(run, "entry long, value decimal(38,0)")
    found = sums.groupBy("entry").agg(F.sum("value").alias("value")).toArrow().to_pylist()
    out = [0] * len(found)
    for row in found:
        out[row["entry"]] = int(row["value"])
    return out


def products(values: np.ndarray) -> np.ndarray:
    """Upper triangle of values' @ values, exact, row after row."""
    size = values.shape[1]
    upper = np.triu_indices(size)
    peak = int(np.abs(values).max(initial=0))
    if peak * peak * BLOCK >= 1 << 53:
        wide = values.astype(object)
        return (wide.T @ wide)[upper]
    total = np.zeros(len(upper[0]), object)
    for k in range(0, len(values), BLOCK):
        block = values[k:k + BLOCK].astype(np.float64)
        total = total + (block.T @ block)[upper].astype(np.int64)
    return total


def covariance(df: DataFrame, column: str, size: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) of the vectors of ``size`` whole numbers in ``column``, divisor n; n is 0 for no vectors.

    Vectors are centred by the whole number next to the mean before they are multiplied. What is left of the mean is taken off
    the sums of products as whole numbers, so the matrix is that of fully centred vectors, rounded once.
    """
    sums = added(df, lambda b: np.append(matrix(b.column(column), size).astype(np.int64).sum(axis=0), b.num_rows), column)
    if not sums:
        return 0, [0] * size, np.zeros((size, size), np.longdouble)
    *sums, n = sums
    middle = np.array([round(s / n) for s in sums], np.int64)
    found = added(df, lambda b: products(matrix(b.column(column), size).astype(np.int64) - middle), column)
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    out = np.zeros((size, size), np.longdouble)
    for value, i, j in zip(found, *np.triu_indices(size)):
        out[i, j] = out[j, i] = quotient(n * value - rest[i] * rest[j], n * n)
    return n, sums, out


def quotient(a: int, b: int) -> np.longdouble:
    """a / b of whole numbers of any size, to the last digits of the widest float."""
    whole, rest = divmod(a, b)
    return np.longdouble(whole) + np.longdouble(rest << 80) / np.longdouble(b) / np.longdouble(1 << 80) \
        if b.bit_length() < 900 else np.longdouble(a / b)
