"""Operator 12: whitening of embeddings on their leading principal components.

Entries become whole numbers, and each distinct vector is fitted once. The covariance is summed over partitions in whole numbers
and rounded once. Its eigenvectors are taken in float32, and Ogita-Aishima iterations in the widest float correct them: each
measures how far the vectors are from orthogonal and from diagonalising the covariance, and removes both errors to first order,
with four matrix products. Where eigenvalues lie closer than the error at hand, that correction has no safe
denominator; such clusters are only made orthogonal, then the covariance shifted by the cluster's centre is solved within the
cluster's span, which separates what belongs together by more than the error, and the iterations go on.

Defined cases: vectors that are null or hold null or non-finite entries are dropped; of vectors of several lengths those of the
commonest among the distinct ones stay (on ties the longest), empty vectors never; a null vec_id stays null; repeated rows each get their
rows; components without variance are not returned, so a single distinct vector, like an empty table, gives no
rows; entries of 2**23 and more are an error; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import by_batch, read_table, stored
from tripledger.llm.vectors import covariance, matrix, whole_rows

SCALE, COMPONENTS = 256.0, 4
#: Corrections at most; they converge quadratically, so float32 takes about three, and each cluster adds a few.
CORRECTIONS = 40


def corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """One Ogita-Aishima step: eigenvalues, better eigenvectors, and the gap below which eigenvalues count as one."""
    one = np.eye(len(a), dtype=a.dtype)
    off = one - x.T @ x
    turned = x.T @ (a @ x)
    values = np.diag(turned) / (1 - np.diag(off))
    near = 2 * (_norm(turned - np.diag(values)) + _norm(a) * _norm(off))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > near
    change = np.triu(np.where(apart, (turned + values[None, :] * off) / np.where(apart, gap, 1), off / 2))
    # both triangles add up to what orthogonality lacks, so rounding over a small gap turns vectors but does not skew them
    change = change + np.tril(off - change.T, -1)
    return values, x + x @ change, float(near)


def _norm(a: np.ndarray) -> np.floating:
    return np.sqrt((a * a).sum())


def _clusters(values: np.ndarray, near: float) -> list[np.ndarray]:
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > near) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix, to double precision.

    The entry of largest size of every eigenvector is positive.
    """
    a = a.astype(np.longdouble)
    size = _norm(a) or np.longdouble(1)
    a = a / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    floor = len(a) * np.finfo(np.longdouble).eps
    before = np.inf
    for _ in range(CORRECTIONS):
        values, x, near = corrected(a, x)
        if near <= 16 * floor or near >= before and near < 1e3 * floor:
            break
        before = near
        for group in _clusters(values, near):
            part = x[:, group]
            inner = part.T @ (a @ part)
            inner = inner - np.eye(len(group), dtype=a.dtype) * (np.trace(inner) / len(group))
            width = np.abs(inner).max()
            if width > floor:
                turn = np.linalg.eigh((inner / width).astype(np.float64))[1]
                x[:, group] = part @ turn.astype(np.longdouble)
    x = x + x @ (np.eye(len(a), dtype=a.dtype) - x.T @ x) / 2
    x = x / np.sqrt((x * x).sum(axis=0))
    values = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    x = x[:, order]
    x = x * np.sign(x[np.abs(x).argmax(axis=0), np.arange(len(a))])
    return (values[order] * size).astype(np.float64), x.astype(np.float64)


@dataclass(frozen=True)
class Whitening:
    """What a task needs: one number per dimension, and one vector per component."""

    size: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def spread(self, whole: np.ndarray) -> np.ndarray:
        """n * x - sums, exact."""
        peak = 2 * self.n * max(1, int(np.abs(whole).max(initial=0)))
        if peak * peak * self.size < 1 << 62:
            return whole * self.n - np.array(self.sums, np.int64)
        return whole.astype(object) * self.n - np.array(self.sums, object)

    def projected(self, spread: np.ndarray) -> np.ndarray:
        return (spread / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)


def fit_list(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """x (array of whole numbers), each distinct one of the commonest length once; written to the shared folder."""
    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, found = whole_rows(batch.column("embedding"), scale)
        offsets = np.concatenate(([0], np.cumsum([len(v) for v in found]))).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["x"])

    fit = stored(embeddings.select("embedding").mapInArrow(by_batch(whole), "x array<int>").where("size(x) > 0").distinct(), "fit")
    common = fit.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).head()
    return fit.where(F.size("x") == (common["size"] if common else 0))


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The leading components of a fit list; None where it is empty."""
    first = distinct.select(F.size("x").alias("size")).head()
    if first is None:
        return None
    n, sums, cov = covariance(distinct, "x", first["size"])
    values, vectors = eigen(cov)
    real = values > len(values) * 2.0 ** -50 * max(values[0], 0)
    count = min(components, int(real.sum()))
    return Whitening(first["size"], n, sums, values[:count], vectors[:, :count], float(np.trace(cov)))


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest distance of an entry of the whitened fit list's covariance from the identity's."""
    count = len(model.values)
    if not count:
        return 0.0

    def white(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = model.projected(model.spread(matrix(batch.column("x"), model.size).astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], names)

    names = [f"w{k}" for k in range(count)]
    rows = distinct.select("x").mapInArrow(by_batch(white), ", ".join(f"{n} double" for n in names))
    gaps = [F.abs(F.covar_pop(names[i], names[j]) - float(i == j)) for i in range(count) for j in range(i, count)]
    return rows.agg(F.greatest(*gaps, F.lit(0.0))).head()[0]


_COLUMNS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double"


def whiten(embeddings: DataFrame, model: Whitening | None, scale: float = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened and explained, one row per remaining row and component.

    deviation is the squared distance from the mean, times n squared.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], _COLUMNS)
    count = len(model.values)

    def white(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept, whole = whole_rows(batch.column("embedding"), scale, model.size)
        spread = model.spread(whole)
        square = [int(s) for s in (spread * spread).sum(axis=1)]
        every = np.repeat(np.arange(len(kept)), count)
        return pa.RecordBatch.from_arrays([
            batch.column("vec_id").take(pa.array(kept[every])),
            pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(kept))),
            pa.array(np.full(len(every), model.n)),
            pa.array(square, pa.decimal128(38, 0)).take(pa.array(every)),
            pa.array(model.projected(spread).ravel()),
            pa.array(np.tile(model.values / model.trace, len(kept)))],
            ["vec_id", "component", "n", "deviation", "whitened", "explained"])

    return rows.mapInArrow(by_batch(white), _COLUMNS)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation that no long holds, which takes about 10**7 vectors of full size, is null here; :func:`whiten` has it."""
    embeddings = read_table(spark, sf_dir, "embeddings")
    distinct = fit_list(embeddings)
    model = fit(distinct)
    error = identity_error(distinct, model) if model else 0.0
    return whiten(embeddings, model).select(
        "vec_id", "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened", "explained",
        F.lit(error).alias("identity_error"))
