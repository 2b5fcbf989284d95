"""Operator 13: k-means in whole numbers with PCA-rotated filtering.

The axes of the covariance of all vectors are found once. Stored with every vector are its ``LEADING`` first coordinates on
them and the length of the rest. For a vector and a centroid, the squared distance of these coordinates plus the squared
difference of the two lengths is at most their squared distance. So a vector is compared in whole numbers with the centroid of the
smallest bound, and then only with centroids whose bound does not exceed the best distance so far. Rounding is on the safe
side: bounds are lowered by more than the error of a double. Any other rotation would give the same clusters.

A round is one pass over the stored table: tasks add up whole numbers per centroid and dimension, and the driver gets one number for each.

Defined cases: vectors that are null, hold null or non-finite entries or have another size are dropped; a null vec_id is clustered, and
starts a centroid only behind all others; of rows with one vec_id the smaller vector comes first; with fewer vectors than centroids
there are as many centroids as vectors; repeated rows count each; an empty table gives no rows; entries of 2**17 and more are an
error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.llm.frames import by_batch, read_table, stored
from tripledger.llm.vectors import added, covariance, lists, matrix, whole_rows

SCALE, SIZE, CENTROIDS, ROUNDS, SALT = 1024.0, 64, 8, 10, "3:"
#: Rotated coordinates stored with a vector.
LEADING = 8


@dataclass(frozen=True)
class Rotation:
    """A point and orthonormal axes (columns)."""

    middle: np.ndarray
    axes: np.ndarray

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and length of the rest."""
        y = x - self.middle
        leading = y @ self.axes
        return leading, np.sqrt(np.maximum(((y - leading @ self.axes.T) ** 2).sum(axis=1), 0))


def nearest(x: np.ndarray, leading: np.ndarray, rest: np.ndarray, centroids: np.ndarray, rotation: Rotation):
    """(cluster, squared distance, number of distances computed) of every row of whole numbers ``x``."""
    c_leading, c_rest = rotation.place(centroids.astype(np.float64))
    own, other = (leading ** 2).sum(axis=1), (c_leading ** 2).sum(axis=1)
    bound = own[:, None] - 2 * leading @ c_leading.T + other + (rest[:, None] - c_rest) ** 2
    bound -= 1e-10 * (own[:, None] + other + rest[:, None] ** 2 + c_rest ** 2) + 1e-3
    cluster = bound.argmin(axis=1)
    best = ((x - centroids[cluster]) ** 2).sum(axis=1)
    first, done = cluster.copy(), len(x)
    for k, c in enumerate(centroids):
        rows = np.flatnonzero((bound[:, k] <= best) & (first != k))
        gap = ((x[rows] - c) ** 2).sum(axis=1)
        better = (gap < best[rows]) | (gap == best[rows]) & (k < cluster[rows])
        cluster[rows[better]], best[rows[better]] = k, gap[better]
        done += len(rows)
    return cluster, best, done


def kept_vectors(embeddings: DataFrame, scale: float = SCALE, size: int = SIZE) -> DataFrame:
    """vec_id and x (whole numbers) of the vectors that are clustered; written to the shared folder."""
    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, x = whole_rows(batch.column("embedding"), scale, size)
        if x.size and np.abs(x).max() >= 1 << 27:
            raise OverflowError("a vector entry is too large for distances of 64 bits")
        return pa.RecordBatch.from_arrays(
            [batch.column("vec_id").take(pa.array(rows)), lists(x.astype(np.int32))], ["vec_id", "x"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return stored(rows.mapInArrow(by_batch(whole), "vec_id long, x array<int>"), "vectors")


def rotated(vectors: DataFrame, size: int = SIZE, leading: int = LEADING) -> tuple[DataFrame, Rotation]:
    """The vectors with their leading coordinates and the length of the rest; written to the shared folder."""
    n, sums, cov = covariance(vectors, "x", size)
    axes = np.linalg.eigh(cov.astype(np.float64))[1][:, ::-1][:, :leading].copy()
    rotation = Rotation(np.array([s / max(n, 1) for s in sums]), axes)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        near, rest = rotation.place(matrix(batch.column("x"), size).astype(np.float64))
        return pa.RecordBatch.from_arrays(
            [*batch.columns, lists(near), pa.array(rest)], ["vec_id", "x", "leading", "rest"])

    return stored(vectors.select("vec_id", "x").mapInArrow(
        by_batch(place), "vec_id long, x array<int>, leading array<double>, rest double"), "rotated"), rotation


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The vectors with the smallest hashes, in the order of the hash."""
    name = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["x"] for r in vectors.orderBy(name.asc_nulls_last(), "x").limit(count).toArrow().to_pylist()], np.int64)


def cluster(
    embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, salt: str = SALT,
    scale: float = SCALE, size: int = SIZE, leading: int = LEADING,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (array) of every kept vector."""
    ddl = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"
    vectors = kept_vectors(embeddings, scale, size)
    at = first_centroids(vectors, centroids, salt)
    if not len(at):
        return embeddings.sparkSession.createDataFrame([], ddl)
    leading = min(leading, size)
    table, rotation = rotated(vectors, size, leading)
    columns = ("x", "leading", "rest")

    def found(batch: pa.RecordBatch, at: np.ndarray):
        x = matrix(batch.column("x"), size).astype(np.int64)
        return x, *nearest(x, matrix(batch.column("leading"), leading), batch.column("rest").to_numpy(), at, rotation)

    def totals(at: np.ndarray) -> np.ndarray:
        """Per centroid the sum of its vectors, their number, and the sum of their distances."""
        def of_batch(batch: pa.RecordBatch) -> np.ndarray:
            x, cluster, best, _ = found(batch, at)
            sums = [np.append(x[cluster == k].sum(axis=0), [(cluster == k).sum(), best[cluster == k].sum()]) for k in range(len(at))]
            return np.concatenate(sums)
        return np.array(added(table, of_batch, *columns), object).reshape(len(at), size + 2)

    for _ in range(rounds):
        sums = totals(at)
        at = np.array([row[:size] // row[size] if row[size] else old for row, old in zip(sums, at.astype(object))], np.int64)
    inertia = totals(at)[:, -1].astype(np.int64)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, cluster, best, _ = found(batch, at)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(inertia[cluster]),
                pa.array(np.full(len(best), inertia.sum())), lists(at).take(pa.array(cluster))],
                ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return table.select("vec_id", *columns).mapInArrow(assign, ddl)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.array_join("centroid", ",").cast("binary"), 256)
    return cluster(read_table(spark, sf_dir, "embeddings")).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def _oracle() -> str:
    """SQL of all rounds: squared distances by joining entries, smallest (distance, number) per vector, floored means."""
    steps = [f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = {SIZE}),
e AS MATERIALIZED (SELECT vec_id, unnest(x) AS c, unnest(range({SIZE})) AS d FROM v),
first AS (SELECT x, row_number() OVER (ORDER BY sha256('{SALT}' || vec_id)) - 1 AS k FROM v
  ORDER BY sha256('{SALT}' || vec_id) LIMIT {CENTROIDS}),
c0 AS MATERIALIZED (SELECT k, unnest(x) AS c, unnest(range({SIZE})) AS d FROM first)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (SELECT vec_id, min((s, k)) AS best FROM (
  SELECT vec_id, k, sum((e.c - m.c) * (e.c - m.c))::BIGINT AS s FROM e JOIN c{r} m USING (d) GROUP BY vec_id, k)
  GROUP BY vec_id)""")
        if r < ROUNDS:
            steps.append(f"""
c{r + 1} AS MATERIALIZED (SELECT m.k, m.d, coalesce(n.c, m.c) AS c FROM c{r} m LEFT JOIN (
  SELECT best[2] AS k, d, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS c
  FROM e JOIN a{r} USING (vec_id) GROUP BY best[2], d) n USING (k, d))""")
    return ",".join(steps) + f""",
h AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY d)) AS name FROM c{ROUNDS} GROUP BY k)
SELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia,
  (sum(best[1]) OVER ())::BIGINT AS inertia, name AS centroid_sha256
FROM a{ROUNDS} JOIN h ON h.k = best[2]
"""


ORACLE = _oracle()
