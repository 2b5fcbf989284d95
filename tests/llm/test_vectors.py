"""Whitening and clustering of vectors against plain computations."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.helpers import by_row
from tripledger.llm import centroids, whitening
from tripledger.llm.vectors import covariance, products

SCHEMA = "vec_id long, embedding array<float>, label int, x string, component int, cluster string, leading double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 7, "c", 0.5) for i, v in rows], SCHEMA).repartition(3)


def vectors(seed, n, size, copies=0.3):
    rng = np.random.default_rng(seed)
    made = [rng.normal(0, 0.3, size).astype(np.float32).tolist() for _ in range(n)]
    made += [made[0]] * int(n * copies)
    return list(enumerate(made))


def broken(n, size):
    return [(n, None), (n + 1, [None] * size), (n + 2, [math.nan] * size), (n + 3, [0.0] * (size - 1) + [math.inf]), (n + 4, [0.1] * (size + 2)),
            (n + 5, []), (None, [0.2] * size), (0, [-0.1] * size), (0, [0.3] * size)]


# --- eigenvectors --------------------------------------------------------------------

def basis(size):
    return np.linalg.qr(np.random.default_rng(size).normal(size=(size, size)))[0]


@pytest.mark.parametrize("values", [
    np.arange(1, 33.0), np.ones(8), np.zeros(4), np.concatenate([[5, 5, 5 + 1e-9, 5 + 2e-9, 5 + 1e-12], np.linspace(0, 1, 20)]),
    1 + 1e-10 * np.arange(16), 10.0 ** -np.arange(20.0), np.repeat([3.0, 2.0, 1e-3], 6)], ids=range(7))
def test_eigenvectors(values):
    q = basis(len(values))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    found, x = whitening.eigen(a)
    top = max(values.max(), 1e-300)
    assert np.abs(x.T @ x - np.eye(len(a))).max() < 1e-14
    assert np.abs(a @ x - x * found).max() < 4e-15 * top
    assert np.all(np.diff(found) <= 0) and np.allclose(found, np.sort(values)[::-1], atol=1e-14 * top)


def test_corrections_beat_float32():
    """What float32 leaves, three corrections take away; each at least squares the error."""
    q = basis(40)
    a = ((q * np.linspace(1, 2, 40)) @ q.T).astype(np.longdouble)
    a = (a + a.T) / 2
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    errors = []
    for _ in range(4):
        values, x, near = whitening.corrected(a, x)
        errors.append(near)
    assert errors[0] > 1e-8 and errors[1] < 1e-9 and errors[2] < 1e-15 and errors[3] < 1e-16


# --- whitening ---------------------------------------------------------------------------

def brute_whitening(rows, count=4):
    whole = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows]
    fit = [list(v) for v in {tuple(v) for _, v in whole}]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    spread = [[n * c - s for c, s in zip(v, sums)] for v in fit]
    size = len(sums)
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in spread), n ** 3)) for j in range(size)] for i in range(size)])
    values, axes = np.linalg.eigh(cov)
    out = {}
    for i, v in whole:
        y = [n * c - s for c, s in zip(v, sums)]
        for k in range(min(count, size)):
            e, axis = values[-1 - k], axes[:, -1 - k]
            out.setdefault((i, k + 1), []).append((n, sum(c * c for c in y), float(np.array(y) / n @ axis / math.sqrt(e)), e / np.trace(cov)))
    return out


def test_whitening(spark):
    rows = vectors(2, 60, 6)
    good = rows + [(None, [0.2] * 6), (0, [-0.1] * 6), (0, [0.3] * 6)]
    df = table(spark, rows + broken(100, 6))
    distinct = whitening.fit_list(df)
    model = whitening.fit(distinct)
    got = whitening.whiten(df, model).collect()
    want = brute_whitening(good)
    assert Counter((r["vec_id"], r["component"]) for r in got) == Counter({k: len(v) for k, v in want.items()})
    signs = {}
    for key, group in want.items():
        mine = sorted((r["n"], int(r["deviation"]), r["whitened"], r["explained"]) for r in got if (r["vec_id"], r["component"]) == key)
        for a, b in zip(mine, sorted(group)):
            assert a[:2] == b[:2] and a[3] == pytest.approx(b[3], rel=1e-12)
            assert abs(a[2]) == pytest.approx(abs(b[2]), abs=1e-10)
            signs.setdefault(key[1], set()).add(a[2] * b[2] > 0) if abs(b[2]) > 1e-9 else None
    assert all(len(s) == 1 for s in signs.values())
    assert whitening.identity_error(distinct, model) < 1e-12


def test_whitening_without_variance(spark):
    """Nothing, one distinct vector, and fewer directions than components."""
    def run(rows):
        df = table(spark, rows)
        distinct = whitening.fit_list(df)
        model = whitening.fit(distinct)
        return whitening.whiten(df, model).collect(), whitening.identity_error(distinct, model) if model else 0.0

    assert run([]) == ([], 0.0)
    assert run([(1, None), (2, [])]) == ([], 0.0)
    assert run([(1, [0.5, 0.25])] * 3) == ([], 0.0)
    found, error = run([(1, [0.5, 0.25]), (2, [0.25, 0.5]), (3, [0.5, 0.25])])
    assert sorted((r["vec_id"], r["component"], abs(round(r["whitened"], 9))) for r in found) == [(1, 1, 1), (2, 1, 1), (3, 1, 1)]
    assert error < 1e-12


def test_exact_sums(spark):
    """Large entries, for which products of doubles would round, and a mean between whole numbers."""
    x = np.random.default_rng(3).integers(-2 ** 30, 2 ** 30, (50, 3))
    assert products(x).tolist() == [int(v) for v in (x.astype(object).T @ x.astype(object))[np.triu_indices(3)]]
    df = spark.createDataFrame([(r,) for r in x.tolist()], "x array<int>").repartition(4)
    n, sums, cov = covariance(df, "x", 3)
    assert (n, sums) == (50, x.sum(axis=0).tolist())
    y = x.astype(object) * 50 - np.array(sums, object)
    want = [[float(Fraction(int(v), 50 ** 3)) for v in row] for row in y.T @ y]
    assert cov.astype(float).tolist() == want
    with pytest.raises(Exception, match="too large"):
        whitening.fit_list(table(spark, [(1, [1e30])]))


# --- clustering --------------------------------------------------------------------------

def brute_clusters(rows, count, rounds, scale=1024):
    x = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows]
    named = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    at = [v for _, v in named[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(at)) for _, v in x]

    for _ in range(rounds):
        of = assign()
        for k in range(len(at)):
            mine = [v for (_, v), (_, c) in zip(x, of) if c == k]
            if mine:
                at[k] = [sum(c) // len(mine) for c in zip(*mine)]
    of = assign()
    total = {k: sum(d for d, c in of if c == k) for k in range(len(at))}
    return [(i, k, d, total[k], sum(total.values()), at[k]) for (i, _), (d, k) in zip(x, of)]


@pytest.mark.parametrize("leading", [0, 1, 3, 6])
def test_clusters(spark, leading):
    rows = vectors(4, 80, 6)
    got = centroids.cluster(table(spark, rows + broken(100, 6)), 5, 4, "3:", 1024.0, 6, leading).collect()
    want = brute_clusters(rows + [(None, [0.2] * 6), (0, [-0.1] * 6), (0, [0.3] * 6)], 5, 4)
    assert by_row(got) == by_row(want)


def test_clusters_of_few_and_of_ties(spark):
    """Fewer vectors than centroids; equal vectors, whose ties leave centroids empty; nothing."""
    for rows in ([(1, [0.5, 0.5])], [(i, [0.5, -0.5]) for i in range(9)], [(i, [0.25 * (i % 2), 0.0]) for i in range(9)], []):
        got = centroids.cluster(table(spark, rows), 4, 3, "3:", 1024.0, 2, 1).collect()
        assert by_row(got) == by_row(brute_clusters(rows, 4, 3))


def test_bounds_spare_work():
    """Bounds are never above the distance, and spare most of the distances."""
    rng = np.random.default_rng(6)
    middles = rng.integers(-900, 900, (8, 64))
    x = middles[rng.integers(0, 8, 4000)] + rng.integers(-60, 60, (4000, 64))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :8].copy()
    rotation = centroids.Rotation(x.mean(axis=0), axes)
    cluster, best, done = centroids.nearest(x, *rotation.place(x.astype(float)), middles, rotation)
    full = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (cluster == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert done < 1.5 * len(x)
