"""Tail probabilities, which Spark SQL has no functions for.

They run as vectorised Arrow UDFs and are only ever applied after aggregation:
to one row per test, or one row per resampling iteration.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these helpers inside the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STEPS = 20_000
_TINY = 1e-300


def _each(fn, x) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    return np.array([fn(v) for v in x.ravel()], dtype=float).reshape(x.shape)


def _lgamma(x) -> np.ndarray:
    return _each(math.lgamma, x)


def _erfc(x) -> np.ndarray:
    return _each(math.erfc, x)


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    def guard(v):
        return np.where(np.abs(v) < _TINY, _TINY, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, _STEPS):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return np.where(np.abs(step - 1.0) < 1e-12, h, np.nan)


def incomplete_beta(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*[np.asarray(v, dtype=float) for v in (a, b, x)])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b)
                       + a * np.log(x) + b * np.log1p(-x))
        left = x < (a + 1.0) / (a + b + 2.0)
        value = np.where(
            left,
            front * _beta_fraction(a, b, x) / a,
            1.0 - front * _beta_fraction(b, a, 1.0 - x) / b,
        )
    return np.where(x <= 0.0, 0.0, np.where(x >= 1.0, 1.0, value))


def upper_gamma(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, dtype=float), np.asarray(x, dtype=float))
    out = np.ones_like(x)
    positive = x > 0
    with np.errstate(divide="ignore", invalid="ignore", over="ignore", under="ignore"):
        front = np.exp(-x + a * np.log(np.where(positive, x, 1.0)) - _lgamma(a))
        small = positive & (x < a + 1.0)
        if small.any():
            term = 1.0 / a
            total = term.copy()
            for k in range(1, 20_000):
                term = term * x / (a + k)
                total = total + term
                if np.all(term[small] <= total[small] * 1e-16):
                    break
            total = np.where(term <= total * 1e-12, total, np.nan)
            out = np.where(small, 1.0 - front * total, out)
        large = positive & ~small
        if large.any():
            b = x + 1.0 - a
            c = np.full_like(x, 1.0 / _TINY)
            d = 1.0 / np.where(b == 0, _TINY, b)
            h = d.copy()
            for k in range(1, 20_000):
                coef = -k * (k - a)
                b = b + 2.0
                d = coef * d + b
                d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
                c = b + coef / c
                c = np.where(np.abs(c) < _TINY, _TINY, c)
                step = d * c
                h = h * step
                if np.all(np.abs(step[large] - 1.0) < 1e-15):
                    break
            h = np.where(np.abs(step - 1.0) < 1e-12, h, np.nan)
            out = np.where(large, front * h, out)
    return out


def _lgamma_half(a: np.ndarray) -> np.ndarray:
    """lgamma(a + 1/2) - lgamma(a), by its series where the difference would cancel."""
    series = 0.5 * np.log(a) - 1 / (8 * a) + 1 / (192 * a ** 3)
    small = np.minimum(a, 1e4)
    return np.where(a > 1e4, series, _lgamma(small + 0.5) - _lgamma(small))


def t_two_sided(t, df) -> np.ndarray:
    """P(|T| > |t|): the incomplete beta function in y = t²/(df + t²).

    Above a million degrees of freedom the normal limit and its first correction; the next term of that
    expansion, |φ(t) (3t⁷ - 7t⁵ - 5t³ - 3t) / (48 df²)|, is below 1e-12 there for every t.
    """
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    ok = np.isfinite(t) & np.isfinite(df) & (df > 0)
    t_, df_ = np.where(ok, t, 0.0), np.where(ok, df, 1.0)
    a, y = df_ / 2.0, t_ * t_ / (df_ + t_ * t_)
    half = np.full_like(a, 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma_half(a) - math.lgamma(0.5) + a * np.log1p(-y) + 0.5 * np.log(y))
        near = y < 1.5 / (a + 2.5)
        p = np.where(near, 1.0 - 2 * front * _beta_fraction(half, a, np.where(near, y, 0.0)),
                     front * _beta_fraction(a, half, np.where(near, 0.0, 1.0 - y)) / a)
    z = np.abs(t_)
    density = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    limit = _erfc(z / math.sqrt(2.0)) + density * (z + np.minimum(z, 1e3) ** 3) / (2 * df_)
    return np.where(ok, np.where(y <= 0.0, 1.0, np.where(df_ > 1e6, limit, p)), np.nan)


def chi2_upper(chi2, dof) -> np.ndarray:
    chi2, dof = np.asarray(chi2, dtype=float), np.asarray(dof, dtype=float)
    ok = np.isfinite(chi2) & (dof > 0)
    p = upper_gamma(np.where(ok, dof, 1.0) / 2.0, np.where(ok, chi2, 0.0) / 2.0)
    return np.where(ok, p, np.nan)


def normal_two_sided(z) -> np.ndarray:
    z = np.asarray(z, dtype=float)
    return np.where(np.isnan(z), np.nan, _erfc(np.abs(np.nan_to_num(z)) / math.sqrt(2.0)))


def _as_column(values: np.ndarray) -> pd.Series:
    return pd.Series([None if np.isnan(v) else float(v) for v in values], dtype="object")


@F.pandas_udf(T.DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return _as_column(t_two_sided(t, df))


@F.pandas_udf(T.DoubleType())
def chi2_pvalue(chi2: pd.Series, dof: pd.Series) -> pd.Series:
    return _as_column(chi2_upper(chi2, dof))


@F.pandas_udf(T.DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return _as_column(normal_two_sided(z))
