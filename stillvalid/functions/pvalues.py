"""Tail probabilities in closed form, as scalar functions and as Arrow functions over result rows.

They run on finished statistics (a few rows per comparison), never on observations.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-square: a finite sum for every whole number of degrees of freedom."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term, s = math.exp(-half), math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            s += term
        return min(1.0, s)
    s = math.erfc(math.sqrt(half))
    term = math.sqrt(2.0 * x / math.pi) * math.exp(-half)
    for i in range(1, (df - 1) // 2 + 1):
        s += term
        term *= x / (2 * i + 1)
    return min(1.0, s)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation under independence."""
    if n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    t2 = r * r * (n - 2) / (1.0 - r * r)
    return beta_cdf((n - 2) / (n - 2 + t2), (n - 2) / 2.0, 0.5)


def signed_rank_exact(w: float, n: int) -> float:
    """P(W <= w) of the signed-rank statistic without ties or zeros."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, n + 1):
        counts[rank:] = counts[rank:] + counts[:-rank]
    return float(counts[: int(math.floor(w)) + 1].sum() / counts.sum())


def signed_rank_p(w_plus: float, n: int, tie_sum: float, n_zero: int, n_far: int,
                  method: str = "normal") -> float:
    """One-sided p ("less") of the paired signed-rank test with zeros split.

    ``tie_sum`` is the sum of t^3 - t over tied groups. Under five pairs, or with no pair that
    differs, the answer is 1. ``method``: "normal" (the default, at every size) or "exact", the null
    distribution of untied ranks, which asks for pairs without ties or zeros.
    """
    if method not in ("normal", "exact"):
        raise ValueError(f"unknown method {method!r}")
    if n < 5 or n_far == 0:
        return 1.0
    if method == "exact":
        if n_zero or tie_sum:
            raise ValueError("the exact null needs pairs without ties or zeros")
        return signed_rank_exact(w_plus, n)
    mean = n * (n + 1) / 4.0
    var = (n * (n + 1.0) * (2.0 * n + 1.0) - 0.5 * tie_sum) / 24.0
    return normal_cdf((w_plus - mean) / math.sqrt(var)) if var > 0 else 1.0


@F.pandas_udf(T.DoubleType())
def signed_rank_p_col(w: pd.Series, n: pd.Series, ties: pd.Series, zero: pd.Series,
                      far: pd.Series) -> pd.Series:
    return pd.Series([signed_rank_p(a, int(b), c, int(d), int(e))
                      for a, b, c, d, e in zip(w, n, ties, zero, far)])


@F.pandas_udf(T.DoubleType())
def chi2_sf_col(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, int(b)) for a, b in zip(x, df)])


@F.pandas_udf(T.DoubleType())
def correlation_p_col(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else correlation_p(a, int(b)) for a, b in zip(r, n)])
