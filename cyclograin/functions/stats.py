"""Small exact distributions, applied to one row per test (never to raw data)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_SIGNED_RANK = 50
EXACT_RANK_SUM = 8


def signed_rank_counts(n: int) -> np.ndarray:
    """Number of sign patterns per rank-sum value for ranks 1..n."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] += ways[:-r].copy()
    return ways


def rank_sum_counts(m: int, n: int) -> np.ndarray:
    """Number of arrangements per Mann-Whitney U value for group sizes m and n."""
    # coefficients of the Gaussian binomial (m + n choose m)
    size = m * n + 1
    poly = np.zeros(size)
    poly[0] = 1.0
    for i in range(1, m + 1):
        up = n + i
        if up < size:
            poly[up:] -= poly[:-up].copy()
        for j in range(i, size):
            poly[j] += poly[j - i]
    return poly


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_p(n: int, w_plus: float, ties: float, exact_ok: bool) -> float:
    """Two-sided Wilcoxon signed-rank p; ``ties`` is the sum of t^3 - t over tie groups."""
    if n == 0:
        return 1.0
    total = n * (n + 1) / 2.0
    low = min(w_plus, total - w_plus)
    if exact_ok and n <= EXACT_SIGNED_RANK:
        ways = signed_rank_counts(n)
        return min(1.0, 2.0 * ways[: int(round(low)) + 1].sum() / 2.0**n)
    var = n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0
    return normal_two_sided((low - total / 2.0) / math.sqrt(var)) if var > 0 else 1.0


def rank_sum_p(n1: int, n2: int, u1: float, ties: float) -> float:
    """Two-sided Mann-Whitney p: exact for a small untied sample, else corrected normal."""
    if n1 == 0 or n2 == 0:
        return math.nan
    u = max(u1, n1 * n2 - u1)
    if ties == 0 and min(n1, n2) <= EXACT_RANK_SUM:
        ways = rank_sum_counts(n1, n2)
        return min(1.0, 2.0 * ways[int(round(u)) :].sum() / ways.sum())
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    z = (u - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
    return min(1.0, 2.0 * 0.5 * math.erfc(z / math.sqrt(2.0)))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Binomial(n, p), summed in logs."""
    if k <= 0:
        return 1.0
    i = np.arange(k, n + 1, dtype=float)
    lg = np.vectorize(math.lgamma)
    logs = math.lgamma(n + 1) - lg(i + 1) - lg(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    top = logs.max()
    return float(min(1.0, math.exp(top) * np.exp(logs - top).sum()))


def _beta_continued_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-14:
            break
    return h


def regularised_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1) / (a + b + 2):
        return front * _beta_continued_fraction(a, b, x) / a
    return 1.0 - front * _beta_continued_fraction(b, a, 1.0 - x) / b


def correlation_p(rho: float, n: int) -> float:
    """Two-sided p of a rank correlation from its t statistic."""
    if n < 3 or rho is None or math.isnan(rho):
        return math.nan
    if abs(rho) >= 1.0:
        return 0.0
    t2 = rho * rho * (n - 2) / (1.0 - rho * rho)
    return regularised_beta((n - 2) / 2.0, 0.5, (n - 2) / (n - 2 + t2))


@F.pandas_udf(T.DoubleType())
def signed_rank_p_col(n: pd.Series, w: pd.Series, ties: pd.Series, exact_ok: pd.Series) -> pd.Series:
    rows = zip(n, w, ties, exact_ok, strict=True)
    return pd.Series([signed_rank_p(int(a), b, c, bool(e)) for a, b, c, e in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def rank_sum_p_col(n1: pd.Series, n2: pd.Series, u: pd.Series, ties: pd.Series) -> pd.Series:
    rows = zip(n1, n2, u, ties, strict=True)
    return pd.Series([rank_sum_p(int(a), int(b), c, d) for a, b, c, d in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def binomial_tail_col(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    rows = zip(k, n, p, strict=True)
    return pd.Series([binomial_tail(int(a), int(b), c) for a, b, c in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def correlation_p_col(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_p(r, int(m)) for r, m in zip(rho, n, strict=True)], dtype="float64")
