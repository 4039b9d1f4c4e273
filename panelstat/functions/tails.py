"""Tail probabilities as Arrow functions; applied to result-sized tables only."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(r: float, n: float) -> float | None:
    """Two-sided p of a correlation r over n pairs."""
    if r is None or math.isnan(r) or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / ((1 - r) * (1 + r))
    return beta_inc(df / 2, 0.5, df / (df + t2))


def _each(fn, *cols):
    return pd.Series([None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return _each(t_two_sided, r, n)


def _erfc(x: np.ndarray) -> np.ndarray:
    """erfc of non-negative numbers: a series of positive terms, and a continued fraction where that would cancel."""
    out = np.full(len(x), np.nan)
    small = x < 2
    v = x[small]
    term, total = v.copy(), v.copy()
    for k in range(1, 60):
        term = term * 2 * v * v / (2 * k + 1)
        total = total + term
    out[small] = 1 - 2 / math.sqrt(math.pi) * np.exp(-v * v) * total
    v = np.minimum(x[x >= 2], 40.0)
    tail = np.zeros(len(v))
    for k in range(80, 0, -1):
        tail = k / 2 / (v + tail)
    out[x >= 2] = np.exp(-v * v) / math.sqrt(math.pi) / (v + tail)
    return out


def chi2_3_sf(x) -> np.ndarray:
    v = np.atleast_1d(np.asarray(x, float))
    return _erfc(np.sqrt(v / 2)) + np.sqrt(2 * v / math.pi) * np.exp(-v / 2)


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided normal p."""
    return pd.Series(_erfc(np.abs(z.to_numpy(float)) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def chi2_3_p(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with three degrees of freedom."""
    return pd.Series(chi2_3_sf(x.to_numpy(float)))


# sizes up to which null distributions are counted: the smaller of two samples, and the items of a ranking
EXACT_SAMPLE, EXACT_ITEMS = 8, 33
# values of U that are counted at most
EXACT_VALUES = 2_000_000


@lru_cache(maxsize=64)
def _rank_sum_counts(n1: int, n2: int) -> tuple[int, ...]:
    """How many of the C(n1 + n2, n1) samples have U = 0, 1, ... n1 * n2: the Gaussian binomial's coefficients.

    It is the product over i of (1 - q^(n2 + i)) / (1 - q^i), whole numbers throughout; only the lower half is made.
    """
    few, many = sorted((n1, n2))
    counts = [1] + [0] * (few * many // 2)
    for i in range(1, few + 1):
        for u in range(len(counts) - 1, many + i - 1, -1):
            counts[u] -= counts[u - many - i]
        for u in range(i, len(counts)):
            counts[u] += counts[u - i]
    return tuple(counts)


def rank_sum_p(u: float, n1: float, n2: float, ties: float, z: float) -> float | None:
    """Two-sided p of U: exact without ties if a sample has at most EXACT_SAMPLE values, else normal from z.

    It is normal as well if U could take over EXACT_VALUES values. An empty sample has no p.
    """
    n1, n2 = int(n1), int(n2)
    if not n1 or not n2:
        return None
    if ties or min(n1, n2) > EXACT_SAMPLE or n1 * n2 > EXACT_VALUES:
        return None if math.isnan(z) else float(_erfc(np.array([abs(z) / math.sqrt(2)]))[0])
    low = int(min(u, n1 * n2 - u))
    return min(1.0, 2 * sum(_rank_sum_counts(n1, n2)[: low + 1]) / math.comb(n1 + n2, n1))


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    rows = zip(u, n1, n2, ties, z.fillna(float("nan")))
    return pd.Series([None if pd.isna(r[0]) else rank_sum_p(*r) for r in rows], dtype="float64")


@lru_cache(maxsize=64)
def _inversion_counts(n: int) -> tuple[int, ...]:
    """How many of the n! orders have 0, 1, ... inversions."""
    counts = [1]
    for i in range(2, n + 1):
        wide = [0] * (len(counts) + i - 1)
        for k in range(i):
            for j, c in enumerate(counts):
                wide[j + k] += c
        counts = wide
    return tuple(counts)


def rank_correlation_p(n: float, discordant: float, s: float, tx: float, ty: float, x0: float, y0: float, x1: float, y1: float) -> float | None:
    """Two-sided p of Kendall's S = concordant - discordant.

    tx, x0 and x1 sum t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5) over the groups of t equal x, the others those of y. Exact
    without ties up to EXACT_ITEMS items, else normal with the tie-corrected variance. A constant side has no p.
    """
    pairs = n * (n - 1) / 2
    if n < 2 or tx == pairs or ty == pairs:
        return None
    if not tx and not ty and n <= EXACT_ITEMS:
        few = int(min(discordant, pairs - discordant))
        return min(1.0, 2 * sum(_inversion_counts(int(n))[: few + 1]) / math.factorial(int(n)))
    var = (2 * pairs * (2 * n + 5) - x1 - y1) / 18 + 2 * tx * ty / (2 * pairs)
    var += x0 * y0 / (9 * 2 * pairs * (n - 2)) if n > 2 else 0.0
    return float(_erfc(np.array([abs(s) / math.sqrt(2 * var)]))[0])


@F.pandas_udf(DoubleType())
def kendall_p(
    n: pd.Series, discordant: pd.Series, s: pd.Series, tx: pd.Series, ty: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series
) -> pd.Series:
    return _each(rank_correlation_p, n, discordant, s, tx, ty, x0, y0, x1, y1)
