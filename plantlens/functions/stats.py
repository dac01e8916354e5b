"""Tail probabilities and the Shapiro-Wilk test, for one-row-per-parameter tables.

Spark has no distribution functions; these run as Arrow-batched pandas UDFs over result rows.  The
normal scores of the Shapiro-Wilk test depend on places only, so they are summed over stretches of places
of bounded length and the test itself is computed from a handful of sums, whatever the number of samples.
"""

from __future__ import annotations

import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

SHAPIRO_MIN_N = 3
# Places whose normal scores one UDF row sums.
SCORES_PER_ROW = 65_536
# Places whose normal scores are computed in one call.
SCORES_PER_STEP = 1 << 18
# Relative accuracy of the continued fraction; it takes about sqrt(degrees of freedom) steps.
FRACTION_ACCURACY = 1e-15


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in itertools.count(1):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            delta = c * d
            h *= delta
        if abs(delta - 1.0) < FRACTION_ACCURACY:
            break
    return h


def regularized_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(log_front) * _beta_fraction(a, b, x) / a
    return 1.0 - math.exp(log_front) * _beta_fraction(b, a, 1.0 - x) / b


def correlation_tail(r: float, n: float) -> float:
    """Two-sided p-value of a correlation r over n pairs (Student t with n - 2 degrees)."""
    if r is None or n is None or math.isnan(r) or math.isnan(n) or n < 3:
        return math.nan
    r2 = min(1.0, r * r)
    if r2 >= 1.0:
        return 0.0
    return regularized_beta((n - 2.0) / 2.0, 0.5, 1.0 - r2)


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution with a whole number of degrees (finite sum)."""
    if x is None or dof is None or math.isnan(x) or math.isnan(dof) or dof < 1:
        return math.nan
    if x <= 0:
        return 1.0
    half, dof = x / 2.0, int(dof)
    if dof % 2 == 0:
        total, log_term = 0.0, -half
        for i in range(dof // 2):
            if i:
                log_term += math.log(half / i)
            total += math.exp(log_term)
        return min(1.0, total)
    total = math.erfc(math.sqrt(half))
    term = math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(dof // 2):
        if i:
            term *= half / (i + 0.5)
        total += term
    return min(1.0, total)


# Royston's 1995 polynomial coefficients, lowest power first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_C3 = (0.544, -0.39978, 0.025054, -6.714e-4)
_C4 = (1.3822, -0.77857, 0.062767, -0.0020322)
_C5 = (-1.5861, -0.31082, -0.083751, 0.0038915)
_C6 = (-0.4803, -0.082676, 0.0030302)
_G = (-2.273, 0.459)


def _poly(coefficients, x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


_NORMAL = NormalDist()


def normal_score(place: int, n: float) -> float:
    """Expected value (Blom) of the ``place``-th smallest of n standard normal samples."""
    return _NORMAL.inv_cdf((place - 0.375) / (n + 0.25))


# Coefficients of Acklam's rational approximation of the normal quantile (relative error below 1.2e-9),
# highest power first, for the middle and for the two tails.
_MIDDLE = (
    (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00),
    (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0),
)
_TAIL = (
    (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00),
    (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0),
)
_TAIL_FROM = 0.02425


def normal_quantiles(p: np.ndarray) -> np.ndarray:
    """Quantiles of the standard normal distribution for probabilities strictly between 0 and 1."""
    centred = p - 0.5
    square = centred * centred
    out = centred * np.polyval(_MIDDLE[0], square) / np.polyval(_MIDDLE[1], square)
    tail = np.flatnonzero((p < _TAIL_FROM) | (p > 1 - _TAIL_FROM))
    low = np.minimum(p[tail], 1 - p[tail])
    root = np.sqrt(-2 * np.log(low))
    out[tail] = -np.sign(centred[tail]) * np.polyval(_TAIL[0], root) / np.polyval(_TAIL[1], root)
    return out


def shapiro_from_sums(n: int, cross: float, square: float, spread: float, ends: tuple[float, float, float, float]) -> tuple[float, float]:
    """Shapiro-Wilk W and p-value (Royston 1995) of n >= 3 samples from sums over all places.

    ``cross`` is the sum of normal score times sample, ``square`` of squared scores, ``spread`` of squared deviations
    of the samples; ``ends`` are the smallest, second, last but one and largest sample.
    """
    if n < SHAPIRO_MIN_N or not spread > 1e-300:
        return math.nan, math.nan
    x1, x2, y2, y1 = ends
    if n == 3:
        w = min(1.0, 0.5 * (y1 - x1) ** 2 / spread)
        return w, min(1.0, max(0.0, 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    m1, m2, u = normal_score(n, n), normal_score(n - 1, n), 1.0 / math.sqrt(n)
    last = _poly(_C1, u) + m1 / math.sqrt(square)
    inner, rest, kept = cross - m1 * (y1 - x1), square - 2 * m1**2, 1 - 2 * last**2
    total = last * (y1 - x1)
    if n > 5:
        second = _poly(_C2, u) + m2 / math.sqrt(square)
        inner, rest, kept = inner - m2 * (y2 - x2), rest - 2 * m2**2, kept - 2 * second**2
        total += second * (y2 - x2)
    total += inner / math.sqrt(rest / kept)
    w = min(1.0, total**2 / spread)
    if w >= 1.0:
        return w, 1.0
    y, log_n = math.log(1.0 - w), math.log(n)
    if n <= 11:
        gamma = _poly(_G, n)
        if y >= gamma:
            return w, 1e-99
        y, mean, sd = -math.log(gamma - y), _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        mean, sd = _poly(_C5, log_n), math.exp(_poly(_C6, log_n))
    return w, 0.5 * math.erfc((y - mean) / sd / math.sqrt(2.0))


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and p-value of samples held in memory."""
    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if n < SHAPIRO_MIN_N:
        return math.nan, math.nan
    m = normal_quantiles((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    centred = x - x.mean()
    return shapiro_from_sums(n, float(m @ centred), float(m @ m), float(centred @ centred), (centred[0], centred[1], centred[-2], centred[-1]))


@F.pandas_udf(StructType([StructField("total", DoubleType()), StructField("square", DoubleType())]))
def normal_score_sums(first: pd.Series, length: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of the normal scores, and of their squares, of the places first .. first + length - 1."""
    first, length, n = (c.to_numpy(np.int64) for c in (first, length, n))
    total, square = np.zeros(len(first)), np.zeros(len(first))
    ends = np.cumsum(length)
    at = 0
    while at < len(first):  # rows of about so many places together
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - length[at] + SCORES_PER_STEP, "right")))
        some = length[at:to]
        starts = np.cumsum(some) - some
        place = np.arange(some.sum()) + np.repeat(first[at:to] - starts, some)
        m = normal_quantiles((place - 0.375) / (np.repeat(n[at:to], some) + 0.25))
        total[at:to], square[at:to] = np.add.reduceat(m, starts), np.add.reduceat(m * m, starts)
        at = to
    return pd.DataFrame({"total": total, "square": square})


@F.pandas_udf(DoubleType())
def shapiro_p(n: pd.Series, cross: pd.Series, square: pd.Series, spread: pd.Series, x1: pd.Series, x2: pd.Series, y2: pd.Series, y1: pd.Series) -> pd.Series:
    rows = zip(n, cross, square, spread, x1, x2, y2, y1, strict=True)
    return pd.Series([shapiro_from_sums(int(r[0]), r[1], r[2], r[3], r[4:])[1] for r in rows], dtype=float)


@F.pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([correlation_tail(float(a), float(b)) for a, b in zip(r, n)], dtype=float)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float(a), float(b)) for a, b in zip(x, dof)], dtype=float)


def nan_to_null(column):
    return F.when(~F.isnan(column), column)
