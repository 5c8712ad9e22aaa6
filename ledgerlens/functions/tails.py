"""Tail probabilities as small pandas UDFs for aggregated rows.

Exact forms where samples are small, with the switch of the usual statistics library: D by
lattice paths while both samples have at most ``EXACT_D`` values, U by counting while the
smaller one has at most ``EXACT_U`` and there are no ties. Beyond that the Kolmogorov limit,
and the normal with tie and continuity correction. Student t by the incomplete beta function.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


EXACT_D, EXACT_U = 10_000, 8
#: Values of U that are counted one by one; beyond them U is as good as a sum of uniforms.
COUNTED_U = 4_000_000


def lattice_tail(d: float, n: int, m: int) -> float:
    """P(D >= d) for samples of n and m values without ties.

    All orders of the values are equally likely. ``inside[i]`` is the probability that the
    first s values, i of them from the first sample, have kept below d so far.
    """
    reach = round(d * n * m)  # |i m - j n| of the statistic, a whole number
    if reach <= 0:
        return 1.0
    inside = np.zeros(n + 1)
    inside[0] = 1.0
    i = np.arange(n + 1)
    for s in range(1, n + m + 1):
        step = inside * (s - i) / s
        step[1:] += inside[:-1] * i[1:] / s
        j = s - i
        inside = np.where((j >= 0) & (j <= m) & (np.abs(i * m - j * n) < reach), step, 0.0)
    return float(min(1.0, max(0.0, 1.0 - inside[n])))


def counted_u_tail(u: float, n: int, m: int) -> float:
    """Two-sided p of U for samples of n and m values without ties."""
    n, m = sorted((n, m))
    high = max(u, n * m - u)
    if n * m > COUNTED_U:
        # Ranks of the smaller sample are as good as independent; the sum of n uniforms.
        x = (high - 0.5 + n * n / 2) / (n + m)
        terms = ((-1) ** k * math.comb(n, k) * (n - x - k) ** n for k in range(n + 1) if k < n - x)
        return min(1.0, 2 * sum(terms) / math.factorial(n))
    # Coefficients of the product of (1 - q^(m + i)) / (1 - q^i), as shares of all orders.
    ways = np.zeros(n * m + 1)
    ways[0] = 1.0
    for i in range(1, n + 1):
        if m + i <= n * m:
            ways[m + i :] = ways[m + i :] - ways[: -(m + i)]
        for first in range(i):  # divided by 1 - q^i: sums in steps of i
            ways[first::i] = np.cumsum(ways[first::i])
        ways *= i / (m + i)
    return float(min(1.0, 2 * ways[math.ceil(high) :].sum()))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def kolmogorov_tail(x: float) -> float:
    """P(K > x); the theta-function form converges fast for small x."""
    if x <= 0:
        return 1.0
    if x < 1.18:
        base = -(math.pi**2) / (8 * x * x)
        total = sum(math.exp((2 * k - 1) ** 2 * base) for k in range(1, 8))
        return max(0.0, 1.0 - math.sqrt(2 * math.pi) / x * total)
    terms = ((-1) ** (k - 1) * math.exp(-2.0 * k * k * x * x) for k in range(1, 12))
    return min(1.0, max(0.0, 2.0 * sum(terms)))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised I_x(a, b) by its continued fraction."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 + term * d
            c = 1.0 + term / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value / a


def student_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def _each(function, *columns: pd.Series) -> pd.Series:
    out = [
        None if any(pd.isna(v) for v in row) else float(function(*row))
        for row in zip(*columns, strict=True)
    ]
    return pd.Series(out, dtype="float64")


@F.pandas_udf(DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return _each(normal_two_sided, z)


@F.pandas_udf(DoubleType())
def kolmogorov_p(x: pd.Series) -> pd.Series:
    return _each(kolmogorov_tail, x)


@F.pandas_udf(DoubleType())
def d_p(d: pd.Series, n1: pd.Series, n0: pd.Series) -> pd.Series:
    """p of the two-sample D, exact for small samples."""

    def tail(d: float, n: float, m: float) -> float:
        if max(n, m) <= EXACT_D:
            return lattice_tail(d, int(n), int(m))
        return kolmogorov_tail(math.sqrt(n * m / (n + m)) * d)

    return _each(tail, d, n1, n0)


@F.pandas_udf(DoubleType())
def u_p(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
    """p of U, exact for small samples without ties; ``z`` is its normal score."""

    def tail(u: float, n: float, m: float, ties: float, z: float) -> float:
        if min(n, m) <= EXACT_U and ties == 0:
            return counted_u_tail(u, int(n), int(m))
        return normal_two_sided(z)

    return _each(tail, u, n1, n0, ties, z)


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(student_two_sided, t, df)
