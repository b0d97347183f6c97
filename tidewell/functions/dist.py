"""Distribution functions for p-values, applied to rows that are aggregated already."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x >= (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 1000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * f


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def chi2_upper(x: float, df: float) -> float:
    return upper_gamma(df / 2, x / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov_upper(x: float) -> float:
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def normal_inverse(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def _column(f, *args: Column) -> Column:
    """Apply a scalar function to aggregated rows; null in, null out."""

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None or v != v for v in row) else f(*row) for row in zip(*series)], dtype="float64")

    return run(*(a.cast("double") for a in args))


def p_t(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_upper, f, d1, d2)


def p_chi2(x: Column, df: Column) -> Column:
    return _column(chi2_upper, x, df)


def p_normal(z: Column) -> Column:
    return _column(normal_two_sided, z)


def p_kolmogorov(x: Column) -> Column:
    return _column(kolmogorov_upper, x)


def z_of(p: Column) -> Column:
    """Inverse normal distribution."""
    return _column(normal_inverse, p)
