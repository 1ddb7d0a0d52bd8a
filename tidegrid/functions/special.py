"""Tail probabilities for t, F and chi-square. Spark has no such functions;
they run on the few rows a test leaves behind."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the incomplete beta continued fraction."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0.0 or x >= 1.0:
        return min(max(x, 0.0), 1.0)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def gamma_upper(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    front = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1.0:
        term = total = 1.0 / s
        n = s
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * front
    b = x + 1.0 - s
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * h


def t_tail(t: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    return 1.0 if f <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_tail(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def _mapped(fn, *series: pd.Series) -> pd.Series:
    return pd.Series([
        None if any(pd.isna(v) for v in row) or min(row[1:]) <= 0 else fn(*row) for row in zip(*series)
    ], dtype="float64")


@F.pandas_udf(DoubleType())
def _t(t: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(t_tail, t, df)


@F.pandas_udf(DoubleType())
def _f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _mapped(f_tail, f, d1, d2)


@F.pandas_udf(DoubleType())
def _chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return _mapped(chi2_tail, x, df)


def p_two_sided_t(t: Column, df: Column) -> Column:
    return _t(t.cast("double"), df.cast("double"))


def p_upper_f(f: Column, d1: Column, d2: Column) -> Column:
    return _f(f.cast("double"), d1.cast("double"), d2.cast("double"))


def p_upper_chi2(x: Column, df: Column) -> Column:
    return _chi2(x.cast("double"), df.cast("double"))
