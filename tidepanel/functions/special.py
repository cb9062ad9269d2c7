"""Distribution functions for already aggregated rows (a handful per result).

Only the standard library and numpy are used. The helpers are wrapped as
vectorized UDFs, which see test statistics, never raw data.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def norm_ppf(p: float) -> float:
    """Normal quantile by bisection on the distribution function."""
    return _invert(norm_cdf, p, -40.0, 40.0)


def _invert(cdf, p, lo, hi):
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        if cdf(mid) < p:
            lo = mid
        else:
            hi = mid
    return 0.5 * (lo + hi)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            return front * total
    raise ArithmeticError(f"incomplete beta did not converge at a={a}, b={b}, x={x}")


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma: one minus the series below a + 1, the
    continued fraction above, so that small tails keep their digits."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return 1.0 - total * scale
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return scale * h
    raise ArithmeticError(f"incomplete gamma did not converge at a={a}, x={x}")


def chi2_sf(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def t_cdf(x: float, df: float) -> float:
    tail = 0.5 * beta_inc(df / 2.0, 0.5, df / (df + x * x))
    return tail if x < 0 else 1.0 - tail


def t_two_sided(x: float, df: float) -> float:
    return beta_inc(df / 2.0, 0.5, df / (df + x * x))


def t_ppf(p: float, df: float) -> float:
    return _invert(lambda v: t_cdf(v, df), p, -1e4, 1e4)


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_inc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * x))


def _vector(fn):
    def run(*columns: pd.Series) -> pd.Series:
        rows = zip(*[c.to_numpy(dtype=float) for c in columns])
        return pd.Series([np.nan if any(math.isnan(v) for v in r) else fn(*r) for r in rows], dtype=float)
    return run


def p_two_sided(z: Column) -> Column:
    @F.pandas_udf("double")
    def fn(z: pd.Series) -> pd.Series:
        return _vector(lambda v: math.erfc(abs(v) / math.sqrt(2.0)))(z)
    return fn(z.cast("double"))


def p_chi2(x: Column, df: Column | float) -> Column:
    @F.pandas_udf("double")
    def fn(x: pd.Series, df: pd.Series) -> pd.Series:
        return _vector(chi2_sf)(x, df)
    return fn(x.cast("double"), (F.lit(df) if not isinstance(df, Column) else df).cast("double"))


def p_t(t: Column, df: Column) -> Column:
    @F.pandas_udf("double")
    def fn(t: pd.Series, df: pd.Series) -> pd.Series:
        return _vector(lambda v, k: t_two_sided(v, k) if k > 0 else math.nan)(t, df)
    return fn(t.cast("double"), df.cast("double"))


def p_f(x: Column, d1: Column, d2: Column) -> Column:
    @F.pandas_udf("double")
    def fn(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _vector(f_sf)(x, a, b)
    return fn(x.cast("double"), d1.cast("double"), d2.cast("double"))


def normal_score(p: Column) -> Column:
    @F.pandas_udf("double")
    def fn(p: pd.Series) -> pd.Series:
        return _vector(norm_ppf)(p)
    return fn(p.cast("double"))
