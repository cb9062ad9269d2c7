"""Scalar column expressions shared by all operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 6) -> Column:
    """Rounded double; adding zero turns a negative zero into zero."""
    return F.round(col(c).cast("double"), digits) + F.lit(0.0)


def finite(c: str | Column) -> Column:
    """NaN and both infinities become NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None)).otherwise(c)


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(c: str | Column, lo, hi) -> Column:
    """Clip that keeps NULL (greatest/least alone would return the bound)."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def qlike(y, p) -> Column:
    e = col(y) - col(p)
    return F.exp(e) - e - 1


def pinball(e, tau: float) -> Column:
    e = col(e)
    return F.when(e >= 0, tau * e).otherwise((tau - 1.0) * e)


def interval_score(y, lo, hi, alpha: float) -> Column:
    y, lo, hi = col(y), col(lo), col(hi)
    zero = F.lit(0.0)
    return ((hi - lo) + (2.0 / alpha) * F.greatest(lo - y, zero)
            + (2.0 / alpha) * F.greatest(y - hi, zero))


def cut(x, edges: list[float], labels: list[str]) -> Column:
    """Right-closed bins, the lowest edge included; outside is NULL."""
    x = col(x)
    out = None
    for i, label in enumerate(labels):
        low = x >= edges[0] if i == 0 else x > edges[i]
        cond = low & (x <= edges[i + 1])
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out


def bin_left(x, cuts: list[float]) -> Column:
    """Left-closed bins: how many cuts are at or below x."""
    x = col(x)
    return reduce(lambda a, b: a + b, [(x >= c).cast("int") for c in cuts])


def one_hot(k: Column, size: int) -> Column:
    """Membership array; a NULL bin gives the uniform membership."""
    hot = F.array(*[(k == i).cast("double") for i in range(size)])
    return F.when(k.isNull(), uniform(size)).otherwise(hot)


def uniform(size: int) -> Column:
    return F.array(*[F.lit(1.0 / size)] * size)


def normalized(pi: Column, size: int) -> Column:
    """Membership with NULL or incomplete vectors replaced by the uniform one,
    scaled to sum to one."""
    bad = pi.isNull() | F.exists(pi, lambda v: v.isNull() | F.isnan(v))
    p = F.when(bad, uniform(size)).otherwise(pi)
    total = F.aggregate(p, F.lit(0.0), lambda a, v: a + v)
    return F.transform(p, lambda v: v / total)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)


def cosine(a, b) -> Column:
    """Cosine similarity; NULL when either vector is missing, 0 when one is zero."""
    a = F.transform(col(a), lambda v: v.cast("double"))
    b = F.transform(col(b), lambda v: v.cast("double"))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.try_divide(dot(a, b), norm), F.when(norm == 0, 0.0))


def softmax(logw: Column) -> Column:
    top = F.array_max(logw)
    e = F.transform(logw, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def draw(seed: str | int, *parts) -> Column:
    """Reproducible draw in [0, 2^32): the first eight hex digits of an md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def draw_unit(seed, *parts) -> Column:
    return (draw(seed, *parts).cast("double") + 0.5) / F.lit(4294967296.0)


def corr(a, b) -> Column:
    """Pearson correlation over complete pairs, NULL for a constant series."""
    ok = col(a).isNotNull() & col(b).isNotNull()
    u, v = F.when(ok, col(a).cast("double")), F.when(ok, col(b).cast("double"))
    return F.try_divide(F.covar_pop(u, v), F.stddev_pop(u) * F.stddev_pop(v))
