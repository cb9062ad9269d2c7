"""Linear models from sums of products.

A fit needs only the sums of products of [1, features, target], a handful of
numbers per group that combine map-side. All groups, folds, penalties and feature
subsets are solved from those rows; the data is scanned once and no fit loops
over the driver.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import attach


def pairs(features: list[str], y: str) -> list[tuple[str | None, str | None]]:
    """Upper triangle of the matrix of [1, features, y]."""
    return list(combinations_with_replacement([None, *features, y], 2))


def _term(a, b) -> Column:
    if a is None:
        return F.lit(1.0) if b is None else F.col(b).cast("double")
    return F.col(a).cast("double") * F.col(b).cast("double")


def sums(df: DataFrame, by: list[str], features: list[str], y: str, weight: Column | None = None) -> DataFrame:
    """One row per group: g0..gm, the sums of products over complete rows."""
    w = F.lit(1.0) if weight is None else weight
    d = df.dropna(subset=[*features, y])
    aggs = [F.sum(_term(a, b) * w).alias(f"g{i}") for i, (a, b) in enumerate(pairs(features, y))]
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n_train"), *aggs)


def products(df: DataFrame, keep: list[str], features: list[str], y: str) -> DataFrame:
    """The products of each complete row, named as their sums are."""
    d = df.dropna(subset=[*features, y])
    return d.select(*keep, *[_term(a, b).alias(f"g{i}") for i, (a, b) in enumerate(pairs(features, y))])


def g_columns(p: int) -> list[str]:
    """Names of the sums for p features."""
    m = p + 2
    return [f"g{i}" for i in range(m * (m + 1) // 2)]


def cumulative(g: DataFrame, by: list[str], order: str, p: int, strict: bool = True) -> DataFrame:
    """Running sums over the groups' order: the expanding window of every fold."""
    end = -1 if strict else 0
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, end)
    return g.select(*by, order, *[F.sum(c).over(w).alias(c) for c in ["n_train", *g_columns(p)]])


def minus(total: DataFrame, part: DataFrame, p: int, fold: str) -> DataFrame:
    """Sums without one group: total minus part, per group."""
    cols = ["n_train", *g_columns(p)]
    t = total.select(F.struct(*cols).alias("s")).scalar()
    d = part.withColumn("_t", t)
    return d.select(fold, *[(F.col(f"_t.{c}") - F.col(c)).alias(c) for c in cols])


def unpack(row: np.ndarray, p: int) -> np.ndarray:
    m = p + 2
    a = np.zeros((m, m))
    a[np.triu_indices(m)] = row
    return a + np.triu(a, 1).T


def solve_one(a: np.ndarray, keep: list[int], lam: float) -> np.ndarray:
    """Coefficients [intercept, kept features] with an unpenalized intercept:
    the sums are centred before the penalty is added."""
    n = a[0, 0]
    mean = a[0, 1:] / n
    c = a[1:, 1:] - n * np.outer(mean, mean)
    s = c[np.ix_(keep, keep)] + lam * np.eye(len(keep))
    b = np.linalg.lstsq(s, c[keep, -1], rcond=None)[0]
    return np.concatenate([[mean[-1] - mean[keep] @ b], b])


def solve(g: DataFrame, p: int, lam: Column | float = 0.0, subset: list[int] | None = None, out: str = "beta",
          lasso: bool = False, l1: Column | float = 1.0) -> DataFrame:
    """Add the coefficient array to every row of sums. ``lasso`` solves the elastic
    net of standardized features with mixing ``l1``."""
    keep = list(range(p)) if subset is None else subset

    @F.pandas_udf("array<double>")
    def fn(g: pd.Series, lam: pd.Series, l1: pd.Series) -> pd.Series:
        res = []
        for row, l, mix in zip(g, lam, l1):
            row = np.asarray(row, dtype=float)
            if np.isnan(row).any() or row[0] <= len(keep):
                res.append(None)
            elif lasso:
                res.append(_lasso(unpack(row, p), keep, l, mix).tolist())
            else:
                res.append(solve_one(unpack(row, p), keep, l).tolist())
        return pd.Series(res)
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    l1 = l1 if isinstance(l1, Column) else F.lit(float(l1))
    packed = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in g_columns(p)])
    return g.withColumn(out, fn(packed, lam.cast("double"), l1.cast("double")))


def _lasso(a: np.ndarray, keep: list[int], lam: float, l1: float = 1.0, rounds: int = 500) -> np.ndarray:
    """Coordinate descent on centred, scaled sums; coefficients in raw units."""
    n = a[0, 0]
    mean = a[0, 1:] / n
    c = (a[1:, 1:] - n * np.outer(mean, mean)) / n
    sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
    r = c[np.ix_(keep, keep)] / np.outer(sd[keep], sd[keep])
    q = c[keep, -1] / sd[keep]
    b = np.zeros(len(keep))
    for _ in range(rounds):
        old = b.copy()
        for j in range(len(keep)):
            z = q[j] - r[j] @ b + r[j, j] * b[j]
            b[j] = np.sign(z) * max(abs(z) - lam * l1, 0.0) / (r[j, j] + lam * (1 - l1))
        if np.abs(b - old).max() < 1e-12:
            break
    b = b / sd[keep]
    return np.concatenate([[mean[-1] - mean[keep] @ b], b])


def predict(features: list[str], beta: str = "beta") -> Column:
    out = F.col(beta)[0]
    for i, f in enumerate(features):
        out = out + F.col(beta)[i + 1] * F.col(f)
    return out


def fit_predict(train: DataFrame, test: DataFrame, by: list[str], features: list[str], y: str, lam: float = 0.0,
                least: int = 1, out: str = "pred", weight: Column | None = None) -> DataFrame:
    """One model per group, applied to the group's test rows."""
    b = solve(sums(train, by, features, y, weight).filter(F.col("n_train") >= least), len(features), lam)
    if by:
        d = attach(test, b.select(*by, "beta"), by)
    else:
        d = test.withColumn("beta", b.select("beta").scalar())
    return d.withColumn(out, predict(features)).drop("beta")


def error_sums(p: int, keep: list[int] | None = None):
    """Sum of squared errors and total sum of squares of a coefficient array on
    a row of sums (train or test): no second scan."""
    keep = list(range(p)) if keep is None else keep

    @F.pandas_udf("sse double, sst double")
    def fn(g: pd.Series, beta: pd.Series) -> pd.DataFrame:
        res = []
        for row, b in zip(g, beta):
            if b is None or row is None:
                res.append((None, None))
                continue
            a = unpack(np.asarray(row, dtype=float), p)
            full = np.zeros(p + 2)
            full[0], full[-1] = -b[0], 1.0
            for j, k in enumerate(keep):
                full[1 + k] = -b[1 + j]
            res.append((float(full @ a @ full), float(a[-1, -1] - a[0, -1] ** 2 / a[0, 0])))
        return pd.DataFrame(res, columns=["sse", "sst"], dtype=float)
    return fn


def packed(p: int, prefix: str = "") -> Column:
    return F.array(*[F.col(prefix + c) for c in g_columns(p)])


def r2_from_sums(g: DataFrame, p: int, keep: list[int] | None = None, beta: str = "beta", out: str = "r2",
                 sums_prefix: str = "") -> DataFrame:
    e = error_sums(p, keep)(packed(p, sums_prefix), F.col(beta))
    d = g.withColumn("_e", e)
    return d.withColumn(out, 1 - F.try_divide(F.col("_e.sse"), F.col("_e.sst"))).drop("_e")


def elastic_net(train: DataFrame, test: DataFrame, features: list[str], y: str, time: str, folds: int = 3,
                l1=(0.1, 0.5, 0.9), alphas=(0.001, 0.01, 0.1), out: str = "enet") -> DataFrame:
    """Elastic net with the penalty chosen by time-ordered folds of the training
    rows, forecasts clipped to the training range. Sums per time part are taken in
    one scan: fold k fits on the parts before k and is judged on part k, for every
    penalty, from those few rows."""
    p, cols = len(features), ["n_train", *g_columns(len(features))]
    span = train.agg(F.struct(F.min(time).alias("a"), F.max(time).alias("b"))).scalar()
    share = F.datediff(time, F.col("_s.a")) / (F.datediff(F.col("_s.b"), F.col("_s.a")) + 1.0)
    part = F.floor(share * (folds + 1)).cast("int")
    g = sums(train.withColumn("_s", span).withColumn("part", part), ["part"], features, y)
    w = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fold = g.select("part", *[F.col(c).alias("t_" + c) for c in cols], *[F.sum(c).over(w).alias(c) for c in cols])
    grid = F.explode(F.array(*[F.struct(F.lit(m).alias("l1"), F.lit(a).alias("alpha")) for m in l1 for a in alphas]))
    tried = fold.filter(F.col("part") > 0).withColumn("p", grid)
    tried = solve(tried, p, F.col("p.alpha"), lasso=True, l1=F.col("p.l1"))
    e = error_sums(p)(packed(p, "t_"), F.col("beta"))
    score = tried.withColumn("_e", e).groupBy("p.l1", "p.alpha").agg(F.avg(F.sqrt(F.col("_e.sse") / F.col("t_n_train"))).alias("rmse"))
    best = score.agg(F.min_by(F.struct("l1", "alpha"), F.struct("rmse", "l1", "alpha"))).scalar()
    total = g.agg(*[F.sum(c).alias(c) for c in cols]).withColumn("p", best)
    beta = solve(total, p, F.col("p.alpha"), lasso=True, l1=F.col("p.l1")).select("beta").scalar()
    lim = train.agg(F.struct(F.min(y).alias("lo"), F.max(y).alias("hi"))).scalar()
    d = test.withColumn("beta", beta).withColumn("_l", lim).withColumn(out, predict(features))
    return d.withColumn(out, F.when(F.col(out).isNotNull(), F.least(F.greatest(out, F.col("_l.lo")), F.col("_l.hi")))).drop("beta", "_l")
