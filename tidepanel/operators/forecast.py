"""Walk-forward forecasts, expert pools and per-key recursions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import qlike
from . import gram as G
from .features import har
from .frames import attach, by_key, calendar

HAR_TERMS = ["rv_d", "rv_w", "rv_m"]
LOSS_CAP = 10.0  # fixed value: daily losses above it count as this much


def quarter_of(date: str | Column) -> Column:
    return F.trunc(F.col(date) if isinstance(date, str) else date, "quarter")


def folds(spark, start: str, end: str) -> DataFrame:
    """Quarterly test periods between two dates."""
    q = F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr("interval 3 months")))
    d = spark.range(1).select(q.alias("test_start"))
    nxt = F.least(F.add_months("test_start", 3), F.lit(end).cast("date"))
    return d.select(F.col("test_start").alias("train_end"), "test_start", nxt.alias("test_end"))


def fold_log(panel: DataFrame, start: str, least: int = 500) -> DataFrame:
    """Per quarter: training and test rows and the last training date, from one
    aggregate by quarter. Raises if training data reaches the test period."""
    q = panel.groupBy(quarter_of("date").alias("test_start")).agg(
        F.count(F.lit(1)).alias("n_test"), F.min("date").alias("first_test"), F.max("date").alias("_last"))
    w = calendar("test_start").rowsBetween(Window.unboundedPreceding, -1)
    d = q.select("test_start", "n_test", "first_test", F.coalesce(F.sum("n_test").over(w), F.lit(0)).alias("n_train"),
                 F.max("_last").over(w).alias("last_train"))
    d = d.filter((F.col("test_start") >= F.lit(start).cast("date")) & (F.col("n_train") >= least))
    leak = F.col("last_train") >= F.col("first_test")
    return d.withColumn("n_train", F.when(leak, F.raise_error(F.lit("training data reaches the test period")).cast("bigint"))
                        .otherwise(F.col("n_train")))


def design(panel: DataFrame, x: str = "x", max_gap_days: int | None = None) -> DataFrame:
    """HAR terms with the next observation as target; a target further away than
    ``max_gap_days`` is dropped."""
    w = by_key()
    d = har(panel, x).withColumn("y", F.lead(x).over(w)).withColumn("ydate", F.lead("date").over(w))
    if max_gap_days is not None:
        d = d.withColumn("y", F.when(F.datediff("ydate", "date") <= max_gap_days, F.col("y")))
    return d


def walk_forward(d: DataFrame, features: list[str], start: str, least_key: int = 100, least_all: int = 500,
                 lam: float = 0.0, out: str = "har", shared: bool = True) -> DataFrame:
    """Expanding-window fits per (key, quarter) without a loop: sums per quarter,
    running sums over quarters, one small solve each. A row trains the quarters
    that start after its target's date. Keys with few rows use pooled fits; without
    ``shared`` they get no forecast, and all rows from ``start`` on stay."""
    p = len(features)
    t = d.withColumn("q", quarter_of("ydate"))
    g = G.sums(t, ["key", "q"], features, "y")
    test = d.withColumn("q", quarter_of("date")).filter(F.col("date") >= F.lit(start).cast("date"))
    wanted = test.select("key", "q").distinct()
    zero = {c: 0.0 for c in ["n_train", *G.g_columns(p)]}
    filled = wanted.join(g, ["key", "q"], "full").fillna(zero)
    own = G.solve(G.cumulative(filled, ["key"], "q", p), p, lam, out="own").withColumn(
        "own", F.when(F.col("n_train") >= least_key, F.col("own"))).select("key", "q", "own")
    if not shared:
        beta = own.filter(F.col("own").isNotNull()).withColumnRenamed("own", "beta")
        return attach(test, beta, ["key", "q"]).withColumn(out, G.predict(features)).drop("beta", "q")
    pooled = filled.groupBy("q").agg(*[F.sum(c).alias(c) for c in zero]).withColumn("_all", F.lit(0))
    all_ = G.solve(G.cumulative(pooled, ["_all"], "q", p), p, lam, out="shared").withColumn(
        "shared", F.when(F.col("n_train") >= 1, F.col("shared"))).select("q", "shared")
    rows = d.groupBy(quarter_of("date").alias("q")).agg(F.count(F.lit(1)).alias("_c"))
    seen = rows.select("q", F.sum("_c").over(calendar("q").rowsBetween(Window.unboundedPreceding, -1)).alias("_seen"))
    beta = own.join(all_, "q").join(seen, "q").filter(F.col("_seen") >= least_all)
    beta = beta.select("key", "q", F.coalesce("own", "shared").alias("beta"))
    return attach(test, beta, ["key", "q"], "inner").withColumn(out, G.predict(features)).drop("beta", "q")


def hedge_weights(preds: DataFrame, experts: list[str], eta: float = 2.0, y: str = "target") -> DataFrame:
    """Expert weights per date in closed form: the softmax of minus eta times the
    losses of all earlier dates."""
    loss = preds.groupBy("date").agg(*[F.coalesce(F.least(F.avg(qlike(y, e)), F.lit(LOSS_CAP)), F.lit(0.0)).alias(e) for e in experts])
    w = calendar().rowsBetween(Window.unboundedPreceding, -1)
    cum = loss.select("date", *[(-eta * F.coalesce(F.sum(e).over(w), F.lit(0.0))).alias(e) for e in experts])
    top = F.greatest(*experts) if len(experts) > 1 else F.col(experts[0])
    ex = {e: F.exp(F.col(e) - top) for e in experts}
    total = sum(list(ex.values())[1:], list(ex.values())[0])
    return cum.select("date", *[(ex[e] / total).alias("w_" + e) for e in experts])


def hedge(preds: DataFrame, experts: list[str], eta: float = 2.0, y: str = "target", out: str = "pool") -> DataFrame:
    """Weighted mean of the experts; missing experts are left out of a row."""
    d = attach(preds, hedge_weights(preds, experts, eta, y), ["date"])
    num = sum((F.when(F.col(e).isNotNull(), F.col(e) * F.col("w_" + e)).otherwise(0.0) for e in experts), F.lit(0.0))
    den = sum((F.when(F.col(e).isNotNull(), F.col("w_" + e)).otherwise(0.0) for e in experts), F.lit(0.0))
    return d.withColumn(out, F.try_divide(num, den))


def grid_r2(df: DataFrame, y: str, grid: list[float], combine) -> DataFrame:
    """R2 of every candidate weight in one pass over the rows."""
    tot = F.var_pop(y) * F.count(y)

    def sse(w):
        e = F.col(y) - combine(F.lit(float(w)))
        return F.sum(e * e)
    names = {f"w{i}": w for i, w in enumerate(grid)}
    wide = df.agg(*[(1 - F.try_divide(sse(w), tot)).alias(n) for n, w in names.items()])
    rows = F.array(*[F.struct(F.lit(float(w)).alias("w"), F.col(n).alias("r2")) for n, w in names.items()])
    return wide.select(F.explode(rows).alias("s")).select("s.*")


def _per_key(df: DataFrame, fn, value: str, names: list[str]) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema += "".join(f", {n} double" for n in names)

    def run(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        for n, v in zip(names, fn(pdf[value].to_numpy(dtype=float))):
            pdf[n] = v
        return pdf
    return df.groupBy("key").applyInPandas(run, schema)


def ewma(df: DataFrame, r: str, lam: float = 0.94, first: int = 20, out: str = "log_var") -> DataFrame:
    """Exponentially weighted variance, started at the variance of the first
    returns; each row carries the value known before it."""
    def fn(x):
        v = np.empty(len(x))
        v[0] = np.var(x[:first])
        for t in range(1, len(x)):
            v[t] = lam * v[t - 1] + (1 - lam) * x[t - 1] ** 2
        return [np.log(np.maximum(v, 1e-300))]
    return _per_key(df, fn, r, [out])


def garch_fixed(df: DataFrame, r: str, omega: float, alpha: float, beta: float, first: int = 20, out: str = "variance") -> DataFrame:
    def fn(x):
        v = np.empty(len(x))
        v[0] = np.var(x[:first])
        for t in range(1, len(x)):
            v[t] = omega + alpha * x[t - 1] ** 2 + beta * v[t - 1]
        return [v]
    return _per_key(df, fn, r, [out])


def _t_quantile(level: float, nu: float) -> float:
    from ..functions.special import t_ppf
    return t_ppf(level, nu) * math.sqrt((nu - 2) / nu)


def garch_grid(df: DataFrame, r: str, alpha: float = 0.05, min_train: int = 750, refit: int = 252,
               gjr: bool = False, out: str = "var_q") -> DataFrame:
    """Value at risk from a volatility recursion with t errors. The parameters are
    chosen from a grid by likelihood on the expanding window and kept until the
    next refit; the whole grid walks a key once, in lock step."""
    a, b, nu, g = (v.ravel() for v in np.meshgrid([0.02, 0.05, 0.1, 0.15], [0.7, 0.8, 0.85, 0.9, 0.94], [5.0, 8.0, 20.0],
                                                  [0.0, 0.05, 0.1] if gjr else [0.0]))
    ok = a + b + g / 2 < 0.995
    a, b, nu, g = a[ok], b[ok], nu[ok], g[ok]
    const = np.array([math.lgamma((v + 1) / 2) - math.lgamma(v / 2) - 0.5 * math.log(math.pi * (v - 2)) for v in nu])
    tail = np.array([_t_quantile(alpha, v) for v in nu])

    def fn(x):
        n, res = len(x), np.full(len(x), np.nan)
        if n <= min_train:
            return [res]
        scale = np.cumsum(x[:min_train] ** 2)[-1] / min_train
        omega = (1 - a - b - g / 2) * scale
        v, ll, best = np.full(len(a), scale), np.zeros(len(a)), 0
        for t in range(n):
            if t >= min_train:
                if (t - min_train) % refit == 0:
                    best = int(np.argmax(ll))
                res[t] = -math.sqrt(v[best]) * tail[best]
            ll += const - 0.5 * np.log(v) - (nu + 1) / 2 * np.log1p(x[t] ** 2 / (v * (nu - 2)))
            v = omega + (a + g * (x[t] < 0)) * x[t] ** 2 + b * v
        return [res]
    return _per_key(df, fn, r, [out])


def caviar_grid(df: DataFrame, r: str, alpha: float = 0.05, min_train: int = 750, refit: int = 252, out: str = "var_q") -> DataFrame:
    """Quantile recursion on the absolute return; grid parameters by pinball loss
    on the expanding window."""
    c0, b1, b2 = (v.ravel() for v in np.meshgrid([0.0, 0.02, 0.05, 0.1, 0.2], [0.7, 0.8, 0.9, 0.95], [0.05, 0.1, 0.2, 0.3, 0.4]))

    def fn(x):
        n, res = len(x), np.full(len(x), np.nan)
        if n <= min_train:
            return [res]
        q0 = float(np.quantile(-x[:min(300, min_train)], 1 - alpha))
        q, cost, best = np.full(len(b1), q0), np.zeros(len(b1)), 0
        for t in range(n):
            if t >= min_train:
                if (t - min_train) % refit == 0:
                    best = int(np.argmin(cost))
                res[t] = q[best]
            e = -x[t] - q
            if t:
                cost += np.where(e >= 0, (1 - alpha) * e, -alpha * e)
            q = c0 * q0 + b1 * q + b2 * abs(x[t])
        return [res]
    return _per_key(df, fn, r, [out])


def quantile_fit(x: np.ndarray, y: np.ndarray, tau: float, rounds: int = 60) -> np.ndarray:
    """Quantile regression by iteratively reweighted least squares."""
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    for _ in range(rounds):
        e = y - x @ b
        w = np.where(e >= 0, tau, 1 - tau) / np.maximum(np.abs(e), 1e-6)
        nb = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-10 * np.eye(x.shape[1]), x.T @ (w * y))
        if np.abs(nb - b).max() < 1e-9:
            return nb
        b = nb
    return b


def har_quantiles(d: DataFrame, taus: list[float], min_train: int = 750, refit: int = 252) -> DataFrame:
    """Quantile regressions of the target on the HAR terms, refitted per key on an
    expanding window. Rows: key, date, y, the terms."""
    names = [f"q{int(round(t * 1000)):03d}" for t in taus]
    schema = "key string, date date, y double" + "".join(f", {n} double" for n in names)

    def run(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        x = np.column_stack([np.ones(len(pdf)), pdf[HAR_TERMS].to_numpy(dtype=float)])
        y = pdf["y"].to_numpy(dtype=float)
        known = ~np.isnan(x).any(axis=1)
        out = pdf[["key", "date", "y"]].copy()
        for tau, name in zip(taus, names):
            pred = np.full(len(pdf), np.nan)
            for t in range(min_train, len(pdf), refit):
                # the target of row t-1 is only known at t
                tr = known[:t - 1] & ~np.isnan(y[:t - 1])
                if tr.sum() < x.shape[1] + 5:
                    continue
                b = quantile_fit(x[:t - 1][tr], y[:t - 1][tr], tau)
                pred[t:t + refit] = x[t:t + refit] @ b
            out[name] = pred
        return out
    return d.select("key", "date", "y", *HAR_TERMS).groupBy("key").applyInPandas(run, schema)


def best_by(df: DataFrame, value: str, what: str) -> DataFrame:
    return df.agg(F.max_by(what, F.struct(value, what)).alias(what), F.max(value).alias(value))



