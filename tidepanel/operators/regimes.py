"""Market regimes as membership vectors, one row per date (or per key and date)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bin_left, one_hot
from .frames import by_key, calendar
from .windows import run_length

FLOOR = 1e-300  # fixed value: smallest likelihood
FRESH_DAYS = 5
REBUILD = 500  # fixed value: rows used to rebuild the filtered state at a refit


def fixed_bins(market: DataFrame, x: str, cuts: list[float], out: str = "pi") -> DataFrame:
    """One-hot by left-closed bins of a percentile; unknown values are uniform."""
    return market.withColumn(out, one_hot(F.when(F.col(x).isNotNull(), bin_left(x, cuts)), len(cuts) + 1))


def transition(market: DataFrame, x: str, cuts: list[float], fresh: int = FRESH_DAYS, out: str = "pi") -> DataFrame:
    """The top bin split into its first days after entry and the rest."""
    k = len(cuts)
    d = market.withColumn("_top", F.coalesce(F.col(x) >= cuts[-1], F.lit(False))).withColumn("_one", F.lit(0))
    d = run_length(d, "_top", "_run", ["_one"])
    b = F.when(F.col("_top") & (F.col("_run") > fresh), F.lit(k + 1)).otherwise(bin_left(x, cuts))
    return d.withColumn(out, one_hot(F.when(F.col(x).isNotNull(), b), k + 2)).drop("_top", "_run", "_one")


def acute(market: DataFrame, x: str, cuts: list[float], ratio: str, baseline: bool = False, out: str = "pi") -> DataFrame:
    """One more group that overrides when the short-to-long ratio exceeds one;
    the baseline puts those days into the top bin instead."""
    k = len(cuts)
    hot = F.coalesce(F.col(ratio) > 1, F.lit(False))
    b = F.when(hot, F.lit(k if baseline else k + 1)).otherwise(bin_left(x, cuts))
    return market.withColumn(out, one_hot(F.when(F.col(x).isNotNull(), b), k + 2))


def quantile_bins(market: DataFrame, x: str, n: int, window: int = 750, least: int = 30, out: str = "pi") -> DataFrame:
    """One-hot by the trailing quantiles of the value itself, today included; the
    window holds ``window + 1`` rows."""
    w = calendar().rowsBetween(-window, 0)
    edges = [i / n for i in range(1, n)]
    d = market.withColumn("_e", F.percentile(x, F.array(*[F.lit(e) for e in edges])).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
    k = F.size(F.filter("_e", lambda e: e <= F.col(x)))
    return d.withColumn(out, one_hot(F.when((F.col("_n") >= least) & F.col(x).isNotNull(), k), n)).drop("_e", "_n")


def overlapping(x: str, cuts: list[float]):
    """[marginal, bins...]: the first group always holds."""
    k = bin_left(x, cuts)
    bins = [F.coalesce((k == i).cast("double"), F.lit(0.0)) for i in range(len(cuts) + 1)]
    return F.array(F.lit(1.0), *bins)


# --- hidden Markov filter ---------------------------------------------------------

def likelihood(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    z = (x[:, None, :] - mean) ** 2 / var
    return np.maximum(np.exp(-0.5 * (z.sum(axis=2) + np.log(2 * np.pi * var).sum(axis=1))), FLOOR)


def filtered(like: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    out, p = np.empty_like(like), start
    for t, l in enumerate(like):
        p = (p @ trans) * l
        total = p.sum()
        p = p / total if total > 0 else np.full(len(p), 1.0 / len(p))
        out[t] = p
    return out


def smoothed(like: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Scaled forward and backward passes; posteriors, pair sums, log-likelihood."""
    n, k = like.shape
    f, scale = np.empty((n, k)), np.empty(n)
    p = start * like[0]
    for t in range(n):
        if t:
            p = (f[t - 1] @ trans) * like[t]
        scale[t] = p.sum()
        f[t] = p / scale[t]
    b, pair = np.ones(k), np.zeros((k, k))
    post = np.empty((n, k))
    post[-1] = f[-1]
    for t in range(n - 2, -1, -1):
        nxt = like[t + 1] * b / scale[t + 1]
        pair += f[t][:, None] * trans * nxt
        b = trans @ nxt
        post[t] = f[t] * b
    return post, pair, np.log(scale).sum()


def fit_hmm(x: np.ndarray, k: int, rounds: int = 100):
    """Diagonal Gaussian states by expectation maximization from a quantile
    start; states ordered by the mean of the first feature."""
    group = np.minimum(np.argsort(np.argsort(x[:, 0])) * k // len(x), k - 1)
    mean = np.array([x[group == j].mean(axis=0) for j in range(k)])
    var = np.array([x[group == j].var(axis=0) + 1e-3 for j in range(k)])
    trans, start, last = np.full((k, k), 0.1 / max(k - 1, 1)), np.full(k, 1.0 / k), -np.inf
    np.fill_diagonal(trans, 0.9)
    for _ in range(rounds):
        post, pair, ll = smoothed(likelihood(x, mean, var), trans, start)
        w = post.sum(axis=0)[:, None] + 1e-12
        mean = post.T @ x / w
        var = np.maximum((post[:, :, None] * (x[:, None, :] - mean) ** 2).sum(axis=0) / w, 1e-3)
        start, trans = post[0] / post[0].sum(), (pair + 1e-12) / (pair + 1e-12).sum(axis=1, keepdims=True)
        if ll - last < 1e-2:
            break
        last = ll
    o = np.argsort(mean[:, 0])
    return mean[o], var[o], trans[np.ix_(o, o)], start[o]


def hmm_filter(df: DataFrame, x: str, mean: list[float], sd: list[float], trans: list[list[float]], out: str = "pi") -> DataFrame:
    """Filtered probabilities per key under given parameters."""
    m, v, a = np.array(mean)[:, None], np.array(sd)[:, None] ** 2, np.array(trans)
    schema = f"key string, date date, {x} double, {out} array<double>"

    def run(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        p = filtered(likelihood(pdf[[x]].to_numpy(dtype=float), m, v), a, np.full(len(m), 1.0 / len(m)))
        return pdf.assign(**{out: list(p)})
    return df.select("key", "date", F.col(x).cast("double").alias(x)).groupBy("key").applyInPandas(run, schema)


def hmm_online(df: DataFrame, features: list[str], k: int = 3, refit: int = 63, min_train: int = 750) -> DataFrame:
    """Refit on the expanding window every ``refit`` dates, frozen filter between.
    Every (key, refit) block rebuilds its state from history, so blocks run in
    parallel. Missing features take the mean of the past. Rows: key, date, features;
    a key holds one row per date."""
    d = df.withColumn("_pos", F.row_number().over(by_key()) - 1)
    last = d.groupBy("key").agg(F.max("_pos").alias("_last"))
    blocks = last.withColumn("block", F.explode(F.expr(f"sequence(0, cast(greatest(0, floor((_last - {min_train}) / {refit})) as int))")))
    need = d.join(blocks, "key").filter(F.col("_pos") < F.col("block") * refit + min_train + refit)
    schema = "key string, date date, pi array<double>"

    def run(pdf):
        pdf = pdf.sort_values("_pos").reset_index(drop=True)
        block = int(pdf["block"].iloc[0])
        t0 = min_train + block * refit
        x = pdf[features].to_numpy(dtype=float)
        ok = ~np.isnan(x).any(axis=1)
        past = x[:t0][ok[:t0]]
        flat = np.full(k, 1.0 / k)
        p = np.tile(flat, (len(x), 1))
        if len(x) > t0 and len(past) >= min_train // 2:
            mean, var, trans, _ = fit_hmm(past, k)
            state = filtered(likelihood(past[-REBUILD:], mean, var), trans, flat)[-1]
            rows = np.where(ok[t0:, None], x[t0:], past.mean(axis=0))
            p[t0:] = filtered(likelihood(rows, mean, var), trans, state)
        keep = slice(0, None) if block == 0 else slice(t0, None)
        return pd.DataFrame({"key": pdf["key"][keep], "date": pdf["date"][keep], "pi": list(p[keep])})
    return need.groupBy("key", "block").applyInPandas(run, schema)


def hmm_smoothed(df: DataFrame, features: list[str], k: int = 3) -> DataFrame:
    """Full-sample posteriors: hindsight, never an input of a forecast."""
    def run(pdf):
        pdf = pdf.sort_values("date").reset_index(drop=True)
        x = pdf[features].to_numpy(dtype=float)
        ok = ~np.isnan(x).any(axis=1)
        p = np.full((len(x), k), 1.0 / k)
        if ok.sum() > 10 * k:
            mean, var, trans, start = fit_hmm(x[ok], k)
            p[ok] = smoothed(likelihood(x[ok], mean, var), trans, start)[0]
        return pd.DataFrame({"key": pdf["key"], "date": pdf["date"], "pi": list(p)})
    return df.select("key", "date", *features).groupBy("key").applyInPandas(run, "key string, date date, pi array<double>")


def membership_distance(a: DataFrame, b: DataFrame, size: int, flag: DataFrame) -> DataFrame:
    """Mean absolute difference of two memberships, overall and on flagged days."""
    d = a.select("date", F.col("pi").alias("pa")).join(b.select("date", F.col("pi").alias("pb")), "date").join(flag, "date")
    gap = F.aggregate(F.zip_with("pa", "pb", lambda u, v: F.abs(u - v)), F.lit(0.0), lambda s, v: s + v) / size
    return d.agg(F.avg(gap).alias("all_days"), F.avg(F.when(F.col("flag"), gap)).alias("flagged_days"))


