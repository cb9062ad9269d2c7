"""Pooled walks on digests against brute force on the raw rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import pooled as PO

DAYS = 15


def rows(spark, seed=0, dates=60, keys=40, hot=0):
    """``hot`` extra entities sit on one date, which then holds most rows."""
    g = np.random.default_rng(seed)
    out = []
    for i, d in enumerate(pd.date_range("2021-01-01", periods=dates).date):
        n = keys + (hot if i == dates // 2 else 0)
        out += [(f"k{j:05d}", d, float(v), 1.0) for j, v in enumerate(g.standard_t(4, n) * (1 + (i % 10 > 7)))]
    pdf = pd.DataFrame(out, columns=["key", "date", "s_std", "sigma_hat"])
    member = pd.DataFrame({"date": pdf["date"].unique()})
    pi = [np.array([1.0 - (i % 10 > 7), float(i % 10 > 7)]) * 0.9 + 0.05 for i in range(dates)]
    m = spark.createDataFrame(member.assign(pi=[list(p) for p in pi]))
    return spark.createDataFrame(pdf), m, pdf, pi


def brute_fixed(pdf, pi, etas, a, average=False):
    days = [g["s_std"].to_numpy() for _, g in pdf.groupby("date", sort=True)]
    warm = np.concatenate(days[:DAYS + 1])
    out, q = [], {1: np.full(2, np.quantile(warm, 1 - a)), -1: np.full(2, np.quantile(-warm, 1 - a))}
    for t, s in enumerate(days):
        issued = {k: float(pi[t] @ q[k]) for k in q}
        out.append((issued[-1], issued[1]))
        if t > DAYS:
            for k in q:
                q[k] = q[k] + np.asarray(etas) * pi[t] * (((k * s) > issued[k]).sum() - a * len(s)) / (len(s) if average else 1)
    return np.array(out)


def brute_adaptive(pdf, pi, rates, a, meta=5.0, mix=0.01, corr=0.002):
    days = [g["s_std"].to_numpy() for _, g in pdf.groupby("date", sort=True)]
    warm, rates = np.concatenate(days[:DAYS + 1]), np.asarray(rates)
    res = {}
    for k in (1, -1):
        bank = np.full((2, len(rates)), np.quantile(k * warm, 1 - a))
        lw, c, out = np.zeros_like(bank), np.zeros(2), []
        for t, s in enumerate(days):
            s = k * s
            w = np.exp(lw) / np.exp(lw).sum(axis=1, keepdims=True)
            issued = float(pi[t] @ ((w * bank).sum(axis=1) + c))
            out.append(issued)
            if t > DAYS:
                diff = s[:, None, None] - bank
                loss = np.where(diff > 0, (1 - a) * diff, -a * diff).mean(axis=0)
                bank = bank + rates * pi[t][:, None] * ((diff > 0).sum(axis=0) - a * len(s))
                lw = lw - meta * pi[t][:, None] * loss
                w = np.exp(lw) / np.exp(lw).sum(axis=1, keepdims=True)
                gate = mix * pi[t][:, None]
                lw = np.log((1 - gate) * w + gate / len(rates))
                c = c + corr * pi[t] * ((s > issued).sum() - a * len(s))
        res[k] = np.array(out)
    return np.column_stack([res[-1], res[1]])


def path_of(out):
    p = out.groupBy("date").agg(F.first("q_lo").alias("lo"), F.first("q_hi").alias("hi")).orderBy("date").toPandas()
    return p[["lo", "hi"]].to_numpy()


@pytest.mark.parametrize("hot", [0, 3000])
def test_fixed_walk_is_exact_with_coarse_cells(spark, monkeypatch, hot):
    """Two root cells and splits by three force many rounds; a hot date must not
    change the result."""
    monkeypatch.setattr(PO, "SPLIT", 3 if not hot else 64)
    d, m, pdf, pi = rows(spark, hot=hot)
    out, _ = PO.run_pooled(d, m, 2, {"f": PO.FixedWalk(0.1, (0.01, 0.03))}, 0.1, DAYS, root=lambda s: (s > 0).cast("int"))
    assert np.allclose(path_of(out), brute_fixed(pdf, pi, (0.01, 0.03), 0.05), atol=1e-9)
    assert out.count() == len(pdf)


def test_adaptive_walk_is_exact_with_coarse_cells(spark, monkeypatch):
    monkeypatch.setattr(PO, "SPLIT", 16)
    d, m, pdf, pi = rows(spark, seed=1)
    rates = (0.001, 0.01, 0.05)
    out, _ = PO.run_pooled(d, m, 2, {"a": PO.AdaptiveWalk(0.1, rates)}, 0.1, DAYS, root=lambda s: F.floor(s / 2).cast("int"))
    assert np.allclose(path_of(out), brute_adaptive(pdf, pi, rates, 0.05), atol=1e-8)


@pytest.mark.parametrize("block", [1 << 21, 1000])
def test_long_steps_on_a_wide_cross_section(spark, monkeypatch, block):
    """Steps far longer than the spread of the scores: one miscounted score moves all later thresholds,
    so rounds on cells settle few dates each. In one block, or several and a date above one."""
    monkeypatch.setattr(PO, "SPLIT", 3)
    if hasattr(PO, "BLOCK"):
        monkeypatch.setattr(PO, "BLOCK", block)
    d, m, pdf, pi = rows(spark, seed=3, dates=100, keys=400, hot=1000)
    root = lambda s: (s > 0).cast("int")
    out, _ = PO.run_pooled(d, m, 2, {"f": PO.FixedWalk(0.1, (0.03, 0.05))}, 0.1, DAYS, root=root)
    assert np.allclose(path_of(out), brute_fixed(pdf, pi, (0.03, 0.05), 0.05), atol=1e-8)
    if block > 1000:
        rates = (0.002, 0.03)
        out, _ = PO.run_pooled(d, m, 2, {"a": PO.AdaptiveWalk(0.1, rates)}, 0.1, DAYS, root=root)
        assert np.allclose(path_of(out), brute_adaptive(pdf, pi, rates, 0.05), atol=1e-6)


def test_reductions(spark):
    """One rate without corrector on hard regimes is the fixed walk; averaged
    errors with a rate times n are the summed ones."""
    d, _, pdf, _ = rows(spark, seed=2)
    hard = spark.createDataFrame(pd.DataFrame({"date": sorted(pdf["date"].unique())}).assign(
        pi=lambda x: [[1.0, 0.0] if i % 3 else [0.0, 1.0] for i in range(len(x))]))
    walks = {"fixed": PO.FixedWalk(0.1, 0.004), "one": PO.AdaptiveWalk(0.1, (0.004,), eta_corr=0.0),
             "avg": PO.FixedWalk(0.1, 0.004 * 40, average=True)}
    _, path = PO.run_pooled(d, hard, 2, walks, 0.1, DAYS)
    w = path.groupBy("date").pivot("arm", list(walks)).agg(F.first("q_hi")).toPandas()
    assert np.allclose(w["fixed"], w["one"], atol=1e-10) and np.allclose(w["fixed"], w["avg"], atol=1e-10)


def test_cross_sectional_order_statistic(spark):
    d, _, pdf, _ = rows(spark, seed=3, hot=500)
    out, _ = PO.run_xs(d, 0.1, DAYS, root=lambda s: (s > 0).cast("int"))
    got = path_of(out)
    days = [g["s_std"].to_numpy() for _, g in pdf.groupby("date", sort=True)]
    lvl, want = {1: 0.05, -1: 0.05}, []
    for t, s in enumerate(days):
        q = {}
        for k in (1, -1):
            if t:
                cal = np.sort(k * np.concatenate(days[max(0, t - 5):t]))
                q[k] = cal[min(len(cal) - 1, int(np.ceil((len(cal) + 1) * (1 - lvl[k]))) - 1)]
                if t > DAYS:
                    lvl[k] = np.clip(lvl[k] + 0.005 * (0.05 - ((k * s) > q[k]).mean()), 1e-4, 0.499)
            else:
                q[k] = np.inf
        want.append((q[-1], q[1]))
    assert np.allclose(got, np.array(want))


def test_nearest_days_quantile_and_causality(spark):
    d, _, pdf, _ = rows(spark, seed=4)
    dates = sorted(pdf["date"].unique())
    x = np.random.default_rng(5).normal(size=(len(dates), 2))
    market = spark.createDataFrame(pd.DataFrame({"date": dates, "u": x[:, 0], "v": x[:, 1]}))
    out = PO.run_knn(d, market, ["u", "v"], 0.1, 7, DAYS, root=lambda s: (s > 0).cast("int"))
    got = path_of(out.filter(~F.col("warmup")))
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    days = [g["s_std"].to_numpy() for _, g in pdf.groupby("date", sort=True)]
    want = []
    for t in range(DAYS + 1, len(dates)):
        near = np.argsort(np.linalg.norm(z[:t] - z[t], axis=1))[:7]
        pool = np.concatenate([days[j] for j in near])
        want.append((np.quantile(-pool, 0.95), np.quantile(pool, 0.95)))
    assert np.allclose(got, np.array(want))


def test_extreme_one_sided_level(spark):
    d, _, pdf, _ = rows(spark, seed=6, dates=120, keys=100)
    out, _ = PO.run_pooled(d, None, 1, {"a": PO.AdaptiveWalk(0.01, one_sided=True)}, 0.01, 30, one_sided=True)
    miss = out.filter(~F.col("warmup")).agg(F.avg((~F.col("covered")).cast("double"))).first()[0]
    assert abs(miss - 0.01) < 0.006
    assert out.filter(F.col("q_lo").isNotNull()).count() == 0


def test_bound_on_the_excess(spark):
    """Issued misses minus the level, weighted by a regime, stay inside
    (2B + eta * n) / eta."""
    d, m, pdf, pi = rows(spark, seed=7)
    eta = 0.01
    got = brute_fixed(pdf, pi, (eta, eta), 0.05)
    days = [g["s_std"].to_numpy() for _, g in pdf.groupby("date", sort=True)]
    for k in range(2):
        excess = sum(pi[t][k] * ((s > got[t, 1]).sum() - 0.05 * len(s)) for t, s in enumerate(days) if t > DAYS)
        assert abs(excess) <= (2 * np.abs(pdf["s_std"]).max() + eta * 40) / eta
