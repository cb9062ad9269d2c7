"""Boosting on cells against boosting on rows, and the walk-forward protocol."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import boosting as B
from tidepanel.operators import forecast as FC


def tree_on_rows(x, r, allowed, b):
    """One tree by plain recursion over rows. x: bins."""
    value = np.zeros(len(r))

    def score(v):
        return max(abs(v.sum()) - b.l1, 0) ** 2 / (len(v) + b.l2)

    def down(rows, depth):
        best = (1e-12, None, None)
        if depth < b.depth:
            for f in allowed:
                for cut in range(x[:, f].max()):
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if len(left) >= b.least and len(right) >= b.least:
                        gain = score(r[left]) + score(r[right]) - score(r[rows])
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, f, cut)
        if best[1] is None:
            s = r[rows].sum()
            value[rows] = np.sign(s) * max(abs(s) - b.l1, 0) / (len(rows) + b.l2)
        else:
            down(rows[x[rows, best[1]] <= best[2]], depth + 1)
            down(rows[x[rows, best[1]] > best[2]], depth + 1)
    down(np.arange(len(r)), 0)
    return value


@pytest.mark.parametrize("columns", [1.0, 0.5])
def test_cells_equal_rows(columns):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, (400, 3))
    y = np.sin(x[:, 0]) + (x[:, 1] > 3) * x[:, 2] + rng.normal(0, 0.2, 400)
    b = B.Boost(trees=12, rate=0.2, depth=3, least=10, columns=columns)
    value = np.full(400, y.mean())
    used = int(np.ceil(columns * 3))
    for t in range(b.trees):
        allowed = sorted(np.random.Generator(np.random.Philox(key=b.seed, counter=[0, 0, 0, t])).permutation(3)[:used])
        value = value + b.rate * tree_on_rows(x, y - value, allowed, b)
    cells, at = np.unique(x, axis=0, return_inverse=True)
    got = B.fit_cells(cells, np.bincount(at).astype(float), np.bincount(at, y), np.array([6, 6, 6]), b)
    assert np.allclose(got[at], value)


def test_labels(spark):
    """Probabilities of balanced labels on a table; empty, one-sided and clashing cases."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 0.5, 3000) > 1.2).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"i": range(3000), "a": x[:, 0], "b": x[:, 1], "y": y, "n": 7}))
    boost = B.Boost(120, 0.1, 3, 20, labels=True)
    out = B.split_trees(df.filter("i < 2000"), df.filter("i >= 2000"), ["a", "b"], "y", boost, "p")
    assert out.columns == ["i", "a", "b", "y", "n", "p"]
    got = out.toPandas()
    high = got["p"] > 0.5
    recall, noise = high[got["y"] == 1].mean(), high[got["y"] == 0].mean()
    assert len(got) == 1000 and recall > 0.8 and noise < 0.2
    one = B.split_trees(df.filter("y = 1"), df.filter("i < 5"), ["a", "b"], "y", boost, "p").toPandas()
    assert (one["p"] == 1).all() and B.split_trees(df, df.limit(0), ["a", "b"], "y", boost).count() == 0


def har_panel(days=1500, keys=3, seed=8):
    rng = np.random.default_rng(seed)
    parts = []
    for k in range(keys):
        x = np.full(days, -9.0)
        for t in range(22, days):
            x[t] = -1.35 + 0.35 * x[t - 1] + 0.3 * x[t - 5:t].mean() + 0.2 * x[t - 22:t].mean() + rng.normal(0, 0.3)
        parts.append(pd.DataFrame({"key": f"k{k}", "date": pd.bdate_range("2014-01-01", periods=days).date, "x": x}))
    return pd.concat(parts, ignore_index=True)


TERMS, START = ["rv_d", "rv_w", "rv_m"], "2019-01-01"


def forecasts(spark, pdf, trees=150, **kw):
    d = FC.design(spark.createDataFrame(pdf))
    return B.walk_forward_trees(d, TERMS, START, B.Boost(trees=trees), **kw).toPandas().sort_values(["key", "date"]).reset_index(drop=True)


def test_walk_forward_learns_and_is_causal(spark):
    pdf = har_panel()
    got = forecasts(spark, pdf)
    ok = got["y"].notna() & got["trees"].notna()
    assert ok.mean() > 0.99 and np.sqrt(((got["y"] - got["trees"])[ok] ** 2).mean()) < 0.36  # the noise has 0.3
    # another future changes no forecast before it, nor any fold that began before
    other = pdf.copy()
    cut = pd.Timestamp("2019-08-15").date()
    other.loc[other["date"] >= cut, "x"] += 5.0
    changed = forecasts(spark, other)
    same = got["date"] < cut
    assert np.allclose(got["trees"][same], changed["trees"][same]) and not np.allclose(got["trees"][~same], changed["trees"][~same])


def test_folds_equal_single_fits(spark):
    """A fold of the walk equals a fit on its past alone; missing features and short pasts give no forecast."""
    pdf = har_panel(days=900, keys=2)
    got = forecasts(spark, pdf, trees=20)
    assert got["trees"].isna().all() or (got["date"] >= pd.Timestamp(START).date()).all()
    pdf2 = har_panel(days=1400, keys=2)
    walk = forecasts(spark, pdf2, trees=20)
    quarter = walk[(walk["date"] >= pd.Timestamp("2019-04-01").date()) & (walk["date"] < pd.Timestamp("2019-05-01").date())]
    d = FC.design(spark.createDataFrame(pdf2))
    rows = B.binned(d.dropna(subset=TERMS), B.bin_edges(d.dropna(subset=[*TERMS, "y"]), TERMS, START, B.bins_of(3))).toPandas()
    names = ["b0", "b1", "b2"]
    past = rows[rows["y"].notna() & (pd.to_datetime(rows["ydate"]) < "2019-04-01")]
    bins = np.r_[past[names].to_numpy(), rows[names].to_numpy()].astype(np.int64)
    n = np.r_[np.ones(len(past)), np.zeros(len(rows))]
    sizes = bins.max(0) + 1
    value = B.fit_cells(bins, n, np.r_[past["y"].to_numpy(), np.zeros(len(rows))], sizes, B.Boost(trees=20))[len(past):]
    want = rows.assign(v=value).set_index(["key", "date"])["v"]
    assert len(quarter) > 30 and np.allclose(quarter["trees"], [want[k, t] for k, t in zip(quarter["key"], quarter["date"])])
    assert forecasts(spark, pdf2, trees=2, least=10**6)["trees"].isna().all()
    assert B.walk_forward_trees(d.limit(0), TERMS, START, B.Boost(trees=2)).count() == 0


def test_hedge_of_har_and_trees(spark):
    """The pool is no worse than the better expert by much, and starts at equal weights."""
    d = FC.design(spark.createDataFrame(har_panel()))
    har = FC.walk_forward(d, TERMS, START).select("key", "date", "har")
    both = B.walk_forward_trees(d, TERMS, START, B.Boost(trees=60)).join(har, ["key", "date"]).filter(F.col("y").isNotNull())
    pool = FC.hedge(both, ["har", "trees"], y="y").toPandas()
    loss = {c: (np.exp(pool["y"] - pool[c]) - (pool["y"] - pool[c]) - 1).mean() for c in ("har", "trees", "pool")}
    assert loss["pool"] < 1.02 * min(loss["har"], loss["trees"])
    first = pool[pool["date"] == pool["date"].min()]
    assert np.allclose(first["pool"], (first["har"] + first["trees"]) / 2)


@pytest.mark.parametrize("labels", [False, True])
def test_grid_of_all_cells_gives_the_same_trees(monkeypatch, labels):
    """Boxes of a grid and lists of cells: the same predictions, also for cells that are only asked for."""
    g = np.random.default_rng(5)
    sizes = np.array([17, 1, 23, 11])
    bins = np.unique(np.stack([g.integers(0, s, 3000) for s in sizes], 1), axis=0)
    n = g.integers(0, 40, len(bins)).astype(float)
    total = g.binomial(n.astype(int), 0.2 + 0.5 * (bins[:, 0] > 8)).astype(float) if labels else n * (bins[:, 2] - 0.3 * bins[:, 0]) + g.normal(size=len(bins)) * n
    boost = B.Boost(trees=30, rate=0.2, depth=5, least=20, labels=labels)
    found = []
    for share in (B.GRID_SHARE, 0):
        monkeypatch.setattr(B, "GRID_SHARE", share)
        found.append(B.fit_cells(bins, n, total, sizes, boost))
    assert np.allclose(*found, rtol=1e-9, atol=1e-9) and len(np.unique(found[0])) > 20
