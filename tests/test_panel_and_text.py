"""Realized measures, text cleaning, calendar rules, causality of features."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import text as tx
from tidepanel.operators import forecast as FC
from tidepanel.operators import panel as P
from tidepanel.operators import regimes as R
from tidepanel.operators import windows as W
from tidepanel.operators.frames import by_key


def ticks(spark, sigma=0.02, seed=7, jump=0.0, n=23400):
    g = np.random.default_rng(seed)
    r = g.normal(0, sigma / np.sqrt(n), n)
    r[n // 2] += jump
    ts = pd.date_range("2024-06-03 09:30:00", periods=n, freq="s")
    return pd.DataFrame({"key": "a", "ts": ts, "event_id": np.arange(n), "price": np.exp(np.log(100) + np.cumsum(r))})


def measures(spark, pdf, clean=False, offsets=(0,)):
    d = spark.createDataFrame(pdf)
    d = P.clean_ticks(d) if clean else d
    return P.realized_measures(d, 300, offsets).first()


def test_realized_variance_and_jumps(spark):
    m = measures(spark, ticks(spark))
    assert m["rv"] == pytest.approx(0.02 ** 2, rel=0.5) and m["n_returns"] >= 70
    assert m["bpv"] == pytest.approx(m["rv"], rel=0.35)
    a, b = measures(spark, ticks(spark, 0.01, 3)), measures(spark, ticks(spark, 0.01, 3, jump=0.03))
    assert b["rv"] > 5 * a["rv"] and b["bpv"] - a["bpv"] < 0.3 * (b["rv"] - a["rv"])


def test_cleaning_and_empty_input(spark):
    pdf = ticks(spark, 0.02, 5)
    dirty = pdf.copy()
    dirty.loc[8995:9005, "price"] *= 1.2
    dirty.loc[6000, "price"] = 0.0
    early = pd.DataFrame({"key": ["a"], "ts": [pd.Timestamp("2024-06-03 08:00:00")], "event_id": [-1], "price": [99.0]})
    cleaned = P.clean_ticks(spark.createDataFrame(pd.concat([dirty, early])))
    assert cleaned.count() <= len(pdf) - 12
    true, good = measures(spark, pdf), measures(spark, dirty, clean=True)
    bad = measures(spark, dirty[dirty["price"] > 0])
    assert bad["rv"] > 5 * true["rv"] and abs(good["rv"] - true["rv"]) < 0.05 * abs(bad["rv"] - true["rv"])
    lone = measures(spark, pdf.head(1))
    assert lone["rv"] is None
    none = spark.createDataFrame(pdf.head(1)).filter("price < 0")
    assert P.realized_measures(P.clean_ticks(none)).count() == 0


def test_text_cleaning_and_scores(spark):
    rows = [("<p>Profit  rose</p> see https://a.b/c now. The Motley Fool has positions in X.\nMore.",), ("Fraud and bankruptcy after a lawsuit",),
            ("A CRASH, a halt, a plunge",), (None,)]
    d = spark.createDataFrame(rows, "t string").select(tx.clean("t").alias("c"), tx.shock("t").alias("s")).collect()
    assert d[0]["c"] == "Profit rose see now." and d[0]["s"] == 0
    assert d[1]["s"] == 5 and d[2]["s"] == 5 and d[3]["s"] == 0 and d[3]["c"] == ""


def test_effective_date(spark):
    rows = [("2024-07-05 19:59:00", "2024-07-05"), ("2024-07-05 20:00:00", "2024-07-08"), ("2024-07-06 12:00:00", "2024-07-06"),
            ("2024-07-06 22:00:00", "2024-07-08"), ("2024-01-04 21:30:00", "2024-01-05")]
    d = spark.createDataFrame(rows, "ts string, want string").select(F.to_timestamp("ts").alias("ts"), "want")
    for r in d.select(tx.effective_date("ts").cast("string").alias("got"), "want").collect():
        assert r["got"] == r["want"]


def panel(spark, seed=0, keys=3, n=1500, change=None):
    g = np.random.default_rng(seed)
    out = []
    for k in range(keys):
        x = list(g.normal(-9, 0.5, 30))
        for _ in range(n - 30):
            h = x[-22:]
            x.append(-0.8 + 0.35 * h[-1] + 0.3 * np.mean(h[-5:]) + 0.25 * np.mean(h) + g.normal(0, 0.3))
        out.append(pd.DataFrame({"key": f"k{k}", "date": pd.bdate_range("2015-01-01", periods=n).date, "x": x}))
    pdf = pd.concat(out)
    if change is not None:
        pdf.loc[pdf["date"] >= change, "x"] += 100
    return spark.createDataFrame(pdf)


def test_har_recovers_coefficients_and_is_causal(spark):
    import datetime
    from tidepanel.operators import gram as G
    p = panel(spark)
    b = G.solve(G.sums(FC.design(p), [], FC.HAR_TERMS, "y"), 3).first()["beta"]
    assert np.allclose(b[1:], [0.35, 0.3, 0.25], atol=0.06)
    cut = datetime.date(2019, 1, 1)
    f = lambda d: FC.walk_forward(FC.design(d), FC.HAR_TERMS, "2017-01-01").filter(F.col("date") < F.lit(cut)).select("key", "date", "har").orderBy("key", "date").toPandas()
    a, b = f(p), f(panel(spark, change=cut))
    assert len(a) > 1000 and np.allclose(a["har"], b["har"], equal_nan=True)


def test_pooled_fallback_for_short_keys(spark):
    p = panel(spark, keys=2, n=900)
    short = p.filter((F.col("key") == "k1") | (F.col("date") >= F.lit("2017-10-01").cast("date")))
    f = FC.walk_forward(FC.design(short), FC.HAR_TERMS, "2018-01-01", least_all=100)
    assert f.filter((F.col("key") == "k0") & F.col("rv_m").isNotNull() & F.col("har").isNull()).count() == 0


def test_gap_option_drops_far_targets(spark):
    d = spark.createDataFrame([("a", "2020-01-01", 1.0), ("a", "2020-01-02", 2.0), ("a", "2021-01-02", 3.0)], "key string, date string, x double").withColumn("date", F.to_date("date"))
    y = [r["y"] for r in FC.design(d, max_gap_days=10).orderBy("date").collect()]
    assert y == [2.0, None, None]


def test_trailing_rank(spark):
    d = spark.createDataFrame(pd.DataFrame({"key": "a", "date": pd.date_range("2020-01-01", periods=200).date, "x": np.arange(200.0)}))
    got = d.withColumn("p", P.trailing_rank(by_key(), "x", 50, 20)).orderBy("date").toPandas()["p"]
    assert got[:19].isna().all() and (got[19:] == 1.0).all()


def test_dispersion_enters_one_day_late(spark):
    d = spark.createDataFrame([("a", "2020-01-01", 1.0), ("b", "2020-01-01", 3.0), ("a", "2020-01-02", 2.0), ("b", "2020-01-02", 2.0)],
                              "key string, date string, x double").withColumn("date", F.to_date("date"))
    m = P.cross_section(d).orderBy("date").collect()
    assert m[0]["dispersion"] is None and m[1]["dispersion"] == pytest.approx(np.std([1, 3], ddof=1))


def test_first_robust_scale_is_at_row_99(spark):
    d = spark.createDataFrame(pd.DataFrame({"key": "a", "date": pd.date_range("2020-01-01", periods=150).date, "r": np.random.default_rng(1).normal(size=150)}))
    s = W.mad_scale(d, "r").orderBy("date").toPandas()["sigma_hat"]
    assert s[:99].isna().all() and s[99:].notna().all()


def test_hedge_finds_the_good_expert(spark):
    g = np.random.default_rng(2)
    y = g.normal(-9, 1, 400)
    d = spark.createDataFrame(pd.DataFrame({"key": "a", "date": pd.date_range("2020-01-01", periods=400).date, "target": y, "good": y + g.normal(0, 0.1, 400), "bad": y + g.normal(1.5, 0.8, 400)}))
    w = FC.hedge_weights(d, ["good", "bad"]).orderBy("date").toPandas()
    assert w["w_good"][0] == 0.5 and w["w_good"].iloc[-1] > 0.95
    h = FC.hedge(d.withColumn("bad", F.lit(None).cast("double")), ["good", "bad"]).toPandas()
    assert np.allclose(h["pool"], h["good"])


def test_hmm_separates_states_and_is_causal(spark):
    g = np.random.default_rng(3)
    n, s = 700, np.zeros(700, dtype=int)
    for t in range(1, n):
        s[t] = s[t - 1] ^ (g.random() < (0.03 if s[t - 1] else 0.01))
    x = s + g.normal(0, 0.2, n)
    mk = lambda v: spark.createDataFrame(pd.DataFrame({"key": "m", "date": pd.date_range("2020-01-01", periods=n).date, "f": v}))
    run = lambda v: np.stack(R.hmm_online(mk(v), ["f"], 2, 63, 250).orderBy("date").toPandas()["pi"])
    p = run(x)
    assert ((p[250:, 1] > 0.5) == (s[250:] == 1)).mean() > 0.9 and np.allclose(p[:250], 0.5)
    y = x.copy()
    y[500:] += 3
    assert np.allclose(run(y)[:500], p[:500])
    q = np.stack(R.hmm_smoothed(mk(x), ["f"], 2).orderBy("date").toPandas()["pi"])
    assert ((q[:, 1] > 0.5) == (s == 1)).mean() > 0.9


def test_grid_models_breach_near_nominal(spark):
    g = np.random.default_rng(4)
    v, r = 1.0, []
    for _ in range(2000):
        r.append(np.sqrt(v) * g.standard_t(6) * np.sqrt(4 / 6))
        v = 0.02 + 0.08 * r[-1] ** 2 + 0.9 * v
    d = spark.createDataFrame(pd.DataFrame({"key": "a", "date": pd.date_range("2010-01-01", periods=2000).date, "r": r}))
    for fn in (FC.garch_grid, FC.caviar_grid):
        out = fn(d, "r", 0.05, 500, 252).filter(~F.isnan("var_q")).toPandas()
        assert abs((-out["r"] > out["var_q"]).mean() - 0.05) < 0.025


def test_quantile_regression_on_ar1():
    g = np.random.default_rng(5)
    y = np.zeros(2500)
    for t in range(1, 2500):
        y[t] = 0.9 * y[t - 1] + g.normal(0, 0.5)
    x = np.column_stack([np.ones(2499), y[:-1]])
    for tau in (0.05, 0.5, 0.95):
        b = FC.quantile_fit(x, y[1:], tau)
        assert abs((y[1:] <= x @ b).mean() - tau) < 0.01 and abs(b[1] - 0.9) < 0.05
