"""Skew-safe primitives against pandas on data with hot groups and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.functions import special as sp
from tidepanel.operators import frames as fr
from tidepanel.operators import joins as J
from tidepanel.operators import ranks, sets
from tidepanel.operators import gram as G


@pytest.fixture(params=[10 ** 6, 40], ids=["one piece", "ranges"])
def route(request, monkeypatch):
    """Few and many pieces."""
    monkeypatch.setattr(ranks, "PIECE_ROWS", request.param)


@pytest.fixture(scope="module")
def skewed(spark):
    g = np.random.default_rng(0)
    key = np.where(g.random(6000) < 0.5, "hot", g.integers(0, 30, 6000).astype(str))
    pdf = pd.DataFrame({"key": key, "i": np.arange(6000), "x": np.round(g.normal(size=6000), 2)})
    pdf.loc[::50, "x"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double"))).repartition(5)


def test_quantiles_match(skewed, route):
    pdf, d = skewed
    q = ranks.quantiles(d, ["key"], "x", [0.05, 0.5, 0.9], ["a", "b", "c"]).toPandas().set_index("key").sort_index()
    want = pdf.groupby("key")["x"].quantile([0.05, 0.5, 0.9]).unstack().sort_index()
    assert np.allclose(q[["a", "b", "c"]], want)


def test_ranks_match_with_ties(skewed, route):
    pdf, d = skewed
    r = ranks.with_rank(d, ["key"], "x").filter(F.col("x").isNotNull()).toPandas().set_index("i").sort_index()
    want = pdf.dropna().assign(r=lambda p: p.groupby("key")["x"].rank()).set_index("i").sort_index()
    assert np.allclose(r["rank"], want["r"])
    assert len(ranks.with_rank(d, ["key"], "x").collect()) == len(pdf)


def test_string_values_rank_in_pieces(spark, route):
    words = [f"k{(i * 7919) % 211:04d}" for i in range(900)]
    d = spark.createDataFrame([("hot" if i % 3 else f"g{i % 5}", w) for i, w in enumerate(words)], "key string, x string")
    got = {(r.key, r.x): (r.n_lt, r.n_eq, r.n) for r in ranks.value_counts(d, ["key"], "x").collect()}
    pdf = d.toPandas()
    for key, g in pdf.groupby("key"):
        for x in g["x"].unique():
            assert got[key, x] == ((g["x"] < x).sum(), (g["x"] == x).sum(), len(g))
    halves = sets.alternating_halves(d.select(F.col("x").alias("key")), "key").orderBy("key").collect()
    assert [r.half for r in halves] == [i % 2 for i in range(len(halves))] and len(halves) == 211


@pytest.mark.parametrize("span", [1, 3, 5, 20, 60])
def test_ema_keeps_the_whole_past(spark, span):
    from tidepanel.operators import windows as W
    g = np.random.default_rng(span)
    n = 1500
    pdf = pd.DataFrame({"key": "a", "date": pd.date_range("2000-01-01", periods=n).date, "x": g.normal(size=n)})
    pdf.loc[0, "x"] = 1e6
    pdf.loc[[5, 700], "x"] = np.nan
    d = spark.createDataFrame(pdf).withColumn("x", F.nanvl("x", F.lit(None).cast("double")))
    got = W.ema(d, "x", span).orderBy("date").toPandas()["ema"]
    want = pdf["x"].ewm(span=span, adjust=True, ignore_na=True).mean()
    assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_global_quantiles_and_ks(skewed, route):
    from tidepanel.operators import evaluate as EV
    pdf, d = skewed
    q = ranks.quantiles(d, [], "x", [0.3, 0.98], ["a", "b"]).first()
    assert np.allclose([q["a"], q["b"]], pdf["x"].quantile([0.3, 0.98]))
    k = EV.ks_shift(d, "x", F.col("key") == "hot").first()
    v = pdf.dropna()
    grid = np.sort(v["x"].unique())
    a, b = v[v["key"] == "hot"]["x"], v[v["key"] != "hot"]["x"]
    ks = max(abs((a <= z).mean() - (b <= z).mean()) for z in grid)
    assert k["ks"] == pytest.approx(ks) and k["mean_shift"] == pytest.approx((b.mean() - a.mean()) / a.std())


def test_salted_join_equals_broadcast_join(skewed, spark):
    pdf, d = skewed
    facts = d.groupBy("key").agg(F.avg("x").alias("m"))
    a = fr.attach(d, facts, ["key"], most=0).orderBy("i").toPandas()
    b = fr.attach(d, facts, ["key"]).orderBy("i").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns])
    assert len(a) == len(pdf)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_is_not_broadcast(skewed, spark, how):
    """More facts than are broadcast are small files, of which Spark would broadcast all repeats."""
    d = skewed[1]
    got = fr.attach(d, d.groupBy("key").agg(F.avg("x").alias("m")), ["key"], how, most=0)
    assert got.count() == len(got.collect()) == len(skewed[0])
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("include", [False, True])
def test_scan_over_pieces(skewed, include):
    pdf, d = skewed
    got = fr.scan_last(d.withColumn("p", F.floor(F.col("i") / 300)), ["key"], "p", ["i"], F.col("x"), "v", include)
    got = got.orderBy("i").toPandas()
    want = pdf.groupby("key")["x"].ffill() if include else pdf.groupby("key")["x"].transform(lambda s: s.ffill().shift())
    assert np.allclose(got["v"], want, equal_nan=True) and len(got) == len(pdf)
    nxt = fr.scan_next(d.withColumn("p", F.floor(F.col("i") / 300)), ["key"], "p", ["i"], F.col("x"), "v").orderBy("i").toPandas()
    assert np.allclose(nxt["v"], pdf.groupby("key")["x"].transform(lambda s: s.bfill().shift(-1)), equal_nan=True)


def test_asof_and_next_event(spark):
    g = np.random.default_rng(1)
    day = lambda n: pd.to_datetime("2020-01-01") + pd.to_timedelta(g.integers(0, 700, n), "D")
    left = pd.DataFrame({"key": g.choice(["a", "b"], 300), "date": day(300)}).drop_duplicates()
    right = pd.DataFrame({"key": g.choice(["a", "b"], 60), "date": day(60)}).drop_duplicates(["key", "date"]).assign(v=lambda p: np.arange(len(p)) * 1.0)
    dl = spark.createDataFrame(left).withColumn("date", F.to_date("date"))
    dr = spark.createDataFrame(right).withColumn("date", F.to_date("date"))
    got = J.asof(dl, dr, "v", "v").toPandas().assign(date=lambda p: pd.to_datetime(p["date"])).sort_values(["key", "date"])
    want = pd.merge_asof(left.sort_values("date"), right.sort_values("date"), on="date", by="key").sort_values(["key", "date"])
    assert np.allclose(got["v"], want["v"], equal_nan=True)
    nx = J.next_event(dl, dr).toPandas().assign(date=lambda p: pd.to_datetime(p["date"])).sort_values(["key", "date"])
    ev = right.rename(columns={"date": "e"}).sort_values("e")[["key", "e"]]
    want = pd.merge_asof(left.sort_values("date"), ev.assign(date=ev["e"]), on="date", by="key", direction="forward", allow_exact_matches=False).sort_values(["key", "date"])
    assert (pd.to_datetime(nx["next_event"]).fillna(pd.Timestamp(0)).values == want["e"].fillna(pd.Timestamp(0)).values).all()


def test_unique_assertion_raises(spark):
    with pytest.raises(Exception, match="duplicate keys"):
        sets.assert_unique(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int"), ["a", "b"]).collect()


def test_gram_solutions(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(400, 3)) + 10
    y = x @ [0.5, -1.0, 2.0] + 3 + g.normal(size=400) * 0.1
    d = spark.createDataFrame(pd.DataFrame({"k": g.choice(["u", "v"], 400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
    s = G.sums(d, ["k"], ["a", "b", "c"], "y")
    res = G.r2_from_sums(G.solve(s, 3), 3).toPandas().set_index("k")
    pdf = d.toPandas()
    for k, p in pdf.groupby("k"):
        m = np.column_stack([np.ones(len(p)), p[["a", "b", "c"]]])
        b = np.linalg.lstsq(m, p["y"], rcond=None)[0]
        assert np.allclose(res.loc[k, "beta"], b, atol=1e-6)
        r = 1 - ((p["y"] - m @ b) ** 2).sum() / ((p["y"] - p["y"].mean()) ** 2).sum()
        assert res.loc[k, "r2"] == pytest.approx(r, abs=1e-8)
    lasso = G.solve(G.sums(d, [], ["a", "b", "c"], "y"), 3, 100.0, lasso=True).first()["beta"]
    assert np.allclose(lasso[1:], 0)


def test_distribution_functions():
    assert sp.norm_cdf(1.959963985) == pytest.approx(0.975, abs=1e-9)
    assert sp.norm_ppf(0.9) == pytest.approx(1.2815515655, abs=1e-9)
    assert sp.chi2_sf(3.841458821, 1) == pytest.approx(0.05, abs=1e-9)
    assert sp.chi2_sf(5.991464547, 2) == pytest.approx(0.05, abs=1e-9)
    assert sp.t_ppf(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert sp.f_sf(4.102821015, 2, 10) == pytest.approx(0.05, abs=1e-8)
    # far tails: exp(-x / 2) for two degrees of freedom, 1 / (1 + t^2 / 2) forms for t
    assert sp.chi2_sf(200.0, 2) == pytest.approx(np.exp(-100.0), rel=1e-12)
    assert sp.t_two_sided(1e9, 2) == pytest.approx(1e-18, rel=1e-6)
    assert sp.chi2_sf(-1.0, 3) == 1.0


def test_elastic_net_from_sums(spark):
    """Against coordinate descent on the raw standardized rows."""
    g = np.random.default_rng(3)
    n = 600
    x = g.normal(size=(n, 3)) * [1, 2, 5] + 4
    y = x @ [1.0, 0.0, 0.2] + g.normal(size=n) * 0.5
    dates = pd.date_range("2020-01-01", periods=n).date
    pdf = pd.DataFrame({"key": "a", "date": dates, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y})
    d = spark.createDataFrame(pdf)
    out = G.elastic_net(d, d, ["a", "b", "c"], "y", "date", l1=(0.5,), alphas=(0.05,)).orderBy("date").toPandas()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    b, yc = np.zeros(3), y - y.mean()
    for _ in range(2000):
        for j in range(3):
            r = z[:, j] @ (yc - z @ b + z[:, j] * b[j]) / n
            b[j] = np.sign(r) * max(abs(r) - 0.05 * 0.5, 0) / (1 + 0.05 * 0.5)
    assert np.allclose(out["enet"], np.clip(y.mean() + z @ b, y.min(), y.max()), atol=1e-6)
