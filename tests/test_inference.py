"""Back-tests, model confidence sets, text models."""

from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import inference as IN
from tidepanel.operators import textmodels as TM


def exceed(spark, e):
    return spark.createDataFrame(pd.DataFrame({"key": "a", "date": pd.date_range("2000-01-01", periods=len(e)).date, "e": e.astype(bool)}))


def test_size_and_power(spark):
    g = np.random.default_rng(0)
    ok = IN.backtests(exceed(spark, g.random(2000) < 0.05), ["key"], 0.05).first()
    assert ok["kupiec_p"] > 0.01 and ok["cc_p"] > 0.01 and ok["dq_p"] > 0.01
    high = IN.backtests(exceed(spark, g.random(2000) < 0.10), ["key"], 0.05).first()
    assert high["kupiec_p"] < 1e-4 and high["dq_p"] < 1e-4
    c = np.zeros(3000, dtype=bool)
    for t in range(1, 3000):
        c[t] = g.random() < (0.6 if c[t - 1] else 0.03)
    assert IN.backtests(exceed(spark, c), ["key"], 0.05).first()["independence_p"] < 1e-4


def test_confidence_set_drops_the_bad_one_and_repeats(spark):
    g = np.random.default_rng(1)
    t = pd.date_range("2000-01-01", periods=600).date
    base = g.normal(size=600)
    pdf = pd.concat([pd.DataFrame({"method": m, "date": t, "loss": base + g.normal(0, 0.1, 600) + s}) for m, s in (("good_a", 0), ("good_b", 0), ("bad", 0.3))])
    d = spark.createDataFrame(pdf)
    a = IN.confidence_set(d, "loss", 0.1, 200, 20).toPandas().set_index("method")
    assert not a.loc["bad", "in_mcs"] and a.loc["good_a", "in_mcs"] and a.loc["good_b", "in_mcs"]
    b = IN.confidence_set(d.repartition(7), "loss", 0.1, 200, 20).toPandas().set_index("method")
    assert np.allclose(a["mcs_p"], b.loc[a.index, "mcs_p"])


def test_hac_against_numpy(spark):
    v = np.random.default_rng(2).normal(size=300).cumsum() * 0.1
    d = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("2000-01-01", periods=300).date, "v": v}))
    lag = int(np.floor(4 * 3 ** (2 / 9)))
    x = v - v.mean()
    var = x @ x / 300 + sum(2 * (1 - k / (lag + 1)) * (x[k:] @ x[:-k]) / 300 for k in range(1, lag + 1))
    h = IN.hac_mean(d, []).first()
    assert h["se"] == pytest.approx(np.sqrt(var / 300), abs=1e-12) and h["lag"] == lag


def test_poisson_weights_have_mean_and_variance_one(spark):
    from tidepanel.functions.columns import draw_unit
    w = spark.range(20000).select(IN.poisson_one(draw_unit("t", "id")).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.06


def test_tfidf_rows_have_unit_length_and_svd_orders(spark):
    texts = ["market crash fear spreads", "crash fear in market", "profit growth strong", "strong profit growth again", "market profit", "fear growth"] * 5
    d = spark.createDataFrame(pd.DataFrame({"doc_id": range(30), "text": texts}))
    v = TM.tfidf(d, "text", 200)
    norms = [np.linalg.norm(r["tfidf"].toArray()) for r in v.collect()]
    assert np.allclose(norms, 1)
    m = np.stack([r["tfidf"].toArray() for r in v.orderBy("doc_id").collect()])
    s = np.stack([r["svd"] for r in TM.truncated_svd(v, "tfidf", 3, "svd").orderBy("doc_id").collect()])
    assert np.allclose(np.linalg.norm(s, axis=0), np.linalg.svd(m, compute_uv=False)[:3], rtol=1e-3)


def test_vocabulary_of_words_and_pairs(spark):
    """The terms of a count over all words and pairs; a NULL text has none."""
    g = np.random.default_rng(5)
    texts = [" ".join(g.choice(["ax", "bx", "cx", "dx", "ex", "fx", "gx"], 12, p=[.3, .2, .15, .13, .1, .07, .05])) for _ in range(40)] + [None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = [(t or "").split() for t in texts]
    terms = [w + [f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    n, docs = Counter(t for x in terms for t in x), Counter(t for x in terms for t in set(x))
    for features in (5, 12, 1000):
        want = sorted((t for t in n if 2 <= docs[t] <= 0.95 * len(texts)), key=lambda t: (-n[t], t))[:features]
        got = TM.vocabulary(spark.createDataFrame([(w,) for w in words], "w array<string>"), features, 2.0, 0.95)
        kept = [-n[t] for t in want]
        assert [-n[t] for t in got[0]] == kept and got[1] == [docs[t] for t in got[0]] and got[2] == len(texts)
        assert set(got[0]) >= {t for t in want if n[t] > -kept[-1]}
    rows = TM.tfidf(d, "text").orderBy("doc_id").collect()
    assert len(rows) == 41 and rows[-1]["tfidf"].numNonzeros() == 0
    s = TM.truncated_svd(TM.tfidf(d, "text"), "tfidf", 2, "svd")
    assert s.count() == 41 and s.filter("text IS NULL").first()["svd"] == [0.0, 0.0]


def test_pca_ignores_later_rows(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(80, 4)) * [3, 2, 1, 0.5]
    mk = lambda a: spark.createDataFrame(pd.DataFrame({"i": range(80), "v": [list(r) for r in a]}))
    run = lambda a: np.stack([r["p"] for r in TM.pca_past(mk(a), "v", F.col("i") < 50, 2, "p").orderBy("i").collect()])
    y = x.copy()
    y[50:] *= 40
    assert np.allclose(run(x)[:50], run(y)[:50])
    c = x[:50] - x[:50].mean(axis=0)
    u = np.linalg.svd(c, full_matrices=False)[2][:2]
    assert np.allclose(np.abs(run(x)[:50]), np.abs(c @ u.T), atol=1e-8)


def test_lag_rule_holds_on_long_calendars(spark):
    """25,000 dates ask for 13 lags; none is left out."""
    n = 25_000
    x = np.convolve(np.random.default_rng(7).normal(size=n + 20), np.ones(21), "valid")[:n]
    d = spark.createDataFrame(pd.DataFrame({"date": pd.date_range("1930-01-01", periods=n).date, "v": x}))
    got = IN.hac_mean(d, []).first()
    c, lag = x - x.mean(), int(4 * (n / 100) ** (2 / 9) + 1e-12)
    lrv = (c @ c + 2 * sum((1 - k / (lag + 1)) * (c[k:] @ c[:-k]) for k in range(1, lag + 1))) / n
    assert got["lag"] == lag == 13 and got["se"] == pytest.approx(np.sqrt(lrv / n))
