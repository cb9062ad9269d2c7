"""Trackers across several micro-batches equal the batch results."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidepanel.operators import pooled as PO
from tidepanel.operators import steps as S
from tidepanel.streaming import streams as ST


def land(spark, pdf, path, cuts, schema):
    """Appends in date order, each one later than the one before."""
    for a, b in zip(cuts, cuts[1:]):
        spark.createDataFrame(pdf[(pdf["pos"] >= a) & (pdf["pos"] < b)].drop(columns="pos")).select(*[c.split()[0] for c in schema.split(", ")]) \
            .coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return ST.read_landed(spark, path, spark.read.parquet(path).schema, per_trigger=1)


def test_entity_tracker_over_batches(spark, tmp_path):
    g = np.random.default_rng(0)
    dates = pd.date_range("2021-01-01", periods=200).date
    pdf = pd.concat([pd.DataFrame({"key": k, "date": dates, "s": g.normal(size=200), "pos": range(200)}) for k in "ab"])
    stream = land(spark, pdf, str(tmp_path / "in"), [0, 30, 90, 200], "key string, date date, s double")
    got = ST.run_to_table(ST.entity_tracker(stream, S.dtaci(0.05), 0.05, 50)).orderBy("key", "date").toPandas()
    batch = S.fold(spark.createDataFrame(pdf.drop(columns="pos")), {"x": S.dtaci(0.05)}, 0.1, 50, least=50).filter("not warmup").orderBy("key", "date").toPandas()
    assert len(got) == 300 and np.allclose(got[["q_lo", "q_hi"]], batch[["q_lo", "q_hi"]]) and (got["covered"] == batch["covered"]).all()


def scored(n=220, keys="ab"):
    """Scores with memberships and overlapping groups."""
    g = np.random.default_rng(2)
    dates = pd.date_range("2021-01-01", periods=n).date
    parts = []
    for k in keys:
        soft = g.dirichlet([1, 1, 1], size=n)
        hard = np.eye(3)[g.integers(0, 3, n)]
        pi = [list(map(float, soft[i] if i % 3 else hard[i])) for i in range(n)]
        parts.append(pd.DataFrame({"key": k, "date": dates, "s": g.normal(size=n) * np.linspace(1, 3, n), "pi": pi, "groups": [[1.0, *map(float, hard[i])] for i in range(n)], "pos": range(n)}))
    return pd.concat(parts)


RULES = {
    "aci": (S.aci(0.05), None), "sfogd": (S.sfogd(0.05), None), "tcp": (S.tcp(0.05), ST.trackers.ORDER_STATISTIC), "pid": (S.pid(0.05), ST.trackers.Trailing("quantile", 80, 50)),
    "rkr": (S.rkr(0.05), None), "mondrian": (S.mondrian(0.05, (0.02, 0.05, 0.1)), None), "pogo": (S.pogo(0.05), None),
}


@pytest.mark.parametrize("name", RULES)
def test_every_rule_over_batches_and_a_restart(spark, tmp_path, name):
    """Two batches, a stopped query, a third batch with the checkpoint: equal to the batch fold."""
    rule, trailing = RULES[name]
    pdf = scored()
    schema = "key string, date date, s double, pi array<double>, groups array<double>"
    track = lambda stream: ST.entity_tracker(stream, rule, 0.05, 50, horizon=220, trailing=trailing)
    base, path = str(tmp_path / "base"), str(tmp_path / "in")
    ST.run_to_table(track(land(spark, pdf, path, [0, 30, 120], schema)), base=base)
    late = pdf[(pdf["key"] == "a") & (pdf["pos"] == 100)].assign(pos=219)
    got = ST.run_to_table(track(land(spark, pd.concat([pdf, late]), path, [120, 220], schema)), base=base).orderBy("key", "date").toPandas()
    d = spark.createDataFrame(pdf.drop(columns="pos"), schema)
    d = S.tcp_context(d, 0.05) if name == "tcp" else S.pid_context(d, 0.05, 80, 50) if name == "pid" else d
    batch = S.fold(d, {"x": rule}, 0.1, 50, least=50).filter("not warmup").orderBy("key", "date").toPandas()
    assert len(got) == 340 and np.allclose(got[["q_lo", "q_hi"]], batch[["q_lo", "q_hi"]]) and (got["covered"] == batch["covered"]).all()
    assert got[got["key"] == "a"]["late"].max() == 1 and got[got["key"] == "b"]["late"].max() == 0


def test_idle_keys_are_forgotten(spark, tmp_path):
    """A key without rows for the idle time starts anew; another key goes on."""
    dates = pd.date_range("2021-01-01", periods=60).date
    busy = pd.DataFrame({"key": "b", "date": dates, "s": 1.0, "pos": range(60)})
    quiet = pd.DataFrame({"key": "a", "date": [*dates[:10], *dates[50:]], "s": 2.0, "pos": [*range(10), *range(50, 60)]})
    stream = land(spark, pd.concat([busy, quiet]), str(tmp_path / "in"), [0, 10, 40, 50, 60], "key string, date date, s double")
    got = ST.run_to_table(ST.entity_tracker(stream, S.aci(0.05), 0.05, 5, idle=20)).toPandas()
    assert sorted(got[got["key"] == "a"]["date"]) == [*dates[5:10], *dates[55:]] and len(got[got["key"] == "b"]) == 55


def test_run_length_over_batches(spark, tmp_path):
    flags = [True, True, False, True, True, True, False, False, True, True]
    pdf = pd.DataFrame({"key": "a", "date": pd.date_range("2021-01-01", periods=10).date, "flag": flags, "pos": range(10)})
    stream = land(spark, pdf, str(tmp_path / "in"), [0, 4, 9, 10], "key string, date date, flag boolean")
    got = ST.run_to_table(ST.run_length(stream)).orderBy("date").toPandas()["run"].tolist()
    assert got == [1, 2, 0, 1, 2, 3, 0, 0, 1, 2]


def test_panel_tracker_over_batches_with_late_rows(spark, tmp_path):
    g = np.random.default_rng(1)
    dates = pd.date_range("2021-01-01", periods=40).date
    pdf = pd.concat([pd.DataFrame({"key": f"k{j}", "date": dates, "s_std": g.normal(size=40), "sigma_hat": 1.0, "pos": range(40)}) for j in range(30)])
    late = pd.DataFrame({"key": ["z"], "date": [dates[3]], "s_std": [99.0], "sigma_hat": [1.0], "pos": [39]})
    cols = "key string, date date, s_std double, sigma_hat double"
    stream = land(spark, pd.concat([pdf, late]), str(tmp_path / "in"), [0, 12, 13, 40], cols)
    member = spark.createDataFrame(pd.DataFrame({"date": dates, "pi": [[1.0, 0.0] if i % 2 else [0.3, 0.7] for i in range(40)]}))
    make = lambda: PO.FixedWalk(0.1, (0.01, 0.03))
    tracker = ST.PanelTracker(spark, make, member, 2, {"hi": 1.6, "lo": 1.5})
    got = ST.run_panel_tracker(stream, tracker).orderBy("date").toPandas()
    q = {1: np.full(2, 1.6), -1: np.full(2, 1.5)}
    want = []
    for i, d in enumerate(dates[:-1]):
        s, pi = pdf[pdf["date"] == d]["s_std"].to_numpy(), np.array([1.0, 0.0] if i % 2 else [0.3, 0.7])
        issued = {k: float(pi @ q[k]) for k in q}
        want.append((issued[-1], issued[1]))
        for k in q:
            q[k] = q[k] + np.array([0.01, 0.03]) * pi * (((k * s) > issued[k]).sum() - 0.05 * len(s))
    assert len(got) == 39 and np.allclose(got[["q_lo", "q_hi"]], want)
    assert tracker.late().count() == 1 and tracker.late().filter(F.col("key") == "z").count() == 1


@pytest.mark.parametrize("make", [lambda: PO.AdaptiveWalk(0.1, (0.002, 0.01, 0.05)), lambda: PO.FixedWalk(0.1, (0.01, 0.03))], ids=["adaptive", "fixed"])
def test_panel_tracker_does_not_depend_on_batches(spark, tmp_path, make):
    g = np.random.default_rng(4)
    dates = pd.date_range("2021-01-01", periods=24).date
    pdf = pd.concat([pd.DataFrame({"key": f"k{j}", "date": dates, "s_std": g.normal(size=24) * 2, "sigma_hat": 1.0, "pos": range(24)}) for j in range(20)])
    member = spark.createDataFrame(pd.DataFrame({"date": dates, "pi": [[1.0, 0.0] if i % 2 else [0.3, 0.7] for i in range(24)]}))
    got = []
    for n, cuts in enumerate(([0, 24], [0, 7, 8, 15, 24])):
        stream = land(spark, pdf, str(tmp_path / f"in{n}"), cuts, "key string, date date, s_std double, sigma_hat double")
        got.append(ST.run_panel_tracker(stream, ST.PanelTracker(spark, make, member, 2, {"hi": 1.6, "lo": 1.5})).orderBy("date").toPandas())
    assert len(got[0]) == 23 and np.allclose(got[0][["q_lo", "q_hi"]], got[1][["q_lo", "q_hi"]])


def test_append_mode_bars_wait_for_the_watermark(spark, tmp_path):
    ts = pd.date_range("2024-01-01 10:00", periods=60, freq="min")
    pdf = pd.DataFrame({"key": "a", "ts": ts, "event_id": range(60), "price": np.arange(60.0) + 1, "pos": range(60)})
    stream = land(spark, pdf, str(tmp_path / "in"), [0, 30, 60], "key string, ts timestamp, event_id long, price double")
    got = ST.run_to_table(ST.bars(stream, "5 minutes", "10 minutes")).select(F.col("window.start").alias("b"), "open", "close", "n_trades").orderBy("b").toPandas()
    assert len(got) == 9 and (got["n_trades"] == 5).all() and got["open"].tolist() == [1.0 + 5 * i for i in range(9)]
