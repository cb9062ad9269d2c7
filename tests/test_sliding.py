"""Sliding order statistics against a plain re-evaluation of every frame."""

import math
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepanel.operators import sliding as SL

VALUES = st.lists(st.one_of(st.just(float("nan")), st.integers(-3, 3).map(float), st.floats(-5, 5)), max_size=60)


def frames(v, window, skip):
    for t in range(len(v)):
        yield t, sorted(x for x in v[max(0, t - skip - window + 1):max(0, t - skip + 1)] if x == x)


@settings(max_examples=60, deadline=None)
@given(VALUES, st.integers(1, 20), st.integers(0, 3), st.integers(1, 6))
def test_quantiles_and_ranks(v, window, skip, least):
    half, tail = (SL.quantile("x", "o", q, window, least, skip) for q in (0.5, 0.9))
    got = SL.order_pass(v, [half, tail])
    for t, held in frames(v, window, skip):
        for out, q in zip(got, (0.5, 0.9)):
            want = np.quantile(held, q) if len(held) >= least else np.nan
            assert np.isclose(out[t], want, equal_nan=True)
    rank = SL.order_pass(v, [SL.rank("x", "o", window, least)])[0]
    for t, held in frames(v, window, 0):
        known = v[t] == v[t] and len(held) >= least
        want = (sum(x < v[t] for x in held) + (sum(x == v[t] for x in held) + 1) / 2) / len(held) if known else np.nan
        assert np.isclose(rank[t], want, equal_nan=True)


@settings(max_examples=60, deadline=None)
@given(VALUES, st.integers(1, 20), st.integers(1, 6))
def test_mad_scale(v, window, least):
    got = SL.mad_pass(v, SL.mad_scale("x", "o", window, least))
    middle = [np.median(h) if len(h) >= least else np.nan for _, h in frames(v, window, 0)]
    away = [abs(x - m) for x, m in zip(v, middle)]
    mad = [np.median(h) if len(h) >= least else np.nan for _, h in frames(away, window, 0)]
    want = [np.nan, *(1.4826 * m if m else np.nan for m in mad)][:len(v)]
    assert np.allclose(got, want, equal_nan=True)


def test_table_of_several_keys(spark):
    """NULLs, a NULL key, names that the operator uses inside, a short key, a market frame."""
    rng = np.random.default_rng(3)
    rows = [(k, d, None if d % 7 == 3 else float(rng.normal()), "x") for k in ("a", "b", None) for d in range(40)] + [("c", 0, 1.0, "y")]
    df = spark.createDataFrame(rows, "key string, date int, x double, out string").repartition(5)
    stats = [SL.quantile("x", "q", 0.25, 10, 3), SL.rank("x", "r", 10, 3), SL.mad_scale("x", "s", 8, 2), SL.quantile("x", "q2", 0.75, 10, 3)]
    got = SL.with_order_statistics(df, *stats)
    assert got.columns == ["key", "date", "x", "out", "q", "r", "s", "q2"]
    by = {(r.key, r.date): r for r in got.collect()}
    assert len(by) == len(rows)
    for key in ("a", "b", None):
        v = [float("nan") if x is None else x for k, d, x, _ in rows if k == key]
        want = [SL.order_pass(v, [s])[0] for s in (stats[0], stats[1], stats[3])] + [SL.mad_pass(v, stats[2])]
        for d in range(40):
            r = by[key, d]
            for name, w in zip(("q", "r", "q2", "s"), want):
                assert (r[name] is None and math.isnan(w[d])) or math.isclose(r[name], w[d])
    assert by["c", 0].q is None and SL.with_order_statistics(df.limit(0), *stats).count() == 0
    market = SL.with_order_statistics(df.filter("key = 'a'").drop("key"), stats[0], keys=[]).collect()
    assert all(r.q == by["a", r.date].q for r in market)


@pytest.mark.parametrize("kind", ["quantile", "mad"])
def test_cost_hardly_grows_with_the_window(kind):
    v = np.random.default_rng(0).normal(size=40_000).tolist()

    def seconds(window):
        best = math.inf
        for _ in range(3):
            t0 = time.perf_counter()
            if kind == "mad":
                SL.mad_pass(v, SL.mad_scale("x", "o", window, 20))
            else:
                SL.order_pass(v, [SL.quantile("x", "o", 0.95, window, 20, 1)])
            best = min(best, time.perf_counter() - t0)
        return best
    assert seconds(750) < 2.5 * seconds(50)
