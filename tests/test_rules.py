"""Online rules on seeded streams: coverage, adaptation, reductions."""

import numpy as np
import pytest

from tidepanel.operators import steps as S

W = 100


def miss_rate(rule, s, a=0.05, ctx=None, warmup=W):
    q = S.run_side(rule, 1, s, ctx, a, warmup)
    return float((s[warmup:] > q[warmup:]).mean()), q


@pytest.mark.parametrize("rule", [S.aci(0.05), S.sfogd(0.05), S.dtaci(0.05), S.pid(0.05)], ids=["aci", "sfogd", "dtaci", "pid"])
def test_marginal_level_on_iid(rule):
    s = np.random.default_rng(0).normal(size=6000)
    ctx = [np.array([np.nan])] * len(s) if rule.context[0] else None
    assert abs(miss_rate(rule, s, ctx=ctx)[0] - 0.05) < 0.02


def test_rate_mixture_converges_after_a_variance_shift():
    """The mixture promises gradual adaptation: the threshold approaches the new
    95 % point (4.93) and two-sided coverage improves after the transition."""
    g = np.random.default_rng(1)
    s = np.concatenate([g.normal(size=4000), g.normal(size=4000) * 3])
    hi, lo = (S.run_side(S.dtaci(0.05), k, k * s, None, 0.05, W) for k in (1, -1))
    cov = (s <= hi) & (-s <= lo)
    assert hi[-200:].mean() > 4.0 and cov[6500:].mean() > cov[4000:5000].mean() + 0.02


@pytest.mark.parametrize("rule", [S.aci(0.05), S.sfogd(0.05)], ids=["aci", "sfogd"])
def test_adapts_to_variance_shift(rule):
    g = np.random.default_rng(1)
    s = np.concatenate([g.normal(size=4000), g.normal(size=4000) * 3])
    q = S.run_side(rule, 1, s, None, 0.05, W)
    assert abs((s[5000:] > q[5000:]).mean() - 0.05) < 0.02
    assert q[7000:].mean() > 1.8 * q[2000:4000].mean()


def test_hand_trace():
    s = np.concatenate([np.zeros(10), [0.5, 9.0]])
    pi = [np.array([0.75, 0.25])] * 12
    q = S.run_side(S.mondrian(0.1, (0.1, 0.4)), 1, s, pi, 0.1, 10)
    # one miss at step 10: .9 * (.1 * .75 * .75 + .4 * .25 * .25)
    assert q[10] == 0 and q[11] == pytest.approx(0.9 * (0.1 * 0.75 ** 2 + 0.4 * 0.25 ** 2))
    assert q[11] == pytest.approx(0.073125)


def test_one_regime_is_plain_tracking():
    s = np.random.default_rng(2).normal(size=800)
    one = [np.array([1.0])] * len(s)
    plain = S.run_side(S.aci(0.05), 1, s, None, 0.05, W)
    assert np.allclose(plain, S.run_side(S.mondrian(0.05, 0.05), 1, s, one, 0.05, W), atol=1e-12)
    assert np.allclose(plain, S.run_side(S.rkr(0.05), 1, s, one, 0.05, W), atol=1e-12)


def two_state(n=20000):
    g = np.random.default_rng(3)
    state = np.zeros(n, dtype=int)
    for t in range(1, n):
        flip = g.random() < (0.02 if state[t - 1] else 0.005)
        state[t] = state[t - 1] ^ flip
    return g.normal(size=n) * (1 + 3 * state), state


def test_plain_tracking_fails_in_stress_and_regimes_repair_it():
    s, state = two_state()
    plain = S.run_side(S.aci(0.05, 0.005), 1, s, None, 0.05, W)
    pi = [np.array([1.0 - k, float(k)]) for k in state]
    soft = S.run_side(S.mondrian(0.05, (0.05, 0.2)), 1, s, pi, 0.05, W)
    bad = state == 1
    assert (s > plain)[bad].mean() > 0.10
    assert abs((s > soft)[bad][500:].mean() - 0.05) < 0.03


def test_issued_equals_membership_times_state():
    g = np.random.default_rng(4)
    s = g.standard_t(6, size=600)
    pi = g.dirichlet([1, 1, 1], size=600)
    q = S.run_side(S.mondrian(0.05, (0.02, 0.05, 0.1)), 1, s, list(pi), 0.05, W)
    state = np.full(3, np.quantile(s[:W], 0.95))
    for t in range(600):
        assert q[t] == pytest.approx(pi[t] @ state, abs=1e-10)
        if t >= W:
            state = state + np.array([0.02, 0.05, 0.1]) * pi[t] * (float(s[t] > q[t]) - 0.05)


def test_coin_betting_adapts_by_group():
    g = np.random.default_rng(5)
    n = 12000
    stress = (np.arange(n) // 250) % 4 == 3
    s = g.normal(size=n) * np.where(stress, 3.0, 1.0)
    pi = [np.array([1.0 - k, float(k)]) for k in stress]
    q = S.run_side(S.pogo(0.05), 1, s, pi, 0.05, W)
    late = np.arange(n) > 4000
    assert abs((s > q)[late & stress].mean() - 0.05) < 0.03
    assert q[late & stress].mean() > 1.8 * q[late & ~stress].mean()


def test_future_does_not_move_the_past():
    s = np.random.default_rng(6).normal(size=500)
    t = s.copy()
    t[300:] += 50
    for rule in (S.aci(0.05), S.sfogd(0.05), S.dtaci(0.05)):
        assert np.array_equal(S.run_side(rule, 1, s, None, 0.05, W)[:301], S.run_side(rule, 1, t, None, 0.05, W)[:301])


def test_infinite_until_the_window_fills(spark):
    import pandas as pd
    d = spark.createDataFrame(pd.DataFrame({"key": "a", "date": pd.date_range("2020-01-01", periods=80).date,
                                            "s": np.random.default_rng(7).normal(size=80)}))
    p = S.tcp_context(d, 0.05).orderBy("date").toPandas()
    assert np.isinf(p["base_hi"][:5]).all() and np.isfinite(p["base_hi"][5:]).all()
    past = np.sort(p["s"][10:70])  # the 60 before row 70
    assert p["base_hi"][70] == past[min(59, int(np.ceil(61 * 0.95)) - 1)]
