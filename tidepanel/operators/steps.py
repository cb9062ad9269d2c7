"""Online threshold rules, one side at a time.

A rule is three small functions over a state vector of floats: ``start`` builds
the state from the warm-up quantile, ``issue`` gives the threshold before the
outcome, ``learn`` returns the next state. The lower side of an interval runs the
same rule on the negated score. Batch folds and streaming state use the same
functions; Spark partitions the work by key.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sliding

EXPERT_RATES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.2)  # fixed values: candidate rates
TCP_WINDOW, TCP_GAMMA, TCP_LAMBDA, TCP_BETA, TCP_LEAST = 60, 0.01, 0.01, 0.75, 5  # fixed values
PID_SATURATION, PID_CLIP = 20.0, 1.5  # fixed values
POGO_GRID = 101  # fixed value: points of the mixture grid


@dataclass(frozen=True)
class Rule:
    """``context`` names the row values of the upper and lower side handed to
    the functions as a float vector (memberships, window quantiles)."""
    start: Callable[[float, int, int], np.ndarray]
    issue: Callable[[np.ndarray, np.ndarray], float]
    learn: Callable[[np.ndarray, np.ndarray, float, float], np.ndarray]
    context: tuple[str | None, str | None] = (None, None)
    learns_in_warmup: bool = False


def aci(a: float, eta: float = 0.05) -> Rule:
    return Rule(lambda q0, n, k: np.array([q0]), lambda st, c: st[0],
                lambda st, c, s, q: st + eta * (float(s > q) - a))


def sfogd(a: float, eta0: float = 1.0) -> Rule:
    def learn(st, c, s, q):
        g = float(s > q) - a
        g2 = st[1] + g * g
        return np.array([st[0] + eta0 / math.sqrt(g2) * g, g2])
    return Rule(lambda q0, n, k: np.array([q0, 1e-8]), lambda st, c: st[0], learn)


def weights(logw: np.ndarray) -> np.ndarray:
    w = np.exp(logw - logw.max(axis=-1, keepdims=True))
    return w / w.sum(axis=-1, keepdims=True)


def dtaci(a: float, rates=EXPERT_RATES, meta: float = 5.0, mix: float = 0.01) -> Rule:
    rate, e = np.asarray(rates), len(rates)

    def learn(st, c, s, q):
        bank, logw = st[:e], st[e:]
        gap = s - bank
        loss = np.where(gap > 0, (1 - a) * gap, -a * gap)
        w = (1 - mix) * weights(logw - meta * loss) + mix / e
        return np.concatenate([bank + rate * ((gap > 0) - a), np.log(w)])
    return Rule(lambda q0, n, k: np.concatenate([np.full(e, q0), np.zeros(e)]),
                lambda st, c: float(weights(st[e:]) @ st[:e]), learn)


def tcp(a: float) -> Rule:
    """Context: the window's order statistic (infinite while it is short)."""
    def learn(st, c, s, q):
        gamma = TCP_GAMMA / (1.0 + TCP_LAMBDA * st[1]) ** TCP_BETA
        return np.array([st[0] + gamma * (float(s > q) - a), st[1] + 1.0])
    return Rule(lambda q0, n, k: np.zeros(2), lambda st, c: c[0] + st[0], learn, ("base_hi", "base_lo"))


def pid(a: float, eta: float = 0.05, gain: float = 1.0) -> Rule:
    """Context: the trailing quantile of the side's scores, NULL while short.
    State: tracked level, error sum, starting level, integrator scale."""
    def offset(st):
        return gain * math.tan(min(max(st[1] * st[3], -PID_CLIP), PID_CLIP))

    def delta(st, c):
        return 0.0 if math.isnan(c[0]) else c[0] - st[2]

    def learn(st, c, s, q):
        miss = float(s - delta(st, c) > st[0] + offset(st)) - a
        return np.array([st[0] + eta * miss, st[1] + miss, st[2], st[3]])
    return Rule(lambda q0, n, k: np.array([q0, 0.0, q0, math.log(n) / (PID_SATURATION * n)]),
                lambda st, c: st[0] + offset(st) + delta(st, c), learn, ("cast_hi", "cast_lo"))


def rkr(a: float, eta: float = 0.05, groups: str = "groups") -> Rule:
    """Context: overlapping group memberships, the marginal group first."""
    def start(q0, n, k):
        return np.concatenate([[q0], np.zeros(k - 1)])
    return Rule(start, lambda st, c: float(st @ c),
                lambda st, c, s, q: st + eta * c * ((1 - a) if s > q else -a), (groups, groups))


def mondrian(a: float, eta=0.05, pi: str = "pi") -> Rule:
    """Context: regime probabilities; every regime moves by its own share."""
    rate = np.asarray(eta, dtype=float)
    return Rule(lambda q0, n, k: np.full(k, q0), lambda st, c: float(c @ st),
                lambda st, c, s, q: st + rate * c * (float(s > q) - a), (pi, pi))


def pogo(a: float, pi: str = "pi") -> Rule:
    """Coin betting; no rate to tune. A bet at share ``l`` of the miss side returns
    (1 - l) / (1 - a) on a covered row and l / a on a missed one, so a group's history
    is the counts of both, plus log returns of rows that it owned in part. The next
    share is the mean of the grid under those log returns and the arcsine prior, and
    a round multiplies the wealth by the return at that share."""
    l = np.linspace(0.5, POGO_GRID - 0.5, POGO_GRID) / POGO_GRID
    covered, missed = np.log((1 - l) / (1 - a)), np.log(l / a)
    prior = -0.5 * (np.log(l) + np.log1p(-l))
    width = 3 + POGO_GRID  # log wealth, covered rows, missed rows, log returns of partly owned rows

    def shares(rows):
        score = rows[:, 1:2] * covered + rows[:, 2:3] * missed + rows[:, 3:] + prior
        mass = np.exp(score - score.max(axis=1)[:, None])
        return mass @ l / mass.sum(axis=1)

    def issue(st, c):
        rows = st.reshape(-1, width)
        own = np.flatnonzero(c)
        stake = (shares(rows[own]) / a - 1) / (1 - a)
        return float(np.sum(c[own] * np.exp(rows[own, 0]) * stake))

    def learn(st, c, s, q):
        rows = st.reshape(-1, width).copy()
        hit = s <= q
        for j in np.flatnonzero(c):
            share = shares(rows[j:j + 1])[0]
            gain = (1 - share) / (1 - a) if hit else share / a
            rows[j, 0] += math.log1p(c[j] * (gain - 1))
            if c[j] == 1.0:
                rows[j, 1 if hit else 2] += 1
            else:
                rows[j, 3:] += np.log1p(c[j] * np.expm1(covered if hit else missed))
        return rows.ravel()

    def start(q0, n, k):
        rows = np.zeros((k, width))
        rows[:, 0] = -math.log(k)
        return rows.ravel()
    return Rule(start, issue, learn, (pi, pi), True)


def run_side(rule: Rule, side: int, s: np.ndarray, ctx, a: float, warmup: int) -> np.ndarray:
    """Issued thresholds of one side over one ordered stream."""
    n = len(s)
    k = len(ctx[0]) if ctx is not None and n else 0
    state = rule.start(float(np.quantile(s[:warmup], 1 - a)), n, k)
    out = np.empty(n)
    none = np.empty(0)
    for t in range(n):
        c = none if ctx is None else ctx[t]
        out[t] = q = rule.issue(state, c)
        if t >= warmup or rule.learns_in_warmup:
            state = rule.learn(state, c, s[t], q)
    return out


def _context(pdf, name):
    if name is None:
        return None
    first = pdf[name].iloc[0]
    if isinstance(first, (list, np.ndarray)):
        return [np.asarray(v, dtype=float) for v in pdf[name]]
    return pdf[name].to_numpy(dtype=float)[:, None]


INTERVAL = "q_lo double, q_hi double, covered boolean, covered_lo boolean, covered_hi boolean, warmup boolean"


def fold(df: DataFrame, rules: dict[str, Rule], alpha: float | dict[str, float] = 0.1, warmup: int = 100,
         score: str = "s", least: int | None = None, one_sided: bool = False) -> DataFrame:
    """Run rules over the ordered rows of every key: one pass of a grouped map by
    (arm, key). A key of a panel holds at most one row per calendar date. Entities
    with ``warmup + 50`` rows or fewer are left out (``least`` overrides)."""
    least = warmup + 50 if least is None else least
    arms = F.explode(F.array(*[F.lit(r) for r in rules]))
    d = df.filter(F.col(score).isNotNull()).withColumn("arm", arms)
    cols = d.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields) + ", " + INTERVAL

    def run(pdf):
        name = pdf["arm"].iloc[0] if len(pdf) else None
        if len(pdf) <= least:
            return pdf.iloc[:0].reindex(columns=[*cols, "q_lo", "q_hi", "covered", "covered_lo", "covered_hi", "warmup"])
        rule = rules[name]
        total = alpha[name] if isinstance(alpha, dict) else alpha
        a = total if one_sided else total / 2
        pdf = pdf.sort_values("date").reset_index(drop=True)
        s = pdf[score].to_numpy(dtype=float)
        hi = run_side(rule, 1, s, _context(pdf, rule.context[0]), a, warmup)
        lo = np.full(len(s), np.nan) if one_sided else run_side(rule, -1, -s, _context(pdf, rule.context[1]), a, warmup)
        pdf["q_lo"], pdf["q_hi"] = lo, hi
        pdf["covered_hi"] = s <= hi
        pdf["covered_lo"] = True if one_sided else -s <= lo
        pdf["covered"] = pdf["covered_hi"] & pdf["covered_lo"]
        pdf["warmup"] = np.arange(len(s)) < warmup
        return pdf
    out = d.groupBy("arm", "key").applyInPandas(run, schema)
    if one_sided:
        out = out.withColumn("q_lo", F.nanvl("q_lo", F.lit(None).cast("double")))
    return out


def raw_bounds(df: DataFrame, forecast: str, scale: str) -> DataFrame:
    """Standardized thresholds to bounds in raw units."""
    return (df.withColumn("lo", F.col(forecast) - F.col("q_lo") * F.col(scale))
            .withColumn("hi", F.col(forecast) + F.col("q_hi") * F.col(scale)))


def order_statistic(score: str, a: float, window: int = TCP_WINDOW, least: int = TCP_LEAST):
    """Finite-sample order statistic of the trailing scores before each row."""
    from .frames import by_key
    h = F.sort_array(F.collect_list(score).over(by_key().rowsBetween(-window, -1)))
    m = F.size(h)
    k = F.least(m, F.ceil((m + 1) * (1 - a) - 1e-12).cast("int"))
    return F.when(m >= least, F.element_at(h, F.greatest(k, F.lit(1)))).otherwise(F.lit(float("inf")))


def tcp_context(df: DataFrame, a: float, score: str = "s") -> DataFrame:
    d = df.withColumn("_neg", -F.col(score))
    return d.withColumn("base_hi", order_statistic(score, a)).withColumn("base_lo", order_statistic("_neg", a)).drop("_neg")


def pid_context(df: DataFrame, a: float, window: int, least: int, score: str = "s") -> DataFrame:
    """The lower side is the quantile of the negated scores: that of the scores at the other end, negated."""
    d = sliding.with_order_statistics(df, sliding.quantile(score, "cast_hi", 1 - a, window, least, 1), sliding.quantile(score, "cast_lo", a, window, least, 1))
    return d.withColumn("cast_lo", -F.col("cast_lo"))
