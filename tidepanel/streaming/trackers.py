"""Per-key threshold trackers with typed state.

A tracker runs the rules of ``operators.steps`` on a stream of scored rows, one key at a time.
Its state in the store is typed and grows with no history:

* a value: rows seen, the last date, rows that came too late;
* a list with the scores (and contexts) of the warm-up, dropped when it is over;
* a list with the last scores, from which the trailing order statistics of a rule are taken;
* a map from a side to the rule's state vector;
* with ``idle``, a timer on event time that forgets a key without rows.

A rule's context is either a column of the rows (memberships) or a trailing statistic, which the
tracker keeps itself. Thresholds are issued before each outcome; rows not newer than the last one of
their key are rejected and counted.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, nan

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from ..operators.sliding import interpolated
from ..operators.steps import TCP_LEAST, TCP_WINDOW, Rule

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("date", T.DateType()), T.StructField("q_lo", T.DoubleType()), T.StructField("q_hi", T.DoubleType()),
                    T.StructField("covered", T.BooleanType()), T.StructField("warmup", T.BooleanType()), T.StructField("late", T.LongType())])
VECTOR = T.ArrayType(T.DoubleType())
DAY_MS = 86_400_000


@dataclass(frozen=True)
class Trailing:
    """A statistic of the last ``window`` scores before a row: the finite-sample order statistic
    (infinite while fewer than ``least`` are known) or the interpolated quantile (missing then)."""
    kind: str
    window: int
    least: int

    def of(self, held: list[float], a: float, side: int) -> float:
        """``held`` is sorted. The lower side takes the statistic of the negated scores."""
        n = len(held)
        if self.kind == "order":
            if n < self.least:
                return float("inf")
            k = max(1, min(n, ceil((n + 1) * (1 - a) - 1e-12)))
            return held[k - 1] if side > 0 else -held[n - k]
        if n < self.least:
            return nan
        return interpolated(held, 1 - a) if side > 0 else -interpolated(held, a)


ORDER_STATISTIC = Trailing("order", TCP_WINDOW, TCP_LEAST)


class EntityTracker(StatefulProcessor):
    def __init__(self, rule: Rule, a: float, warmup: int, horizon: int | None, trailing: Trailing | None, column: str | None, idle: int | None):
        self.rule, self.a, self.warmup, self.horizon = rule, a, warmup, horizon or warmup
        self.trailing, self.column, self.idle = trailing, column, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "seen long, last date, late long, timer long")
        self.warm = handle.getListState("warm", T.StructType([T.StructField("s", T.DoubleType()), T.StructField("c", VECTOR)]))
        self.recent = handle.getListState("recent", "s double")
        self.sides = handle.getMapState("sides", "side string", T.StructType([T.StructField("state", VECTOR)]))

    def _contexts(self, held: list[float], c) -> tuple[np.ndarray, np.ndarray]:
        """The rule's context for the upper and the lower side."""
        if self.trailing:
            return tuple(np.array([self.trailing.of(held, self.a, side)]) for side in (1, -1))
        own = np.asarray(c if c is not None else (), dtype=float)
        return own, own

    def _begin(self, rows: list[tuple[float, list[float] | None]]) -> list[np.ndarray]:
        """Both sides' states after the warm-up rows."""
        s = np.array([x for x, _ in rows])
        k = len(rows[0][1]) if rows[0][1] is not None else 0
        states = [self.rule.start(float(np.quantile(side * s, 1 - self.a)), self.horizon, k) for side in (1, -1)]
        if self.rule.learns_in_warmup:
            for x, c in rows:
                states = self._learn(states, self._contexts([], c), x)[0]
        return states

    def _learn(self, states, contexts, s):
        issued = [self.rule.issue(st, c) for st, c in zip(states, contexts)]
        return [self.rule.learn(st, c, side * s, q) for st, c, q, side in zip(states, contexts, issued, (1, -1))], issued

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values("date", kind="stable")
        seen, last, late, timer = self.head.get() if self.head.exists() else (0, None, 0, None)
        warm = [(s, c) for s, c in self.warm.get()] if seen < self.warmup else []
        recent = [s for s, in self.recent.get()] if self.trailing else []
        held = sorted(recent)
        states = [np.array(self.sides.getValue((side,))[0]) for side in ("hi", "lo")] if seen >= self.warmup else []
        out = []
        for d, s, c in zip(pdf["date"], pdf["s"].astype(float), pdf[self.column] if self.column else [None] * len(pdf)):
            if last is not None and d <= last:
                late += 1
                continue
            last, seen = d, seen + 1
            if seen <= self.warmup:
                warm.append((s, None if c is None else [float(x) for x in c]))
                if seen == self.warmup:
                    states = self._begin(warm)
            else:
                states, (hi, lo) = self._learn(states, self._contexts(held, c), s)
                out.append((key[0], d, float(lo), float(hi), bool(s <= hi and -s <= lo), False, late))
            if self.trailing:
                recent.append(s)
                insort(held, s)
                if len(recent) > self.trailing.window:
                    del held[bisect_left(held, recent.pop(0))]
        if self.idle:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = int(pd.Timestamp(last).timestamp() * 1000) + self.idle * DAY_MS
            self.handle.registerTimer(timer)
        self.head.update((seen, last, late, timer))
        if self.trailing:
            self.recent.put([(s,) for s in recent])
        if seen < self.warmup:
            self.warm.put(warm)
        else:
            self.warm.clear()
            for side, state in zip(("hi", "lo"), states):
                self.sides.updateValue((side,), ([float(x) for x in state],))
        yield pd.DataFrame(out, columns=OUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.head, self.warm, self.recent, self.sides):
            state.clear()
        yield pd.DataFrame([], columns=OUT.names)

    def close(self) -> None:
        pass


def entity_tracker(rows: DataFrame, rule: Rule, a: float, warmup: int, horizon: int | None = None, trailing: Trailing | None = None,
                   idle: int | None = None) -> DataFrame:
    """Issued thresholds of a stream of rows (key, date, s and, for a rule with memberships, its
    column). ``horizon`` is the length that a rule with an integrator is tuned for; ``trailing``
    the statistic of a rule whose context is one; ``idle`` the days after which a key without rows
    is forgotten and starts anew."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    column = None if trailing else rule.context[0]
    d = rows.select("key", "date", "s", *([F.col(column).cast(VECTOR).alias(column)] if column else []))
    if idle:
        d = d.withColumn("at", F.col("date").cast("timestamp")).withWatermark("at", "0 seconds")
    return d.groupBy("key").transformWithStateInPandas(EntityTracker(rule, a, warmup, horizon, trailing, column, idle), OUT, "Append", "EventTime" if idle else "None")
