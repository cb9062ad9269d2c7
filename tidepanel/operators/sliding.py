"""Sliding order statistics in one ordered pass per key.

A frame's sorted values are kept from row to row: the new value is put in at its place, the
one that leaves is taken out, so a quantile, a rank or a median deviation of the last 750
rows costs hardly more than one of the last 50 (the search grows with the logarithm of the
window). Statistics of the same column and frame share one structure. Keys are groups of at
most the calendar's length; rows that are already dealt by key are not dealt again.

NULL and NaN are missing: they take up a row of the frame, but no place in the order.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAD_CONST = 1.4826


@dataclass(frozen=True)
class Stat:
    """A new column ``out`` from the last ``window`` rows of ``x``, without the newest
    ``skip``; missing where fewer than ``least`` values are known."""
    kind: str
    x: str
    out: str
    window: int
    least: int = 1
    skip: int = 0
    q: float = 0.5

    @property
    def frame(self) -> tuple[str, str, int, int, int]:
        alone = self.kind == "mad_scale"
        return ("mad" if alone else "order", self.x, self.window, self.skip, self.least if alone else 0)


def quantile(x: str, out: str, q: float, window: int, least: int = 1, skip: int = 0) -> Stat:
    """Linearly interpolated."""
    return Stat("quantile", x, out, window, least, skip, q)


def rank(x: str, out: str, window: int, least: int = 1) -> Stat:
    """Percentile rank of the current value in its frame, in (0, 1]; ties share their average."""
    return Stat("rank", x, out, window, least)


def mad_scale(x: str, out: str, window: int = 250, least: int = 50) -> Stat:
    """Robust scale, one row late: median distance of each value from the median of its own
    day. Both medians need ``least`` values; zero is missing."""
    return Stat("mad_scale", x, out, window, least)


def interpolated(held: list[float], q: float) -> float:
    at = (len(held) - 1) * q
    lo = int(at)
    low = held[lo]
    return low if at == lo else low + (held[lo + 1] - low) * (at - lo)


def order_pass(v: list[float], stats: list[Stat]) -> list[np.ndarray]:
    """All statistics of one frame. ``v`` is in order; NaN is missing."""
    window, skip, held = stats[0].window, stats[0].skip, []
    outs = [np.full(len(v), np.nan) for _ in stats]
    for t in range(len(v)):
        if t >= skip and (x := v[t - skip]) == x:
            insort(held, x)
        if t >= skip + window and (x := v[t - skip - window]) == x:
            del held[bisect_left(held, x)]
        n = len(held)
        for s, out in zip(stats, outs):
            if n < s.least or not n:
                continue
            if s.kind == "quantile":
                out[t] = interpolated(held, s.q)
            elif v[t] == v[t]:
                below, upto = bisect_left(held, v[t]), bisect_right(held, v[t])
                out[t] = (below + (upto - below + 1) / 2) / n
    return outs


def mad_pass(v: list[float], s: Stat) -> np.ndarray:
    half = Stat("quantile", s.x, "", s.window, s.least)
    middle = order_pass(v, [half])[0]
    away = order_pass(np.abs(np.array(v) - middle).tolist(), [half])[0]
    scale = np.r_[np.nan, away[:-1] * MAD_CONST] if len(away) else away
    scale[scale == 0] = np.nan
    return scale


def with_order_statistics(df: DataFrame, *stats: Stat, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Adds one double column for each statistic. Rows of a key are taken in ``order``, with
    NULLs first; keys may be NULL; without keys the table is one market frame."""
    keys, order = ["key"] if keys is None else keys, order or ["date"]
    frames: dict[tuple, list[Stat]] = {}
    for s in stats:
        frames.setdefault(s.frame, []).append(s)
    schema = T.StructType([*df.schema.fields, *[T.StructField(s.out, T.DoubleType()) for s in stats]])

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by([(o, "ascending") for o in order], null_placement="at_start")
        found = {}
        for (kind, x, *_), mine in frames.items():
            v = t[x].cast(pa.float64()).to_numpy().tolist()  # NULL becomes NaN
            got = [mad_pass(v, s) for s in mine] if kind == "mad" else order_pass(v, mine)
            found.update(zip((s.out for s in mine), got))
        for s in stats:
            t = t.append_column(s.out, pa.array(found[s.out], from_pandas=True))
        return t
    if keys:
        return df.groupBy(*keys).applyInArrow(one, schema)
    return df.groupBy(F.expr("cast(null as int)").alias("_frame")).applyInArrow(lambda _, t: one(t), schema)
