"""Bootstrap replicates as matrix products.

A daily frame (one row per group and date) is a small matrix, dates by columns. Replicates are rows
of ``spark.range``: a task draws the blocks of its replicates, counts how often each date is used and
multiplies these counts with the matrix, so no row per (replicate, date) is ever made or shuffled.
Raw rows are resampled in place: a task keeps one line of weighted sums for each replicate.

Every draw is the md5 of the seed, the number of the replicate and of the unit, so the same
replicates come out on any cluster and in plain SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most values of a daily frame; a market frame has some thousand dates and a few dozen columns.
MOST_VALUES = 20_000_000
#: Replicates that one task computes at once.
AT_ONCE = 128


def number(text: str) -> int:
    """A draw in [0, 2^32), the same as ``functions.columns.draw``."""
    return int.from_bytes(md5(text.encode()).digest()[:4], "big")


@dataclass(frozen=True)
class Daily:
    """A daily frame as a matrix: ``values`` (groups, columns, dates), NaN where missing."""
    dates: list
    groups: list[tuple]
    values: np.ndarray
    present: np.ndarray

    @property
    def length(self) -> int:
        return len(self.dates)


def daily_matrix(daily: DataFrame, by: list[str], values: list[str]) -> Daily:
    rows = daily.select(*by, "date", *[F.col(v).cast("double").alias(v) for v in values])
    if rows.count() * max(1, len(values)) > MOST_VALUES:
        raise ValueError("not a daily frame: it has more rows than a calendar")
    t = rows.toArrow()
    at = {d: i for i, d in enumerate(sorted(set(t["date"].to_pylist())))}
    keys = list(zip(*(t[c].to_pylist() for c in by))) if by else [()] * t.num_rows
    names = {k: i for i, k in enumerate(sorted(set(keys), key=lambda k: [(x is not None, x) for x in k]))}
    out = np.full((len(names), len(values), len(at)), np.nan)
    present = np.zeros((len(names), len(at)))
    g, d = np.array([names[k] for k in keys], int), np.array([at[x] for x in t["date"].to_pylist()], int)
    if len(g):
        present[g, d] = 1
        for j, v in enumerate(values):
            out[g, j, d] = t[v].to_numpy()
    return Daily(list(at), list(names), out, present)


def replicate(spark: SparkSession, reps: int, fn: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """Rows that ``fn`` makes of the numbers of replicates, counted from 1."""
    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-reps // AT_ONCE)))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in parts:
            ids = rb.column(0).to_numpy()
            for lo in range(0, len(ids), AT_ONCE):
                out = fn(ids[lo:lo + AT_ONCE])
                yield pa.RecordBatch.from_arrays([pa.array(c, from_pandas=True) for c in out.values()], names=list(out))
    return spark.range(1, reps + 1, 1, tasks).mapInArrow(batches, schema)


def block_starts(ids: np.ndarray, length: int, block: int, seed: str, circular: bool) -> np.ndarray:
    """(replicates, blocks): the first position of each block."""
    span, blocks = length if circular else length - block + 1, math.ceil(length / block)
    if span < 1:
        raise ValueError("a block is longer than the calendar")
    return np.array([[number(f"{seed}:{r}:{b}") % span for b in range(blocks)] for r in ids.tolist()], np.int64)


def block_paths(ids: np.ndarray, length: int, block: int, seed: str, circular: bool = False) -> np.ndarray:
    """(replicates, dates): the positions of each replicate series in order; the last block is cut."""
    starts = block_starts(ids, length, block, seed, circular)
    return ((starts[:, :, None] + np.arange(block)).reshape(len(ids), -1)[:, :length]) % length


def block_counts(ids: np.ndarray, length: int, block: int, seed: str, circular: bool = False) -> np.ndarray:
    """(replicates, dates): how often each date is used."""
    paths = block_paths(ids, length, block, seed, circular)
    flat = (paths + np.arange(len(ids))[:, None] * length).ravel()
    return np.bincount(flat, minlength=len(ids) * length).reshape(len(ids), length).astype(float)


def _labelled(ids: np.ndarray, m: Daily, by: list[str], kinds: dict[str, str]) -> dict[str, np.ndarray]:
    """The replicate and group of each line, groups inside replicates."""
    out = {"rep": np.repeat(ids, len(m.groups))}
    for j, c in enumerate(by):
        out[c] = np.array([g[j] for g in m.groups] * len(ids), dtype=object)
    return out


def _schema(daily: DataFrame, by: list[str], more: list[str]) -> str:
    return ", ".join(["rep long", *[f"`{c}` {daily.schema[c].dataType.simpleString()}" for c in by], *[f"`{v}` double" for v in more]])


def block_means(daily: DataFrame, by: list[str], values: list[str], reps: int, block: int, seed: str, circular: bool = False) -> DataFrame:
    """(rep, group, value means, draws): means over the draws of dates that have the value."""
    m = daily_matrix(daily, by, values)
    known = np.isfinite(m.values)
    flat, have = np.where(known, m.values, 0).reshape(-1, m.length), known.reshape(-1, m.length).astype(float)

    def fn(ids):
        times = block_counts(ids, m.length, block, seed, circular)
        with np.errstate(invalid="ignore", divide="ignore"):
            means = ((times @ flat.T) / (times @ have.T)).reshape(len(ids), len(m.groups), len(values))
        out = _labelled(ids, m, by, {})
        out |= {v: means[:, :, j].ravel() for j, v in enumerate(values)}
        return out | {"draws": (times @ m.present.T).ravel()}
    return replicate(daily.sparkSession, reps if m.length else 0, fn, _schema(daily, by, [*values, "draws"]))


def block_sums(daily: DataFrame, by: list[str], values: list[str], dates: list, reps: int, block: int, seed: str, circular: bool = False) -> DataFrame:
    """(rep, group, value sums): ``dates`` is the calendar that is resampled; missing values count zero."""
    m = daily_matrix(daily, by, values)
    at = {d: i for i, d in enumerate(sorted(dates))}
    full = np.zeros((len(m.groups) * len(values), len(at)))
    full[:, [at[d] for d in m.dates]] = np.nan_to_num(m.values).reshape(-1, m.length)

    def fn(ids):
        sums = (block_counts(ids, len(at), block, seed, circular) @ full.T).reshape(len(ids), len(m.groups), len(values))
        return _labelled(ids, m, by, {}) | {v: sums[:, :, j].ravel() for j, v in enumerate(values)}
    return replicate(daily.sparkSession, reps if at else 0, fn, _schema(daily, by, values))


# --- statistics of replicate series ---------------------------------------------------

def hac_slopes(v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slope of each row of ``v`` on [1, x] with x in {0, 1}, and its HAC standard error."""
    n, n1 = v.shape[1], x.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        high, low = (v * x).sum(1) / n1, (v * (1 - x)).sum(1) / (n - n1)
        slope = high - low
        u = v - low[:, None] - slope[:, None] * x
        g = u * x
        lag = math.floor(4 * (n / 100) ** (2 / 9) + 1e-12)
        dot = lambda a, b, k: np.einsum("ij,ij->i", a[:, k:], b[:, :n - k])
        m00, m01, m11 = dot(u, u, 0), dot(u, g, 0), dot(g, g, 0)
        for k in range(1, min(lag, n - 1) + 1):
            w = 1 - k / (lag + 1)
            m00, m11 = m00 + 2 * w * dot(u, u, k), m11 + 2 * w * dot(g, g, k)
            m01 = m01 + w * (dot(u, g, k) + dot(g, u, k))
        a, b = -1 / (n - n1), n / (n1 * (n - n1))
        se = np.sqrt(np.maximum(a * a * m00 + 2 * a * b * m01 + b * b * m11, 0))
    return slope, np.where(se > 0, se, np.nan)


def block_hac_slopes(daily: DataFrame, by: list[str], value: str, flag: str, reps: int, block: int, seed: str) -> DataFrame:
    """(rep, group, b1, se): the stress regression on each replicate series, which keeps its own
    date order; dates that a group does not have are left out of its series."""
    m = daily_matrix(daily, by, [value, flag])

    def fn(ids):
        paths = block_paths(ids, m.length, block, seed)
        b, se = np.full((len(ids), len(m.groups)), np.nan), np.full((len(ids), len(m.groups)), np.nan)
        for j, (v, x) in enumerate(m.values):
            known = np.isfinite(v) & np.isfinite(x)
            if known.all():
                b[:, j], se[:, j] = hac_slopes(v[paths], x[paths])
            else:
                for i, path in enumerate(paths):
                    own = path[known[path]]
                    b[i, j:j + 1], se[i, j:j + 1] = hac_slopes(v[own][None], x[own][None])
        return _labelled(ids, m, by, {}) | {"b1": b.ravel(), "se": se.ravel()}
    return replicate(daily.sparkSession, reps if m.length else 0, fn, _schema(daily, by, ["b1", "se"]))


def wild_t(clusters: list, sums: np.ndarray, reps: int, seed: str, spark: SparkSession) -> DataFrame:
    """(rep, t): wild cluster bootstrap statistics with the null imposed. ``sums`` has for each cluster the
    sums of the restricted residuals, of those on flagged days, and the counts of both."""
    r0, r1, c0, c1 = sums.T
    n, n1, k = c0.sum(), c1.sum(), len(clusters)

    def fn(ids):
        w = np.array([[1.0 if number(f"{seed}:{r}:{c}") % 2 == 0 else -1.0 for c in clusters] for r in ids.tolist()]).reshape(len(ids), k)
        y0, y1 = w * r0, w * r1
        s0, s1 = y0.sum(1), y1.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            b0 = (s0 - s1) / (n - n1)
            b1 = s1 / n1 - b0
            g0 = y0 - b0[:, None] * c0 - b1[:, None] * c1
            g1 = y1 - (b0 + b1)[:, None] * c1
            a, b = -1 / (n - n1), n / (n1 * (n - n1))
            adj = k / (k - 1) * (n - 1) / (n - 2)
            v = adj * (a * a * (g0 * g0).sum(1) + 2 * a * b * (g0 * g1).sum(1) + b * b * (g1 * g1).sum(1))
            return {"rep": ids, "t": np.abs(b1 / np.sqrt(v))}
    return replicate(spark, reps, fn, "rep long, t double")


def unit_means(sums: np.ndarray, counts: np.ndarray, reps: int, seed: str, spark: SparkSession) -> DataFrame:
    """(rep, m): weighted means over units drawn with replacement."""
    n = len(sums)

    def fn(ids):
        at = np.array([[number(f"{seed}:{r}:{j}") % n for j in range(1, n + 1)] for r in ids.tolist()], np.int64).reshape(len(ids), n)
        return {"rep": ids, "m": sums[at].sum(1) / counts[at].sum(1)}
    return replicate(spark, reps if n else 0, fn, "rep long, m double")


# --- rows ---------------------------------------------------------------------------

POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def row_weights(texts: list[str], reps: int, seed: str) -> np.ndarray:
    """(rows, replicates): Poisson(1) weights; one md5 gives those of four replicates."""
    blocks = -(-reps // 4)
    raw = b"".join(md5(f"{seed}:{b}:{t}".encode()).digest() for t in texts for b in range(blocks))
    u = (np.frombuffer(raw, ">u4").reshape(len(texts), 4 * blocks)[:, :reps].astype(float) + 0.5) / 4294967296.0
    return np.searchsorted(POISSON, u)


def weighted_sums(df: DataFrame, unit: list[str], columns: list[str], reps: int, seed: str, by: list[str] | None = None) -> DataFrame:
    """(by, rep, columns): sums of the columns under the weights of each replicate; ``unit`` names a row.
    A task keeps replicates x columns for each group in its partition; groups are few."""
    by, chunk = by or [], 2_000

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, np.ndarray] = {}
        for rb in parts:
            for lo in range(0, rb.num_rows, chunk):
                part = rb.slice(lo, chunk)
                cols = part.columns
                w = row_weights(list(map(":".join, zip(*(c.to_pylist() for c in cols[:len(unit)])))), reps, seed)
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in cols[len(unit):len(unit) + len(columns)]], 1)
                keys = list(zip(*(c.to_pylist() for c in cols[len(unit) + len(columns):]))) if by else [()] * part.num_rows
                for k in set(keys):
                    mine = np.array([q == k for q in keys]) if by else slice(None)
                    total[k] = total.get(k, 0) + w[mine].T @ x[mine]
        for k, sums in total.items():
            arrays = [pa.array([v] * reps, pa.string()) for v in k]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(1, reps + 1)), *[pa.array(c) for c in sums.T]], names=[*by, "rep", *columns])
    src = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_u{i}") for i, c in enumerate(unit)],
                    *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], *[F.col(c).cast("string").alias(f"_g{i}") for i, c in enumerate(by)])
    schema = ", ".join([*[f"`{c}` string" for c in by], "rep long", *[f"`{c}` double" for c in columns]])
    return src.mapInArrow(batches, schema).groupBy(*by, "rep").agg(*[F.sum(c).alias(c) for c in columns])
