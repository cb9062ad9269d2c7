"""Window operators over a panel (one row per key and date)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clip, ratio
from . import sliding
from .frames import by_key

DECAY = (0.50, 0.25, 0.15, 0.10)


def trailing(k: int, skip: int = 0, w=None):
    """The last ``k`` observations, leaving out the ``skip`` newest."""
    return (w or by_key()).rowsBetween(-(k - 1) - skip, -skip)


def full_mean(x: str, k: int) -> Column:
    w = trailing(k)
    return F.when(F.count(x).over(w) >= k, F.avg(x).over(w))


def mean(x: str, k: int, least: int = 1, skip: int = 0) -> Column:
    w = trailing(k, skip)
    return F.when(F.count(x).over(w) >= least, F.avg(x).over(w))


def std(x: str, k: int, least: int = 2, skip: int = 0) -> Column:
    w = trailing(k, skip)
    return F.when(F.count(x).over(w) >= least, F.stddev_samp(x).over(w))


def volume_shock(x: str, k: int = 20, least: int = 5) -> Column:
    r = ratio(F.col(x), mean(x, k, least))
    return F.coalesce(r, F.lit(1.0))


def decay_kernel(x: str) -> Column:
    parts = [F.coalesce(F.lag(x, i + 1).over(by_key()), F.lit(0.0)) * wt for i, wt in enumerate(DECAY)]
    return sum(parts[1:], parts[0])


def mad_scale(df: DataFrame, x: str, out: str = "sigma_hat", window: int = 250,
              least: int = 50) -> DataFrame:
    """Trailing robust scale, one observation late. Each deviation is taken from
    the median of its own day, so the minimum count applies twice."""
    return sliding.with_order_statistics(df, sliding.mad_scale(x, out, window, least))


def zscore(x: str, floor: float = 0.001, bound: float = 5.0) -> Column:
    w = Window.partitionBy("key")
    sd = F.greatest(F.stddev_samp(x).over(w), F.lit(floor))
    return clip((F.col(x) - F.avg(x).over(w)) / sd, -bound, bound)


def run_length(df: DataFrame, flag: str, out: str = "run", keys: list[str] | None = None,
               order: list[str] | None = None) -> DataFrame:
    """Consecutive observations inside a condition, counted from 1; 0 outside."""
    w = by_key(*(order or ["date"]), key=keys or ["key"])
    entry = (F.col(flag) & ~F.coalesce(F.lag(flag).over(w), F.lit(False))).cast("int")
    d = df.withColumn("_e", entry).withColumn("_i", F.sum("_e").over(
        w.rowsBetween(Window.unboundedPreceding, 0)))
    isl = by_key(*(order or ["date"]), key=[*(keys or ["key"]), "_i", flag])
    return d.withColumn(out, F.when(F.col(flag), F.row_number().over(isl)).otherwise(0)).drop("_e", "_i")


def episodes(df: DataFrame, flag: str, gap: int, out: str = "episode",
             keys: list[str] | None = None) -> DataFrame:
    """Number flagged rows by episode: a distance of more than ``gap`` positions
    on the calendar starts a new one (0-based; NULL outside)."""
    keys = keys or ["_one"]
    d = df if "_one" not in keys else df.withColumn("_one", F.lit(0))
    w = by_key("date", key=keys)
    d = d.withColumn("_pos", F.row_number().over(w))
    hit = F.when(F.col(flag), F.col("_pos"))
    prev = F.last(hit, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    start = F.when(F.col(flag) & (prev.isNull() | (F.col("_pos") - prev > gap)), 1).otherwise(0)
    d = d.withColumn("_start", start)
    eid = F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1
    return d.withColumn(out, F.when(F.col(flag), eid)).drop("_pos", "_start", "_one")


def history(x: str, k: int, skip: int = 0) -> Column:
    """The last ``k`` values as an array, only when complete."""
    h = F.collect_list(x).over(trailing(k, skip))
    return F.when(F.size(h) == k, h)


def ema(df: DataFrame, x: str, span: int, out: str = "ema") -> DataFrame:
    """Exponential mean with adjusted weights over all values of a key so far; NULL
    values are skipped. Sums weighted by growing powers run over blocks whose powers
    reach e^280 at most. A block also takes in the one before it; what is older
    weighs less than e^-280, far below double precision, for any span."""
    r = 1 - 2.0 / (span + 1)
    if r <= 0:
        return df.withColumn(out, F.last(x, ignorenulls=True).over(by_key().rowsBetween(Window.unboundedPreceding, 0)))
    size = int(280 / -math.log(r)) + 1
    so_far = by_key().rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_n", F.count(x).over(so_far)).withColumn("_k", F.floor((F.col("_n") - 1) / size)).withColumn("_j", F.col("_n") - 1 - F.col("_k") * size)
    inside = Window.partitionBy("key", "_k").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_own", F.sum(F.col(x) * F.pow(F.lit(r), -F.col("_j"))).over(inside) * F.pow(F.lit(r), F.col("_j")))
    end = F.last(F.when((F.col("_j") == size - 1) & F.col(x).isNotNull(), F.struct("_k", "_own")), ignorenulls=True).over(so_far)
    d = d.withColumn("_end", end)  # a block's last row sees its own end
    d = d.withColumn("_past", F.coalesce(F.lag("_end").over(by_key())["_own"], F.lit(0.0)))
    past = F.when(F.col("_k") > 0, F.col("_past") * F.pow(F.lit(r), F.col("_j") + 1)).otherwise(0.0)
    weight = (1 - F.pow(F.lit(r), F.col("_n"))) / (1 - r)
    return d.withColumn(out, F.when(F.col("_n") > 0, (F.col("_own") + past) / weight)).drop("_n", "_k", "_j", "_own", "_end", "_past")


def autocorrelation(df: DataFrame, x: str, lags: int) -> DataFrame:
    """Autocorrelation of every key at lags 0..n with its white-noise band."""
    w = by_key()
    d = df.withColumn("_c", F.col(x) - F.avg(x).over(Window.partitionBy("key")))
    for k in range(1, lags + 1):
        d = d.withColumn(f"_p{k}", F.col("_c") * F.lag("_c", k).over(w))
    d = d.withColumn("_p0", F.col("_c") * F.col("_c"))
    s = d.groupBy("key").agg(F.count("_c").alias("n"),
                             *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(lags + 1)])
    wide = s.select("key", "n", *[ratio(f"_s{k}", "_s0").alias(str(k)) for k in range(lags + 1)])
    out = wide.unpivot(["key", "n"], [str(k) for k in range(lags + 1)], "lag", "acf")
    return out.select("key", F.col("lag").cast("int").alias("lag"), "acf",
                      (1.96 / F.sqrt("n")).alias("band"))
