"""Transforms fitted on one set of rows and applied to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, ratio
from .frames import attach, with_scalars
from .ranks import quantiles, value_counts


def cqr_score(df: DataFrame, y: str, lo: Column, hi: Column, least: float = 1e-8) -> DataFrame:
    """Distance outside a model's band in units of its half-width."""
    half = (hi - lo) / 2
    d = df.withColumn("band_lo", lo).withColumn("band_hi", hi).withColumn("halfwidth", half)
    s = F.greatest(F.col("band_lo") - F.col(y), F.col(y) - F.col("band_hi")) / F.col("halfwidth")
    return d.filter(F.col("halfwidth") > least).withColumn("s_cqr", s)


def qcut(df: DataFrame, x: str, bins: int, out: str) -> DataFrame:
    """Quantile bins, right-closed; repeated edges are dropped."""
    names = [f"q{i}" for i in range(1, bins)]
    edges = quantiles(df, [], x, [i / bins for i in range(1, bins)], names)
    e = edges.select(F.array_distinct(F.array(*names)).alias("e"))
    d = df.withColumn("_e", e.scalar())
    return d.withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("_e", lambda v: F.col(x) > v)))).drop("_e")


def winsorize(df: DataFrame, train: DataFrame, x: str, low: float, high: float) -> DataFrame:
    b = quantiles(train, [], x, [low, high], ["a", "b"])
    d = with_scalars(df, b, "_w")
    return d.withColumn(f"{x}_w", F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_w.a")), F.col("_w.b")))).drop("_w")


def iqr_flag(df: DataFrame, x: str, out: str = "outlier") -> DataFrame:
    q = quantiles(df, [], x, [0.25, 0.75], ["a", "b"])
    d = with_scalars(df, q, "_q")
    span = 1.5 * (F.col("_q.b") - F.col("_q.a"))
    return d.withColumn(out, (F.col(x) < F.col("_q.a") - span) | (F.col(x) > F.col("_q.b") + span)).drop("_q")


def standardize(df: DataFrame, train: DataFrame, columns: list[str], suffix: str = "_z") -> DataFrame:
    s = train.agg(*[F.avg(c).alias("m_" + c) for c in columns], *[F.stddev_pop(c).alias("s_" + c) for c in columns])
    d = with_scalars(df, s, "_s")
    for c in columns:
        d = d.withColumn(c + suffix, ratio(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}")))
    return d.drop("_s")


def train_cdf(df: DataFrame, train: DataFrame, x: str, out: str) -> DataFrame:
    """Share of training values at or below each value. Both sides are cut at
    the same range borders, so the as-of lookup is local to a range."""
    tagged = df.select(col(x).alias("_v")).distinct()
    tr = train.select(F.col(x).alias("_v"), F.lit(1).alias("_w"))
    both = tagged.withColumn("_w", F.lit(0)).unionByName(tr)
    known = value_counts(both.filter("_w = 1"), [], "_v").select("_v", (F.col("n_lt") + F.col("n_eq")).alias("_le"), F.col("n").alias("_n"))
    ranked = value_counts(tagged, [], "_v").select("_v", F.col("n_lt").alias("n_lt"), F.col("n").alias("n_all"))
    marks = ranked.join(known, "_v", "left").withColumn("le_all", F.col("n_lt") + 1)
    from .evaluate import _cumulative_max
    filled = _cumulative_max(marks, "_v", "_le")
    total = known.agg(F.max("_n").alias("v"))
    cdf = with_scalars(filled, total, "_t").select(F.col("_v").alias(x), (F.col("_le") / F.col("_t.v")).alias(out))
    return attach(df, cdf, [x])


def calendar_parts(df: DataFrame, date: str) -> DataFrame:
    d = F.col(date)
    return df.select("*", F.weekday(d).alias("dow"), F.month(d).alias("month"), F.quarter(d).alias("quarter"),
                     (F.weekday(d) == 0).alias("is_monday"), (F.weekday(d) == 4).alias("is_friday"),
                     (F.quarter(d) == 4).alias("is_q4"), (F.last_day(d) == d).alias("month_end"))


