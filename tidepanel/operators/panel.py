"""Bars, realized measures, universes and market states."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from . import sliding
from .frames import attach, by_key, calendar

SESSION_OPEN, SESSION_CLOSE = 9 * 3600 + 30 * 60, 16 * 3600


def bars(ticks: DataFrame, width: str, order=("ts", "event_id")) -> DataFrame:
    """Ticks (key, ts, price) to bars. All aggregates combine map-side, so a hot
    key costs one row per bar in the shuffle."""
    o = F.struct(*order)
    return (ticks.groupBy("key", F.window("ts", width).start.alias("bar"))
            .agg(F.min_by("price", o).alias("open"), F.max("price").alias("high"),
                 F.min("price").alias("low"), F.max_by("price", o).alias("close"),
                 F.count(F.lit(1)).alias("n_trades")))


def realized_from_bars(bar: DataFrame, overnight: bool = True) -> DataFrame:
    """Sum of squared log returns per (key, day). The previous close is looked up
    inside the day; with ``overnight`` the first bar of a day takes the close of
    the key's previous day, which travels as one row per day."""
    d = bar.withColumn("date", F.to_date("bar"))
    w = Window.partitionBy("key", "date").orderBy("bar")
    d = d.withColumn("_prev", F.lag("close").over(w))
    if overnight:
        closes = d.groupBy("key", "date").agg(F.max_by("close", "bar").alias("_close"))
        closes = closes.select("key", "date", F.lag("_close").over(by_key()).alias("_carry"))
        d = attach(d, closes, ["key", "date"]).withColumn("_prev", F.coalesce("_prev", "_carry"))
    r = F.log(ratio("close", "_prev"))
    return (d.withColumn("_r", r).groupBy("key", "date")
            .agg(F.coalesce(F.sum(F.col("_r") * F.col("_r")), F.lit(0.0)).alias("rv"),
                 F.count("_r").alias("n_returns"))
            .withColumn("vol", F.sqrt("rv")).withColumn("vol_annual", F.sqrt("rv") * math.sqrt(252)))


def clean_ticks(ticks: DataFrame, width: str = "10 minutes", tolerance: float = 0.1,
                session: bool = True, open_s: int = SESSION_OPEN, close_s: int = SESSION_CLOSE
                ) -> DataFrame:
    """Keep session ticks with a positive price close to the local median of
    their (key, time window)."""
    d = ticks.filter(F.col("price") > 0)
    if session:
        second = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        d = d.filter((second >= open_s) & (second <= close_s))
    d = d.withColumn("_w", F.window("ts", width).start)
    # a (key, window) group is bounded by the ticks of one short time window
    med = d.groupBy("key", "_w").agg(F.percentile("price", 0.5).alias("_m"))
    near = F.abs(F.log(ratio("price", "_m"))) <= tolerance
    return attach(d, med, ["key", "_w"], "inner").filter(near).drop("_w", "_m")


def realized_measures(ticks: DataFrame, step: int = 300, offsets: tuple[int, ...] = (0,),
                      open_s: int = SESSION_OPEN, close_s: int = SESSION_CLOSE,
                      order=("ts", "event_id")) -> DataFrame:
    """Realized variance and bipower variation on a regular grid sampled by the
    last tick, averaged over the grid's offsets. Grid points without a new tick
    keep the previous price; the grid starts at the first tick of the day."""
    sec = (F.unix_micros("ts") - F.unix_micros(F.date_trunc("day", "ts"))) / 1e6
    shifted = (ticks.withColumn("date", F.to_date("ts")).withColumn("_s", sec)
               .filter((F.col("_s") >= open_s) & (F.col("_s") <= close_s))
               .withColumn("offset", F.explode(F.array(*[F.lit(o) for o in offsets])))
               .withColumn("slot", F.greatest(F.lit(0), F.ceil(
                   (F.col("_s") - open_s - F.col("offset")) / F.lit(float(step)))).cast("int")))
    n_slots = F.floor((F.lit(close_s - open_s) - F.col("offset")) / step)
    sampled = (shifted.filter(F.col("slot") <= n_slots).groupBy("key", "date", "offset", "slot")
               .agg(F.max_by("price", F.struct(*order)).alias("price")))
    # A repeated price adds a zero return, so only sampled points matter for the
    # sums; the number of returns counts every grid step after the first price.
    # Bipower pairs need adjacent steps: a pair around a stale point is zero.
    w = Window.partitionBy("key", "date", "offset").orderBy("slot")
    r = (sampled.withColumn("_p", F.lag("price").over(w)).withColumn("_sl", F.lag("slot").over(w))
         .withColumn("r", F.log(ratio("price", "_p"))))
    r = (r.withColumn("_rl", F.lag("r").over(w))
         .withColumn("_pair", F.when(F.col("slot") - F.col("_sl") == 1,
                                     F.abs("r") * F.abs("_rl")).otherwise(0.0)))
    per = (r.groupBy("key", "date", "offset")
           .agg(F.sum(F.col("r") * F.col("r")).alias("rv"),
                F.sum(F.coalesce("_pair", F.lit(0.0))).alias("bp"),
                (F.max(n_slots) - F.min("slot")).alias("n_returns")))
    return (per.groupBy("key", "date")
            .agg(F.avg("rv").alias("rv"), (F.avg("bp") * (math.pi / 2)).alias("bpv"),
                 F.max("n_returns").cast("bigint").alias("n_returns")))


def log_variance_target(daily: DataFrame, rv: str = "rv") -> DataFrame:
    """Next-day log variance, the previous value and trailing means."""
    w = by_key()
    return (daily.withColumn("next_day_rv", F.lead(rv).over(w))
            .withColumn("target_log_var", F.log(F.col("next_day_rv")))
            .withColumn("prev_day_rv", F.lag(rv).over(w))
            .withColumn("rv_5d_mean", F.avg(rv).over(w.rowsBetween(-4, 0)))
            .withColumn("rv_20d_mean", F.avg(rv).over(w.rowsBetween(-19, 0))))


def first_of_date(panel: DataFrame, *columns: str, by: str = "key") -> DataFrame:
    """One value per date, taken from the first key."""
    return panel.groupBy("date").agg(*[F.min_by(c, by).alias(c) for c in columns])


def cross_section(panel: DataFrame, x: str = "x") -> DataFrame:
    """Mean level per date and the dispersion, which enters one day late."""
    m = panel.groupBy("date").agg(F.avg(x).alias("level"), F.stddev_samp(x).alias("_sd"))
    return m.withColumn("dispersion", F.lag("_sd").over(calendar())).drop("_sd")


def trailing_rank(window, x: str, size: int, least: int) -> Column:
    """Average-tie percentile rank of the current value among the trailing
    ``size`` observations; NULL values are ignored and do not count. A column for
    short frames, which reads each frame again; ``sliding.rank`` does not."""
    frame = F.collect_list(x).over(window.rowsBetween(-(size - 1), 0))
    n = F.size(frame)
    below = F.size(F.filter(frame, lambda v: v < F.col(x)))
    same = F.size(F.filter(frame, lambda v: v == F.col(x)))
    return F.when(F.col(x).isNotNull() & (n >= least), (below + (same + 1) / 2.0) / n)


def market_state(panel: DataFrame, x: str = "x", window: int = 60, least: int = 20) -> DataFrame:
    """Level, dispersion and their trailing percentiles, one row per date."""
    return sliding.with_order_statistics(cross_section(panel, x), sliding.rank("level", "level_pctl", window, least),
                                         sliding.rank("dispersion", "disp_pctl", window, least), keys=[])


def stress_index(market: DataFrame, columns: list[str]) -> DataFrame:
    """Mean of the percentile columns that are present and not missing."""
    cols = [c for c in columns if c in market.columns]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    count = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return market.withColumn("stress_index", ratio(total, count))


def universe(classes: DataFrame, size: int) -> DataFrame:
    """Top companies per year from share classes (year, company, id, cap): the
    company is represented by its largest class and ranked by its total. A company
    list per year can be long, so it is ranked by value ranges, not in one task."""
    comp = classes.groupBy("year", "company").agg(
        F.max_by("id", F.struct("cap", -F.col("id"))).alias("id"), F.sum("cap").alias("cap"))
    w = Window.partitionBy("year").orderBy(F.desc("cap"), "company")
    pre = Window.partitionBy("year", F.pmod(F.hash("company"), F.lit(64))).orderBy(
        F.desc("cap"), "company")
    short = comp.withColumn("_r", F.row_number().over(pre)).filter(F.col("_r") <= size).drop("_r")
    return (short.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= size))


def turnover(members: DataFrame) -> DataFrame:
    """New members per year against the year before (first year left out)."""
    prev = members.select((F.col("year") + 1).alias("year"), "company")
    years = members.agg(F.min("year").alias("y0"))
    new = members.join(prev, ["year", "company"], "left_anti")
    all_years = members.select("year").distinct()
    n = new.groupBy("year").agg(F.count(F.lit(1)).alias("n_new"))
    return (all_years.join(n, "year", "left").withColumn("_y0", years.scalar())
            .filter(F.col("year") > F.col("_y0"))
            .select("year", F.coalesce("n_new", F.lit(0)).alias("n_new")))


def null_infinite(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, finite(c))
    return df
