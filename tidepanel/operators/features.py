"""Feature pipelines over panels, news rows and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.columns import cosine, ratio
from . import windows as W
from .frames import attach, by_key, rows_of, scan_last


def har(panel: DataFrame, x: str = "x") -> DataFrame:
    """Daily, weekly and monthly components."""
    return (panel.withColumn("rv_d", F.col(x)).withColumn("rv_w", W.full_mean(x, 5))
            .withColumn("rv_m", W.full_mean(x, 22)))


def har_extended(panel: DataFrame, x: str, signal: str, default: float, drop: int = 22) -> DataFrame:
    """Lagged means, squared lagged change, a forward-filled signal with its
    neutral default; the first rows of a key are dropped."""
    w = by_key()
    d = panel.withColumn("_r", F.col(x) - F.lag(x).over(w))
    filled = F.last(signal, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    d = (d.withColumn("lag_1", F.lag(x).over(w)).withColumn("mean_5", W.mean(x, 5, 1, 1))
         .withColumn("mean_22", W.mean(x, 22, 1, 1))
         .withColumn("sq_ret", F.pow(F.lag("_r").over(w), 2))
         .withColumn("signal", F.coalesce(filled, F.lit(default))).withColumn("_n", F.row_number().over(w)))
    return d.filter(F.col("_n") > drop).drop("_r", "_n")


def seasonal(panel: DataFrame, x: str, by: list[str]) -> DataFrame:
    """Median per (group, day of week). Works on a panel, so one group holds at
    most as many rows as the calendar has dates."""
    return (panel.withColumn("dow", F.weekday("date")).groupBy(*by, "dow")
            .agg(F.percentile(x, 0.5).alias("seasonal")))


def deseasonalize(panel: DataFrame, x: str, by: list[str]) -> DataFrame:
    d = panel.withColumn("dow", F.weekday("date"))
    d = attach(d, seasonal(panel, x, by), [*by, "dow"])
    d = d.withColumn("seasonal", F.coalesce("seasonal", x))
    return d.withColumn("excess", F.col(x) - F.col("seasonal"))


def retail_signals(series: DataFrame) -> DataFrame:
    """Per symbol: 5-day volatility, 5- and 20-day change, volume against its
    50-day mean; then one row per date with relative strength."""
    w = by_key()
    r = F.log(ratio(F.col("x"), F.lag("x").over(w)))
    d = series.withColumn("_r", r)
    d = (d.withColumn("vol5", W.std("_r", 5, 5) * 252 ** 0.5)
         .withColumn("ret5", ratio(F.col("x"), F.lag("x", 5).over(w)) - 1)
         .withColumn("ret20", ratio(F.col("x"), F.lag("x", 20).over(w)) - 1)
         .withColumn("rel_volume", ratio(F.col("qty"), W.mean("qty", 50, 10))))
    return d.drop("_r")


def retail_wide(signals: DataFrame, symbols: dict[str, str]) -> DataFrame:
    """One row per date: the signals of the named symbols side by side and the
    relative strength of the first against the last."""
    cols = []
    for name, key in symbols.items():
        for c in ("vol5", "ret5", "rel_volume"):
            cols.append(F.max(F.when(F.col("key") == key, F.col(c))).alias(f"{name}_{c}"))
    wide = signals.filter(F.col("key").isin(*symbols.values())).groupBy("date").agg(*cols)
    first, last = list(symbols)[0], list(symbols)[-1]
    return wide.withColumn("strength", F.col(f"{first}_ret5") - F.col(f"{last}_ret5"))


def hype(panel: DataFrame, price: str = "x", volume: str = "qty") -> DataFrame:
    """Volume shock times the absolute price acceleration, smoothed and scaled."""
    w = by_key()
    d = panel.withColumn("volume_shock", W.volume_shock(volume))
    d = d.withColumn("_d1", F.col(price) - F.lag(price).over(w))
    d = d.withColumn("price_acceleration", F.col("_d1") - F.lag("_d1").over(w))
    d = d.withColumn("hype_signal", F.col("volume_shock") * F.abs(F.coalesce("price_acceleration", F.lit(0.0))))
    for k in (3, 7):
        d = d.withColumn(f"hype_roll{k}", W.mean("hype_signal", k))
    return d.withColumn("hype_zscore", W.zscore("hype_signal")).drop("_d1")


def momentum(panel: DataFrame, x: str) -> DataFrame:
    """Lagged 5- and 10-observation means and 5-observation deviation."""
    return (panel.withColumn("mom_5", W.mean(x, 5, 1, 1)).withColumn("mom_10", W.mean(x, 10, 1, 1))
            .withColumn("mom_std", F.coalesce(W.std(x, 5, 2, 1), F.lit(0.0))))


def date_means(panel: DataFrame, columns: list[str], prefix: str = "mkt_") -> DataFrame:
    """Cross-sectional means joined back to every row."""
    m = panel.groupBy("date").agg(*[F.avg(c).alias(prefix + c) for c in columns])
    return attach(panel, m, ["date"])


def contagion(panel: DataFrame, x: str, sector: str) -> DataFrame:
    """Own value against the totals of its sector and of the market."""
    sec = panel.groupBy("date", sector).agg(F.sum(x).alias("sector_total"))
    mkt = sec.groupBy("date").agg(F.sum("sector_total").alias("market_total"))
    d = attach(panel, sec.join(mkt, "date"), ["date", sector])
    return (d.withColumn("sector_others", F.col("sector_total") - F.col(x))
            .withColumn("own_vs_sector", ratio(x, F.col("sector_total") + 1))
            .withColumn("own_vs_market", ratio(x, F.col("market_total") + 1)))


def news_daily(news: DataFrame, dims: int, cutoff: int | Column = 16, by: tuple[str, ...] = (),
               words: tuple = (tx.HIGH_SEVERITY, tx.MEDIUM_SEVERITY)) -> DataFrame:
    """Text rows (key, ts, text or shock, polarity, vec) to entity-days by effective
    date. Rows that already carry their score need no text, which keeps texts out of
    every shuffle. Vector means are plain column averages, combined map-side."""
    scored = news if "shock" in news.columns else news.withColumn("shock", tx.shock("text", *words))
    d = scored.withColumn("date", tx.effective_date("ts", cutoff)).withColumn("_h", F.hour(tx.eastern("ts")))
    aggs = [F.sum("shock").alias("shock_index"), F.avg("polarity").alias("sentiment_avg"), F.count(F.lit(1)).alias("news_count"),
            F.percentile("_h", 0.5).alias("median_hour")]
    if dims:
        aggs.append(F.array(*[F.avg(F.col("vec")[i].cast("double")) for i in range(dims)]).alias("vec"))
    return d.groupBy(*by, "key", "date").agg(*aggs)


def novelty(daily: DataFrame, vec: str = "vec") -> DataFrame:
    """Cosine distance of today's vector from the entity's previous one."""
    prev = F.lag(vec).over(by_key())
    known = prev.isNotNull() & ~F.exists(prev, lambda v: v.isNull()) & ~F.exists(F.col(vec), lambda v: v.isNull())
    return daily.withColumn("novelty", F.when(known, 1 - cosine(vec, prev)))


def previous_vector(df: DataFrame, key: str, order: str, vec: str, out: str, piece: int = 4096) -> DataFrame:
    """The key's previous vector in order; long keys are scanned in pieces."""
    d = df.withColumn("_piece", F.floor(F.col(order) / piece))
    return scan_last(d, [key], "_piece", [order], F.col(vec), out).drop("_piece")


def cutoff_sweep(news: DataFrame, hours: list[int]) -> DataFrame:
    """Daily features for every cutoff hour in one grouped job."""
    return news_daily(rows_of(news, hours, "cutoff"), 0, F.col("cutoff"), by=("cutoff",))


def assemble(base: DataFrame, groups: list[DataFrame], fill: dict[str, float]) -> DataFrame:
    """Left-join feature groups on (key, date): all joins share one partitioning.
    Columns keep their first position; repeated ones are dropped."""
    out = base
    for g in groups:
        fresh = [c for c in g.columns if c not in out.columns]
        out = out.join(g.select("key", "date", *fresh), ["key", "date"], "left")
    return out.fillna(fill)


def debt_to_equity(liabilities: Column, assets: Column) -> Column:
    return ratio(liabilities, assets - liabilities)
