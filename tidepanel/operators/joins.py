"""Alignment joins: as-of, next event, next observation, named windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import attach, by_key, scan_last, scan_next


def month_of(date: str = "date") -> Column:
    """Order-preserving pieces for long keys."""
    return F.trunc(date, "month")


def in_windows(date: str | Column, windows: list[tuple[str, str]]) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    hits = [d.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in windows]
    return F.coalesce(reduce(lambda x, y: x | y, hits), F.lit(False))


def window_label(date: str, windows: dict[str, tuple[str, str]]) -> Column:
    """All labels whose window holds the date; exploded by the caller."""
    d = F.col(date)
    labels = [F.when(d.between(F.lit(a).cast("date"), F.lit(b).cast("date")), F.lit(k))
              for k, (a, b) in windows.items()]
    return F.array_compact(F.array(*labels))


def with_market(panel: DataFrame, market: DataFrame, how: str = "left") -> DataFrame:
    """Date-level facts onto every entity row; a hot date is spread by salt."""
    return attach(panel, market, ["date"], how)


def next_observation(df: DataFrame, value: str, out: str) -> DataFrame:
    """The key's next value moved onto the row it is predicted from, by shifting
    the date back one observation."""
    moved = df.select("key", F.lag("date").over(by_key()).alias("date"), F.col(value).alias(out))
    return moved.filter(F.col("date").isNotNull())


def asof(left: DataFrame, right: DataFrame, value: str, out: str) -> DataFrame:
    """Latest ``value`` of the key dated at or before each left row."""
    cols = left.columns
    l = left.withColumn("_side", F.lit(1)).withColumn("_in", F.lit(None).cast(right.schema[value].dataType))
    r = right.select("key", "date", F.col(value).alias("_in")).withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_piece", month_of())
    return (scan_last(both, ["key"], "_piece", ["date", "_side"], F.col("_in"), out)
            .filter("_side = 1").select(*cols, out))


def next_event(left: DataFrame, events: DataFrame, out: str = "next_event") -> DataFrame:
    """First event date of the key strictly after each left row."""
    cols = left.columns
    l = left.withColumn("_side", F.lit(1)).withColumn("_in", F.lit(None).cast("date"))
    r = events.select("key", "date").distinct().withColumn("_in", F.col("date")) \
        .withColumn("_side", F.lit(0))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_piece", month_of())
    return (scan_next(both, ["key"], "_piece", ["date", "_side"], F.col("_in"), out)
            .filter("_side = 1").select(*cols, out))


def event_flag(left: DataFrame, events: DataFrame, out: str = "is_event") -> DataFrame:
    days = events.select("key", "date").distinct().withColumn(out, F.lit(1))
    return left.join(days, ["key", "date"], "left").fillna(0, [out])


def uniform_filled(dates: DataFrame, membership: DataFrame, size: int) -> DataFrame:
    """Membership aligned to other dates; unknown dates get the uniform vector."""
    from ..functions.columns import normalized
    return (dates.select("date").distinct().join(membership, "date", "left")
            .select("date", normalized(F.col("pi"), size).alias("pi")))
