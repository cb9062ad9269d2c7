"""Joins of points with closed intervals of a table, as equality joins.

An interval is put on a grid whose step is the power of two at or above its length, so it
touches two cells at most, however long it is. A point looks once at each grid that occurs in the
table. Point and interval meet by (grid, cell), and the bounds decide. Neither a nested loop nor a
copy of an interval for each day it covers is needed; interval tables of any size are shuffled
on these keys, and one of checked size is broadcast.

Missing bounds are open: an interval without an end holds from its start on. Intervals that end before
they start hold nothing; points that are NULL are in none; rows of both sides may repeat.

Facts about the intervals that hold a point need no pairs if the facts of parts can be merged, as
counts and least values can: an interval is cut into the few dyadic cells that cover it, the facts are
taken by cell, before the shuffle, and a point merges the one cell of each level that it lies in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .frames import BROADCAST_ROWS

#: Stand for missing bounds, far outside of every calendar in microseconds.
FIRST, LAST = -(1 << 61), (1 << 61) - 1


def ordinal(c: Column, kind: T.DataType) -> Column:
    """Dates as days, timestamps as microseconds, integers as they are."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    raise TypeError(f"no points of type {kind.simpleString()}")


def grid_of(length: Column) -> Column:
    """Bits of the least power of two that is not below length + 1."""
    return F.when(length <= 0, 0).otherwise(F.length(F.bin(length))).cast("int")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """Each point with each interval that holds it, with the columns of both."""
    p, v = points.columns, intervals.columns
    lo, hi = (ordinal(F.col(c), intervals.schema[c].dataType) for c in (start, end))
    rows = intervals.select(F.struct(*v).alias("v"), F.coalesce(lo, F.lit(FIRST)).alias("lo"), F.coalesce(hi, F.lit(LAST)).alias("hi")).filter("lo <= hi")
    rows = written(rows.withColumn("grid", grid_of(F.col("hi") - F.col("lo"))))
    grids = sorted(r["grid"] for r in rows.select("grid").distinct().collect())  # 64 at most
    n = rows.count()
    near, far = F.expr("shiftright(lo, grid)"), F.expr("shiftright(hi, grid)")
    rows = rows.withColumn("cell", F.explode(F.array_distinct(F.array(near, far))))
    x = ordinal(F.col(at), points.schema[at].dataType)
    cells = points.select(F.struct(*p).alias("p"), x.alias("x")).filter("x IS NOT NULL")
    cells = cells.withColumn("grid", F.explode(F.array(*[F.lit(g) for g in grids]).cast("array<int>"))).withColumn("cell", F.expr("shiftright(x, grid)"))
    met = cells.join(F.broadcast(rows) if n <= most else rows, ["grid", "cell"]).filter("x BETWEEN lo AND hi")
    return met.select(*[F.col("p")[c].alias(c) for c in p], *[F.col("v")[c].alias(c) for c in v])


def _cover(lo: Column, hi: Column, levels: int) -> Column:
    """The disjoint dyadic cells (level, cell) that cover lo..hi, two of a level at most."""
    cells = []
    for g in range(levels):
        left, right = F.shiftright(lo + F.lit((1 << g) - 1), g), F.shiftright(hi + F.lit(1), g)  # right is not covered
        for end, cell in ((left, left), (right, right - F.lit(1))):
            held = (left < right) & (end.bitwiseAND(F.lit(1)) == 1)
            cells.append(F.when(held, F.struct(F.lit(g).alias("level"), cell.alias("cell"))))
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def _merged_by_point(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, facts: dict[str, Column],
                     merge: dict[str, Callable[[Column], Column]]) -> DataFrame:
    x = ordinal(F.col(at), points.schema[at].dataType)
    known = written(points.select(at).distinct().withColumn("_x", x).filter("_x IS NOT NULL"))
    span = known.agg(F.min("_x").alias("a"), F.max("_x").alias("b")).first()
    first, last = (0, 0) if span["a"] is None else (span["a"], span["b"])
    levels = max(1, (last - first + 1).bit_length())
    lo, hi = (ordinal(F.col(c), intervals.schema[c].dataType) for c in (start, end))
    held = intervals.withColumn("_lo", F.coalesce(lo, F.lit(FIRST))).withColumn("_hi", F.coalesce(hi, F.lit(LAST))).filter("_lo <= _hi")
    # positions from the first point on; what lies outside of the points is cut off
    held = held.withColumn("_lo", F.greatest("_lo", F.lit(first)) - F.lit(first)).withColumn("_hi", F.least("_hi", F.lit(last)) - F.lit(first)).filter("_lo <= _hi")
    held = held.withColumn("_c", F.explode(_cover(F.col("_lo"), F.col("_hi"), levels)))
    parts = held.groupBy(F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).agg(*[c.alias(n) for n, c in facts.items()])
    looks = known.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("_cell", F.expr(f"shiftright(_x - {first}L, _level)"))
    return looks.join(parts, ["_level", "_cell"]).groupBy(at).agg(*[merge[n](F.col(n)).alias(n) for n in facts])


def by_point(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, facts: dict[str, Column],
             merge: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Facts about the intervals that hold each distinct point: one row for each point that is in any.
    Points that are dates of a panel are looked up once for each date. ``merge`` says for each fact
    how the facts of disjoint sets of intervals combine, as counts do by ``F.sum``: then no pairs are made."""
    if merge is not None:
        return _merged_by_point(points, intervals, at, start, end, facts, merge)
    met = interval_join(points.select(at).distinct(), intervals, at, start, end)
    return met.groupBy(at).agg(*[c.alias(n) for n, c in facts.items()])
