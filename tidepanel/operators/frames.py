"""Frame helpers that keep every task bounded under skew.

Bounds used across the library
  * a panel holds one row per (key, date), so a partition by key has at most as
    many rows as the calendar has dates;
  * a market frame holds one row per date and is bounded by the calendar alone;
  * everything else (raw ticks, texts, cross-sections, whole tables) counts as
    unbounded: it is pre-aggregated, salted or split before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured

SALTS = 8
BUCKETS = 64
BROADCAST_ROWS = 100_000


def by_key(*order: str, key: str | list[str] = "key"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(*(order or ("date",)))


def calendar(*order: str):
    """Window over a whole market frame: one row per date, calendar-bounded."""
    return Window.partitionBy(F.lit(0)).orderBy(*(order or ("date",)))


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = SALTS,
           most: int = BROADCAST_ROWS, stored: bool = False) -> DataFrame:
    """Join per-group facts (one row per group) to rows whose groups may be hot.

    The facts are written once (unless ``stored`` already) and counted. Up to ``most`` rows they are broadcast,
    so the rows are not shuffled at all. Beyond that the rows of a group are spread
    over ``salts`` hash buckets and the facts are repeated that often, so no task
    receives a whole group. That is a merge join by hint: from the small files of many plain
    rows Spark would conclude that it can broadcast them, repeated, from the driver.
    """
    facts, n = (small, small.count()) if stored else measured(small)
    if n <= most:
        return big.join(F.broadcast(facts), on, how)
    plain = [c for c in big.columns if not big.schema[c].dataType.simpleString().startswith("map")]
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    right = facts.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    return left.join(right.hint("merge"), on + ["_salt"], how).drop("_salt")


def with_scalars(df: DataFrame, one_row: DataFrame, name: str = "_g") -> DataFrame:
    """Attach the columns of a one-row aggregate as a scalar subquery struct."""
    packed = one_row.select(F.struct(*one_row.columns).alias("s"))
    return df.withColumn(name, packed.scalar())


def melt(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, values, name, value)


def rows_of(df: DataFrame, items: list, name: str) -> DataFrame:
    """Repeat every row once per item of a short literal list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(i) for i in items])))


# --- ordered scans over unbounded keys -------------------------------------
# A key with a third of all rows cannot sit in one window partition. Rows are
# split into (key, bucket) pieces in order, each piece is scanned on its own, and
# one summary row per piece carries the state across the borders.

def scan_last(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str,
              include_current: bool = False) -> DataFrame:
    """Last non-NULL ``value`` before each row of its key (or up to it)."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_v", value)
    known = F.when(F.col("_v").isNotNull(), F.struct(*order))
    ends = d.groupBy(*keys, bucket).agg(F.max_by("_v", known).alias("_end"))
    carry = ends.select(*keys, bucket, F.last("_end", ignorenulls=True).over(w).alias("_v"), F.lit(0).alias("_row"))
    piece = Window.partitionBy(*keys, bucket).orderBy("_row", *order)
    frame = piece.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    return _scan(d, carry, F.last("_v", ignorenulls=True).over(frame), out)


def scan_next(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """First non-NULL ``value`` strictly after each row of its key."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(1, Window.unboundedFollowing)
    d = df.withColumn("_v", value)
    known = F.when(F.col("_v").isNotNull(), F.struct(*order))
    ends = d.groupBy(*keys, bucket).agg(F.min_by("_v", known).alias("_end"))
    carry = ends.select(*keys, bucket, F.first("_end", ignorenulls=True).over(w).alias("_v"), F.lit(2).alias("_row"))
    piece = Window.partitionBy(*keys, bucket).orderBy("_row", *order)
    return _scan(d, carry, F.first("_v", ignorenulls=True).over(piece.rowsBetween(1, Window.unboundedFollowing)), out)


def _scan(d, carry, value, out):
    """One pass over the pieces: the carried state of a piece is one extra row at
    its border, so the rows are shuffled once."""
    both = d.withColumn("_row", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    return both.withColumn(out, value).filter(F.col("_row") == 1).drop("_v", "_row")


def first_per(df: DataFrame, keys: list[str], order: list[str], prefix: str = "_r") -> DataFrame:
    """One row per key, the first by ``order``: an aggregate with map-side
    combine, so copies of a hot key collapse before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias(prefix))
    return best.select(*keys, *[F.col(f"{prefix}.{c}").alias(c) for c in rest]).select(*df.columns)
