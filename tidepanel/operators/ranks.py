"""Exact ranks and quantiles of unbounded groups.

Ties are collapsed first: one row per distinct value with its count. The counted
rows are cut into pieces, ranges of the group and the value itself, as many as the
count asks for; the pieces' sums give each its offset. One piece needs none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import measured, written
from .frames import attach

#: Distinct values of a piece, which one task sorts.
PIECE_ROWS = 1_000_000


def value_counts(df: DataFrame, by: list[str], x: str, weight=None) -> DataFrame:
    """Distinct values with ``n_eq`` copies, ``n_lt`` smaller values and the group
    total ``n`` (NULL values are left out)."""
    c = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts, rows = measured(df.filter(F.col(x).isNotNull()).groupBy(*by, x).agg(c.alias("n_eq"))
                     .withColumn("_all", F.lit(0)))
    keys = [*by, "_all"]
    wk = Window.partitionBy(*keys)
    pieces = -(-rows // PIECE_ROWS)
    if pieces <= 1:  # one piece needs no offsets
        below = wk.orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
        return counts.select(*by, x, F.coalesce(F.sum("n_eq").over(below), F.lit(0)).alias("n_lt"), "n_eq",
                             F.sum("n_eq").over(wk).alias("n"))
    # pieces are ranges of the group and the value itself, of any type that sorts
    placed = written(counts.repartitionByRange(pieces, *keys, x).withColumn("_b", F.spark_partition_id()))
    sums = placed.groupBy(*keys, "_b").agg(F.sum("n_eq").alias("_nb"))
    run = wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_b").alias("_o_b"), F.coalesce(F.sum("_nb").over(run), F.lit(0)).alias("_off"),
                          F.sum("_nb").over(wk).alias("n"))
    local = Window.partitionBy(*keys, "_b").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_in", F.coalesce(F.sum("n_eq").over(local), F.lit(0)))
    same = F.col("_b") == F.col("_o_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return ranked.join(offsets, same).select(*by, x, (F.col("_off") + F.col("_in")).alias("n_lt"), "n_eq", "n")


def quantiles(df: DataFrame, by: list[str], x: str, probs: list[float],
              names: list[str]) -> DataFrame:
    """Linearly interpolated quantiles, one row per group."""
    ranked = value_counts(df.select(*by, F.col(x).alias("_x")), by, "_x")
    cols = []
    for p, name in zip(probs, names):
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)

        def at(k):
            return F.max(F.when((F.col("n_lt") <= k) & (k < F.col("n_lt") + F.col("n_eq")),
                                F.col("_x").cast("double")))
        frac = F.max(pos - lo)
        cols += [at(lo).alias(f"_l_{name}"), at(hi).alias(f"_h_{name}"), frac.alias(f"_f_{name}")]
    agg = ranked.groupBy(*by).agg(*cols)
    return agg.select(*by, *[
        (F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in names])


def with_rank(df: DataFrame, by: list[str], x: str, out: str = "rank") -> DataFrame:
    """Average-tie rank from 1, plus the group size in ``<out>_n``."""
    plain = df.select(*by, F.col(x).alias("_x"))
    ranked = value_counts(plain, by, "_x").select(
        *by, F.col("_x").alias(x), (F.col("n_lt") + (F.col("n_eq") + 1) / 2.0).alias(out), F.col("n").alias(out + "_n"))
    return attach(df, ranked, [*by, x])
