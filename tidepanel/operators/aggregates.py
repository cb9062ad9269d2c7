"""Grouped reports. Every aggregate here combines map-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def weighted_mean(x: str, w: str) -> Column:
    ok = F.col(x).isNotNull()
    return F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(F.when(ok, F.col(w).cast("double"))))


def share(cond: Column) -> Column:
    return F.avg(cond.cast("double"))


def null_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    wide = df.agg(*[share(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "null_share")


def sliced(df: DataFrame, slices: dict[str, Column], label: str = "slice") -> DataFrame:
    """Rows repeated once per matching, possibly overlapping, slice; the grouped
    metrics of all slices then take one pass."""
    labels = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in slices.items()]))
    return df.withColumn(label, F.explode(labels))


def with_overall(df: DataFrame, by: str, aggs: list[Column], name: str = "marginal") -> DataFrame:
    """Grouped table plus the overall row."""
    return (df.withColumn(by, F.col(by).cast("string")).rollup(by)
            .agg(F.grouping(by).alias("_g"), *aggs)
            .withColumn(by, F.when(F.col("_g") == 1, F.lit(name)).otherwise(F.col(by)))
            .drop("_g"))


def crosstab_shares(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    wide = df.groupBy(a).agg(*[F.sum((F.col(b) == v).cast("bigint")).alias(v) for v in values])
    total = reduce(lambda x, y: x + y, [F.col(v) for v in values])
    return wide.select(a, *[ratio(F.col(v), total).alias(v) for v in values])


def funnel(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Row counts after each stage, conditions applied one after the other."""
    aggs, cond = [], F.lit(True)
    for name, c in stages.items():
        cond = cond & F.coalesce(c, F.lit(False))
        aggs.append(F.sum(cond.cast("bigint")).alias(name))
    wide = df.agg(*aggs)
    order = F.create_map(*[x for i, s in enumerate(stages) for x in (F.lit(s), F.lit(i))])
    return wide.unpivot([], list(stages), "stage", "n").withColumn("step", order[F.col("stage")])
