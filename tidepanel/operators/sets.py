"""Duplicates, common samples and entity splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio, rnd
from .frames import first_per
from .ranks import value_counts


def common_sample(long: DataFrame, value: str, methods: int) -> DataFrame:
    """Keys and dates usable in every method: one grouped count replaces a chain
    of joins."""
    ok = F.col(value).isNotNull() & ~F.coalesce(F.col("warmup"), F.lit(False))
    return (long.filter(ok).groupBy("key", "date", "method").agg(F.count(F.lit(1)).alias("_c"))
            .groupBy("key", "date").agg(F.count(F.lit(1)).alias("_m"))
            .filter(F.col("_m") == methods).select("key", "date"))


def jaccard_with_previous(members: DataFrame) -> DataFrame:
    """Overlap of each year's set with the year before."""
    sizes = members.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    prev = members.select((F.col("year") + 1).alias("year"), "company")
    both = members.join(prev, ["year", "company"], "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("both"))
    before = sizes.select((F.col("year") + 1).alias("year"), F.col("n").alias("n_prev"))
    d = sizes.join(before, "year").join(both, "year", "left").fillna(0, ["both"])
    return d.select("year", rnd(ratio("both", F.col("n") + F.col("n_prev") - F.col("both"))).alias("jaccard"))


def dedup_prefix(df: DataFrame, keys: list[str], text: str, order: list[str], columns: list[str], length: int = 100) -> DataFrame:
    """Keep the first of texts that agree on their lower-cased opening. Only the
    named columns and the opening travel, not the texts."""
    d = df.select(*keys, *order, *[c for c in columns if c not in (*keys, *order)], F.substring(F.lower(text), 1, length).alias("_p"))
    return first_per(d, [*keys, "_p"], order).select(*dict.fromkeys([*order, *columns]))


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of keys and duplicates; raises when a key occurs twice."""
    c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"))
    out = c.agg(F.count_if(F.col("_c") > 1).alias("duplicates"), F.count(F.lit(1)).alias("keys"))
    return out.withColumn("duplicates", F.when(F.col("duplicates") == 0, F.col("duplicates")).otherwise(
        F.raise_error(F.lit("duplicate keys")).cast("bigint")))


def alternating_halves(df: DataFrame, key: str = "key") -> DataFrame:
    """Every second entity in sorted order. Positions come from range-wise
    offsets, so no task sorts all entities."""
    ranked = value_counts(df.select(key).distinct(), [], key)
    return ranked.select(key, F.pmod("n_lt", F.lit(2)).cast("int").alias("half"))


def leave_one_out_means(df: DataFrame, group: str, x: str) -> DataFrame:
    """Train and test sizes and means with each group held out, from group sums."""
    s = df.groupBy(group).agg(F.sum(x).alias("s"), F.count(x).alias("c"))
    total = s.agg(F.struct(F.sum("s").alias("s"), F.sum("c").alias("c"))).scalar()
    d = s.withColumn("_t", total)
    n_train = F.col("_t.c") - F.col("c")
    return d.select(F.col(group).alias("fold"), n_train.alias("n_train"), F.col("c").alias("n_test"),
                    rnd(ratio(F.col("_t.s") - F.col("s"), n_train)).alias("train_mean"),
                    rnd(ratio("s", "c")).alias("test_mean"))


def holdout(df: DataFrame, fold_of, folds: int) -> DataFrame:
    """Tag rows with their test fold; training rows of a fold are all others."""
    return df.withColumn("fold", F.pmod(fold_of, F.lit(folds)))


