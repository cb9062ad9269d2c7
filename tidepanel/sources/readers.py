"""Readers for landed files. Filters and column choices stay declarative so they
reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def columns_by_file(spark: SparkSession, pattern: str, columns: list[str]) -> DataFrame:
    """Chosen columns of many files, keyed by the file's stem."""
    df = spark.read.parquet(pattern)
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"(\.c\d+)?\.[^.]*$", "")
    return df.select(stem.alias("file_key"), *columns)


def csv_aliased(spark: SparkSession, path: str, names: dict[str, list[str]]) -> DataFrame:
    """CSV whose columns carry alternative names: the first present one is taken."""
    raw = spark.read.csv(path, header=True)
    lower = {c.lower(): c for c in raw.columns}
    picks = []
    for target, options in names.items():
        found = [lower[o] for o in options if o in lower]
        picks.append((F.coalesce(*[F.col(f"`{c}`") for c in found]) if found
                      else F.lit(None).cast("string")).alias(target))
    return raw.select(*picks)


def json_map(spark: SparkSession, path: str) -> DataFrame:
    """Nested map {key: {"0": value, ...}} as rows (key, dow, value)."""
    schema = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    return (spark.read.text(path).select(F.from_json("value", schema).alias("m"))
            .select(F.explode("m").alias("key", "days"))
            .select("key", F.explode("days").alias("dow", "value"))
            .select("key", F.col("dow").cast("int").alias("dow"), "value"))


def landed(df: DataFrame, **equal) -> DataFrame:
    """Re-apply every filter the remote service was asked for."""
    for name, value in equal.items():
        df = df.filter(F.col(name).isin(value) if isinstance(value, (list, tuple))
                       else F.col(name) == value)
    return df
