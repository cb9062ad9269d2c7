"""Writers. Each job writes in parallel; only summary tables become one file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> str:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return path


def write_summary_csv(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
    return path


def write_json_map(df: DataFrame, path: str) -> str:
    """(key, dow, value) as one JSON line {key: {dow: value}} per key."""
    per_key = (df.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.col("dow").cast("string").alias("k"), F.col("value").alias("v"))))).alias("m")))
    lines = per_key.select(F.to_json(F.create_map("key", "m")).alias("value"))
    lines.write.mode("errorifexists").text(path)
    return path


def check_artifacts(spark: SparkSession, outputs: dict[str, DataFrame]) -> DataFrame:
    """One row per expected output; raises if any of them is empty."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("artifact"), "rows")
             for name, df in outputs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("rows", F.when(F.col("rows") > 0, F.col("rows")).otherwise(
        F.raise_error(F.concat(F.lit("empty output: "), F.col("artifact"))).cast("bigint")))
