"""Helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

# The white space of the word pattern, as a character class.
SPACE = "\\x20\\x09-\\x0D"
WORD_CHAR = f"[^{SPACE}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def digest2(*cols: Column) -> list[Column]:
    """Two independent 64-bit digests: 128 bits that group as plain longs."""
    return [F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Words as an array; NULL and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def parts_for(rows: int, per_part: int, least: int = 1) -> int:
    """Partitions that hold about ``per_part`` rows each; grows with the data."""
    return max(least, -(-int(rows) // per_part))


def free(df: DataFrame, name: str) -> str:
    """The name, with underscores at its end if the table has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
