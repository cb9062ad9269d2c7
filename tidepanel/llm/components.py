"""Connected components of an edge table, by alternating star contractions.

Each round links larger neighbours, then smaller ones, to the smallest neighbour
known. Only grouped minima and joins on a node are used; a hub's minimum is formed
before the shuffle, and the join's hot key is split by adaptive execution. Each round
is written to the shared folder. Rounds grow with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs (u, v): links the neighbours v of u to the smallest of v and u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = pairs.join(least, "u").filter(F.col("v") > F.col("u") if larger else F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge
    to another one. NULL ends are ignored."""
    e = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True)
        e = written(_star(large, False))
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
