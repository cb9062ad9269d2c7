"""Merkle dataset manifest by sibling-shift self-joins.

Rows become leaves (SHA-256 of their length-prefixed fields). The leaves of a group are
numbered by an order column; at every level a node is equijoined with the nodes at its
computed sibling indices (index XOR 1 for two children a parent, the other slots of its
run otherwise), and the rows of slot zero emit the parents. A last, shorter run makes a
parent too. The tops of the groups, in the order of their names, make one more tree, whose
top is the root. All digests are text in lowercase hex when they are hashed again.

Proofs go down the tree in strides: the nodes of ``BLOCK`` leaves at most and the path from
their common ancestor to the root are one bounded group, so a row's whole proof costs one
shuffle for each stride and not one for each level. Every row is then folded from its leaf (or
from a claimed leaf, for a copy of the row that may have been tampered with) to a root.

Scale: numbering sorts digests by ranges, and equal keys are told apart by their place, so
a group of any size is spread over ranges; a level holds half the nodes of the one below; texts
never move. Every level is written to the shared folder.

Defined cases: a NULL field is ``-``, so it differs from an empty one; NULL group names come
first and are a group of their own; NULL order values come first; equal rows are leaves of
their own, next to each other, ties in order are broken by the leaf; a lone leaf is the top of
its group and a lone top is the root; an empty table has no rows and no root; columns that are
not named as fields are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.frames import attach
from ..session import measured, written
from .base import parts_for

#: Leaves of a range that one task numbers, about.
LEAVES_PER_RANGE = 500_000
#: Most leaves of a block whose proofs one group makes.
BLOCK = 4096


def field(c: Column) -> Column:
    """Byte count, colon and value, or a dash."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def hex_text(c: Column) -> Column:
    return F.lower(F.hex(c))


def numbered(leaves: DataFrame) -> DataFrame:
    """leaves (gk, o, h, ...): adds ``idx``, the place in the group by (o, h) from zero, and
    ``n``, the leaves of the group."""
    kept, rows = measured(leaves.withColumn("_u", F.monotonically_increasing_id()))
    keys = ["gk", "o", "h", "_u"]
    placed = written(kept.repartitionByRange(parts_for(rows, LEAVES_PER_RANGE), *keys).sortWithinPartitions(*keys)
                     .withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    starts = placed.groupBy("gk", "_p").agg(F.min("_m").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = "sum(_n) OVER (PARTITION BY gk ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = starts.select("gk", "_p", (F.coalesce(F.expr(before), F.lit(0)) - F.col("_first")).alias("_shift"),
                           F.expr("sum(_n) OVER (PARTITION BY gk)").alias("n"))
    out = attach(placed, starts, ["gk", "_p"], "inner").withColumn("idx", F.col("_m") + F.col("_shift"))
    return out.drop("_u", "_p", "_m", "_shift")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds ``sibs``, the digests of the others of each node's run in the order of their slots."""
    other = nodes.select(F.col("gk").alias("_gk"), F.col("idx").alias("_idx"), F.col("h").alias("_h"))
    if arity == 2:
        joined = nodes.join(other, (F.col("gk") == F.col("_gk")) & (F.col("idx").bitwiseXOR(F.lit(1)) == F.col("_idx")), "left")
        sibs = F.when(F.col("_h").isNull(), F.array().cast("array<binary>")).otherwise(F.array("_h"))
        return joined.withColumn("sibs", sibs).drop("_gk", "_idx", "_h")
    slot = F.col("idx") % arity
    shifts = F.transform(F.sequence(F.lit(1), F.lit(arity - 1)), lambda s: F.col("idx") - slot + (slot + s) % arity)
    wanted = nodes.select("gk", "idx", F.explode(shifts).alias("want"))
    found = wanted.join(other, (F.col("gk") == F.col("_gk")) & (F.col("want") == F.col("_idx"))).select("gk", "idx", "want", "_h")
    ranked = found.groupBy("gk", "idx").agg(F.sort_array(F.collect_list(F.struct("want", "_h"))).alias("s"))
    ranked = ranked.select(F.col("gk").alias("_gk"), F.col("idx").alias("_idx"), F.col("s._h").alias("s"))
    joined = nodes.join(ranked, (F.col("gk") == F.col("_gk")) & (F.col("idx") == F.col("_idx")), "left")
    return joined.withColumn("sibs", F.coalesce("s", F.array().cast("array<binary>"))).drop("_gk", "_idx", "s")


def tree(leaves: DataFrame, arity: int = 2) -> list[DataFrame]:
    """Levels of all groups' trees, leaves first: (gk, idx, n, h, sibs, ...), where ``n`` is the
    number of the group's nodes at that level. The row with n = 1 is the top of its group."""
    levels = [written(with_siblings(leaves, arity))]
    most = levels[0].agg(F.max("n")).first()[0] or 1  # nodes of the largest group at the last level
    while most > 1:
        most = -(-most // arity)
        run = levels[-1].filter((F.col("n") > 1) & (F.col("idx") % arity == 0))
        children = F.concat(F.array("h"), F.col("sibs"))  # slot zero: the others stand behind
        parents = run.select("gk", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
                             digest(F.array_join(F.transform(children, hex_text), "")).alias("h"))
        levels.append(written(with_siblings(parents, arity)))
    return levels


# --- proofs --------------------------------------------------------------------
# A path is kept as bytes: for each step from a node to the top, the slot, the number of
# siblings and their digests.

def step_bytes(slot: int, sibs: list[bytes]) -> bytes:
    return bytes((slot, len(sibs))) + b"".join(sibs)


def steps_of(path: bytes) -> Iterator[tuple[int, list[bytes]]]:
    at = 0
    while at < len(path):
        slot, n = path[at], path[at + 1]
        yield slot, [path[at + 2 + 32 * i:at + 34 + 32 * i] for i in range(n)]
        at += 2 + 32 * n


def proof_text(path: bytes) -> str:
    return "".join(s.hex() for _, sibs in steps_of(path) for s in sibs)


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    h = leaf
    for slot, sibs in steps_of(path):
        h = hashlib.sha256("".join(x.hex() for x in (*sibs[:slot], h, *sibs[slot:])).encode()).digest()
    return h


PATHS = "gk string, idx long, path binary, top binary"


def paths(levels: list[DataFrame], tops: DataFrame, arity: int = 2) -> DataFrame:
    """(gk, idx, path, top) for each leaf; ``tops`` has (gk, path, top), the path that leads
    on from the top of each group."""
    span = 1
    while arity ** (span + 1) <= BLOCK:
        span += 1
    place = [lv.withColumn("level", F.lit(i)) for i, lv in enumerate(levels)]
    ends = None
    for lv in place:
        end = lv.filter("n = 1").select("gk", "level")
        ends = end if ends is None else ends.unionByName(end)
    ends = written(ends.join(tops, "gk").select("gk", "path", "top", F.expr(f"level div {span}").alias("stride")))
    above = None
    for stride in reversed(range(-(-len(levels) // span))):
        up = ends.filter(F.col("stride") == stride).select("gk", F.lit(0).cast("long").alias("idx"), "path", "top")
        up = up if above is None else up.unionByName(above)
        rows = up.select("gk", F.col("idx").alias("block"), F.lit(-1).alias("depth"), "idx", F.lit(False).alias("step"), F.lit(None).cast("array<binary>").alias("sibs"), "path", "top")
        for i, lv in enumerate(place[stride * span:(stride + 1) * span]):
            depth = span - 1 - i  # upper levels come first
            rows = rows.unionByName(lv.select(
                "gk", F.expr(f"idx div {arity ** (depth + 1)}").alias("block"), F.lit(depth).alias("depth"), "idx", (F.col("n") > 1).alias("step"),
                "sibs", F.lit(None).cast("binary").alias("path"), F.lit(None).cast("binary").alias("top")))
        dealt = rows.repartition("gk", "block").sortWithinPartitions("gk", "block", "depth")
        above = written(dealt.mapInArrow(_descend(arity, span), PATHS))
    return above


def _descend(arity: int, span: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, upper, here, depth, top = None, {}, {}, None, None
        for rb in rows:
            out = []
            for gk, block, d, idx, step, sibs, path, t in zip(*(c.to_pylist() for c in rb.columns)):
                if (gk, block) != group:
                    group, upper, here, depth = (gk, block), {}, {}, None
                if d == -1:
                    start, top = path, t
                    continue
                if d != depth:
                    upper, here, depth = here, {}, d
                if step:  # the parent stands one level up, or is the ancestor of the block
                    path = step_bytes(idx % arity, sibs) + upper.get(idx // arity, start)
                else:
                    path = start
                here[idx] = path
                if d == span - 1:
                    out.append((gk, idx, path, top))
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.int64(), pa.binary(), pa.binary()))],
                                             names=["gk", "idx", "path", "top"])
    return batches


def manifest(docs: DataFrame, fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id",
             arity: int = 2, claims: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, path, proof_sha256, folded_root, verified), one row for each
    row of ``docs``; digests in lowercase hex. ``claims`` replaces fields of the copy of the
    row that is folded; without it every row verifies."""
    leaf = digest(*[field(F.col(f)) for f in fields])
    claimed = digest(*[field((claims or {}).get(f, F.col(f))) for f in fields])
    gk = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), F.col(group).cast("string")))
    rows = docs.select(gk.alias("gk"), F.col(order).alias("o"), leaf.alias("h"), claimed.alias("claim"))
    spark = docs.sparkSession
    levels = tree(numbered(rows), arity)
    tops = None
    for lv in levels:
        end = lv.filter("n = 1").select("gk", "h")
        tops = end if tops is None else tops.unionByName(end)
    tops = written(tops)
    over = tree(numbered(tops.select(F.lit("").alias("gk"), F.col("gk").alias("o"), "h")), arity)
    last = over[-1].select("h").first()
    root = bytes(last.h) if last else b""
    none = spark.createDataFrame([("", b"", root)], "gk string, path binary, top binary")
    led = paths(over, none, arity).join(over[0].select("idx", F.col("o").alias("name"), "h"), "idx")
    led = written(led.select(F.col("name").alias("gk"), "path", F.col("h").alias("top")))
    found = paths(levels, led, arity)
    own = levels[0].select(F.col("gk").alias("_gk"), F.col("idx").alias("_idx"), "o", "h", "claim")
    both = found.join(own, (F.col("gk") == F.col("_gk")) & (F.col("idx") == F.col("_idx"))).select("o", "h", "claim", "path", "top")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in parts:
            paths = rb.column(3).to_pylist()
            ends = [folded(c, p) for c, p in zip(rb.column(2).to_pylist(), paths)]
            proofs = [hashlib.sha256(proof_text(p).encode()).hexdigest() for p in paths]
            hexed = [[x.hex() for x in rb.column(c).to_pylist()] for c in (1, 4)]
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(hexed[0], pa.string()), pa.array(hexed[1], pa.string()), pa.array([root.hex()] * len(ends), pa.string()), rb.column(3),
                 pa.array(proofs, pa.string()), pa.array([e.hex() for e in ends], pa.string()), pa.array([e == root for e in ends], pa.bool_())],
                names=["id", "leaf", "subroot", "root", "path", "proof_sha256", "folded_root", "verified"])
    kind = docs.schema[order].dataType.simpleString()
    return both.mapInArrow(batches, f"id {kind}, leaf string, subroot string, root string, path binary, proof_sha256 string, folded_root string, verified boolean")
