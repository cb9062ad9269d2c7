"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most k bits are cut into (k + 2) // 2 segments, so
that one of them differs by one bit at most. Each segment is indexed once for each
of its bits with that bit as a wildcard; two fingerprints that agree on a segment
but for one bit share the variant with that wildcard, so an equality join on
variants finds every link. Links are verified on all bits.

Equal fingerprints collapse before the index is made, which removes groups of
copies. Variants with more fingerprints than ``BLOCK`` are cut into blocks, and
every pair of blocks is a group of its own, so no task holds an unbounded group and
no pair is lost. Inside a group a search over not yet reached fingerprints (numpy)
gives a spanning forest of the links, so the rows out are fewer than the rows in,
however many pairs there are.

Defined cases: NULL, empty and blank texts have fingerprint zero and are linked
like others; rows with equal ids share their component; NULL ids take part but
never name a component unless all ids of it are NULL; an empty table gives an empty
result; other columns are left out; words and shingles repeat as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .components import components

BITS = 64
#: Most fingerprints of a group that are compared with each other in one go.
BLOCK = 8192
SEED = 42


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= size:
        return np.array([h(line, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-size].tolist()]
    return np.array([h(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it."""
    votes = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), 4096):  # so the bits stay in the cache
        bits = np.unpackbits(hashes[lo:lo + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed long."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            fps = np.array([fingerprint(shingle_hashes(t.as_py(), size)) for t in rb.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(fps.view(np.int64))], names=["id", "fp"])
    src = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    return src.mapInArrow(batches, f"id {src.schema['id'].dataType.simpleString()}, fp long")


def segments(k: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    n = (k + 2) // 2
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fp: Column, k: int) -> Column:
    """One key for each segment and wildcard: the number of the wildcard and the
    segment's other bits."""
    keys = []
    for first, bits in segments(k):
        part = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1))
        for w in range(bits):
            rest = part.bitwiseAND(F.lit(~(1 << w) if w < 63 else (1 << 63) - 1))
            keys.append(F.struct(F.lit(first + w).cast("short").alias("v"), rest.alias("key")))
    return F.array(*keys)


def links(fps: DataFrame, k: int) -> DataFrame:
    """fps: one row per distinct fingerprint (fp, rep). Returns a spanning forest of
    all links, as pairs of reps (a, b)."""
    index = fps.select("fp", "rep", F.explode(variants(F.col("fp"), k)).alias("x")).select("fp", "rep", "x.v", "x.key")
    hot = written(index.groupBy("v", "key").count().filter(F.col("count") > BLOCK))
    if hot.isEmpty():
        dealt = index.withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:  # the i-th block of a hot variant meets each other block in a group (i, j)
        many = index.join(hot, ["v", "key"], "left").withColumn("n", F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int"))
        mine = F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
        dealt = (many.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
                 .withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other")))
    dealt = dealt.select(F.xxhash64("v", "key", "i", "j").alias("g"), "fp", "rep")
    groups = dealt.repartition("g").sortWithinPartitions("g")
    return groups.mapInArrow(_forest_batches(k), "a long, b long").distinct()


def _forest_batches(k: int):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flush(g, fp, rep):
            a, b = _forests(g, fp, rep, k)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        for rb in rows:
            g, fp, rep = (rb.column(i).to_numpy() for i in range(3))
            if held and held[-1][0][-1] == g[0]:  # the group goes on
                g, fp, rep = (np.concatenate([h[i] for h in held] + [x]) for i, x in enumerate((g, fp, rep)))
                held = []
            elif held:
                yield flush(*held[0])
                held = []
            cut = int(np.searchsorted(g, g[-1]))  # rows are in order of g
            if cut:
                yield flush(g[:cut], fp[:cut], rep[:cut])
            held = [(g[cut:], fp[cut:], rep[cut:])]
        if held:
            yield flush(*held[0])
    return batches


def _forests(g: np.ndarray, fp: np.ndarray, rep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of spanning forests of all groups. Groups of two are done at once."""
    fp = fp.view(np.uint64)
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    sizes = np.diff(np.r_[starts, len(g)])
    two = starts[sizes == 2]
    near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= k]
    a, b = [rep[near]], [rep[near + 1]]
    for s, n in zip(starts[sizes > 2], sizes[sizes > 2]):
        f, r = fp[s:s + n], rep[s:s + n]
        rest = np.arange(n)
        queue: list[int] = []
        while len(rest):
            if queue:
                at = queue.pop()
            else:
                at, rest = int(rest[0]), rest[1:]
            hit = np.bitwise_count(f[rest] ^ f[at]) <= k
            if hit.any():
                found = rest[hit]
                a.append(np.full(len(found), r[at]))
                b.append(r[found])
                queue.extend(found.tolist())
                rest = rest[~hit]
    a, b = np.concatenate(a), np.concatenate(b)
    return np.maximum(a, b), np.minimum(a, b)


def classes(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, k: int = 4) -> DataFrame:
    """(id, fp, component): ids are integers; the component is its smallest id."""
    prints = written(fingerprints(docs, id, text, size).withColumn("id", F.col("id").cast("long")))
    fps = written(prints.groupBy("fp").agg(F.min("id").alias("rep")))
    # a group with NULL ids only is represented by a number that no id has: none
    known = fps.filter(F.col("rep").isNotNull())
    found = components(links(known, k)).select(F.col("node").alias("rep"), "component")
    named = written(fps.join(found, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component")))
    return prints.join(named, "fp").select("id", "fp", "component")
