"""Keeps one document of each group of near copies, on top of the SimHash index.

1. Equal texts collapse by a 128-bit digest.
2. A fingerprint of each text's distinct words finds candidates: fingerprints
   that are linked over deletion variants at ``k`` or fewer bits. Distinct
   words change less under small edits than shingles do, so few bits suffice.
3. Pairs at the similarity that lie beyond ``k`` bits are found by an exact prefix filter: each
   text is also linked with the first text that shares one of its rarest shingles. Texts linked
   over either index form classes.
4. Inside each class the exact Jaccard similarity of the sets of five-word shingles
   decides. A class is cut into blocks of about ``BLOCK_SHINGLES`` shingles, each pair of
   blocks is one group, and a search over not yet reached documents gives a spanning
   forest of the links, not all pairs.
5. Documents that are linked, over any number of steps, are a group; the one with the
   smallest id stays.

No pair at the similarity or above is left out. Copies that were edited more fall below it and
stay: one changed word takes five shingles, so a text of random single-word edits is caught up
to about one edit in 45 words (1 - 5/45 of the shingles of both sides, 0.8 of their union).

Defined cases: NULL, empty and blank texts have no shingles: equal ones are copies of
each other, others are never similar; rows equal in id and text leave one row; NULL
ids lose to others with the same text and are not linked otherwise; documents that
share an id are one node: they stay or go together if they are linked; an empty
table stays empty; all columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .base import digest2, parts_for
from .components import components
from .simhash import fingerprint, links, shingle_hashes

BLOCK_SHINGLES = 400_000
#: Shingles that a task of the prefix filter holds, about.
SHINGLES_PER_TASK = 1_000_000


def word_prints(src: DataFrame) -> DataFrame:
    """(id, k1, k2, fp, words) with the fingerprint of the set of words, and their number."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            words = [shingle_hashes(t.as_py(), 1) for t in rb.column(3)]
            fps = np.array([fingerprint(np.unique(w)) for w in words], np.uint64)
            yield pa.RecordBatch.from_arrays([*rb.columns[:3], pa.array(fps.view(np.int64)), pa.array([len(w) for w in words], pa.int64())],
                                             names=["id", "k1", "k2", "fp", "words"])
    return src.select("id", "k1", "k2", "text").mapInArrow(batches, "id long, k1 long, k2 long, fp long, words long")


PACKED = "bucket int, a binary, b binary, c binary, d binary"


def _packed(by: np.ndarray, buckets: int, *cols: np.ndarray) -> pa.RecordBatch:
    """One row per bucket that holds the values of the columns as bytes."""
    bucket = (by % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    names, starts = np.unique(bucket[order], return_index=True)
    ends = [*starts[1:].tolist(), len(order)]
    out = [pa.array([c[a:b].tobytes() for a, b in zip(starts.tolist(), ends)], pa.binary()) for c in (x[order] for x in cols)]
    out += [pa.array([b""] * len(names), pa.binary())] * (4 - len(out))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), *out], names=["bucket", "a", "b", "c", "d"])


def _unpacked(rows: Iterator[pa.RecordBatch], *types: str) -> list[np.ndarray]:
    parts = [[] for _ in types]
    for rb in rows:
        for held, c in zip(parts, rb.columns[1:]):
            held.append(b"".join(c.to_pylist()))
    return [np.frombuffer(b"".join(p), t) for p, t in zip(parts, types)]


def prefix_shingles(hashes: np.ndarray, similarity: float) -> tuple[np.ndarray, int]:
    """The distinct shingles that can be in the prefix of a set, and how many of those that
    occur in other texts may stay out of it: the half that is counted comes first in the
    order, and if it is shorter than the prefix, the least others follow."""
    own = np.unique(hashes)
    need = len(own) - int(np.ceil(similarity * len(own) - 1e-6)) + 1 if len(own) else 0
    counted = (own & np.uint64(1)) == 0
    half = own[counted]
    if len(half) >= need:
        return half, len(half) - need
    return np.concatenate([half, own[~counted][:need - len(half)]]), 0


def prefix_keys(src: DataFrame, words: int, size: int, similarity: float) -> DataFrame:
    """(key, k1): the shingles in the prefix of each text that lie in another text as well.
    Shingles are dealt by their hash to be counted, the repeated ones by their text to be put in
    order; both travel as packed bytes. Equal ``k1`` of two texts only add keys."""
    tasks = parts_for(words // 2, SHINGLES_PER_TASK, src.sparkSession.sparkContext.defaultParallelism)

    def emitted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            texts = dict(zip(zip(rb.column(0).to_pylist(), rb.column(1).to_pylist()), rb.column(2)))  # copies collapse
            found = [prefix_shingles(shingle_hashes(t.as_py(), size), similarity) for t in texts.values()]
            n = [len(h) for h, _ in found]
            k1s = np.fromiter((k for k, _ in texts), np.int64, len(n))
            if sum(n):
                h = np.concatenate([h for h, _ in found])
                yield _packed(h >> np.uint64(1), tasks, h, np.repeat(k1s, n), np.repeat(np.array([s for _, s in found], np.int32), n))

    def counted(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, k1, spare = _unpacked(rows, "<u8", "<i8", "<i4")
        order = np.lexsort((spare, k1, h))
        h, k1, spare = h[order], k1[order], spare[order]
        once = np.r_[True, (h[1:] != h[:-1]) | (k1[1:] != k1[:-1])][:len(h)]  # a text counts once
        h, k1, spare = h[once], k1[once], spare[once]
        starts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]][:len(h)])
        n = np.diff(np.r_[starts, len(h)])
        n = np.repeat(n, n)
        many = n > 1
        if many.any():
            yield _packed(k1[many].view(np.uint64), tasks, h[many], k1[many], spare[many], n[many].astype(np.int64))

    def chosen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, k1, spare, n = _unpacked(rows, "<u8", "<i8", "<i4", "<i8")
        if not len(h):
            return
        # shingles beyond the counted half stand last
        order = np.lexsort((h, n, h & np.uint64(1), k1))
        h, k1, spare = h[order], k1[order], spare[order]
        starts = np.flatnonzero(np.r_[True, k1[1:] != k1[:-1]])
        sizes = np.diff(np.r_[starts, len(k1)])
        place = np.arange(len(k1)) - np.repeat(starts, sizes)
        mine = place < np.repeat(sizes, sizes) - spare
        h, k1 = h[mine].view(np.int64), k1[mine]
        for lo in range(0, len(h), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(h[lo:lo + 100_000]), pa.array(k1[lo:lo + 100_000])], names=["key", "k1"])
    dealt = src.filter("id IS NOT NULL").select("k1", "k2", "text").mapInArrow(emitted, PACKED).repartition(tasks, "bucket")
    return dealt.mapInArrow(counted, PACKED).repartition(tasks, "bucket").mapInArrow(chosen, "key long, k1 long")


def prefix_links(keys: DataFrame, known: DataFrame) -> DataFrame:
    """(a, b): links every text with the least id that has one of its keys."""
    mine = written(keys.join(known.select("k1", "rep"), "k1").select("key", "rep").distinct())
    least = mine.groupBy("key").agg(F.min("rep").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return mine.join(least, "key").filter("rep <> b").select(F.col("rep").alias("a"), "b").distinct()


def shingle_sets(src: DataFrame, size: int) -> DataFrame:
    """(class, id, n, shingles): sorted distinct 64-bit shingle hashes as bytes."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            sets = [np.unique(shingle_hashes(t.as_py(), size)) for t in rb.column(2)]
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["class", "id", "n", "shingles"])
    return src.select("class", "id", "text").mapInArrow(batches, "class long, id long, n long, shingles binary")


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all pairs at or above the similarity."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, code = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.r_[0, np.cumsum(sizes)]
    edges, rest, queue = [], sizes > 0, []
    present = np.zeros(len(values), bool)
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start] = False
        queue.append(start)
        while queue:
            at = queue.pop()
            mine = code[first[at]:first[at + 1]]
            present[mine] = True
            common = np.bincount(owner[present[code]], minlength=len(sets))
            present[mine] = False
            hit = np.flatnonzero(rest & (common >= similarity * (sizes + sizes[at] - common) - 1e-9))
            rest[hit] = False
            queue.extend(hit.tolist())
            edges += [(int(ids[at]), int(ids[h])) for h in hit]
    return edges


def similar_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): a spanning forest of the links inside each class."""
    totals = sets.groupBy("class").agg(F.sum("n").alias("total"))
    cut = sets.join(totals, "class").withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = cut.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(F.xxhash64("class", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), "id", "shingles")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, ids, sets = None, [], []

        def flush():
            edges = similar_forest(np.array(ids), sets, similarity) if len(ids) > 1 else []
            a, b = zip(*edges) if edges else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        for rb in rows:
            for g, i, s in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                if g != group:
                    if len(ids) > 1:
                        yield flush()
                    group, ids, sets = g, [], []
                ids.append(i)
                sets.append(np.frombuffer(s, "<u8"))
        if len(ids) > 1:
            yield flush()
    return dealt.repartition("g").sortWithinPartitions("g").mapInArrow(batches, "a long, b long").distinct()


def _same(*keys: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return cond


def _named(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_{c}") for c in df.columns])


def losers(docs: DataFrame, id: str, text: str, size: int, similarity: float, k: int) -> tuple[DataFrame, DataFrame]:
    """Keys (id, k1, k2) of the documents to remove, and keys of repeated rows."""
    k1, k2 = digest2(F.col(text))
    src = docs.select(F.col(id).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(text).alias("text"))
    prints = written(word_prints(src))
    texts = written(prints.groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.min("fp").alias("fp"), F.min("words").alias("words"), F.count(F.lit(1)).alias("n")))
    known = texts.filter(F.col("rep").isNotNull())
    # one row per distinct fingerprint; those of several texts are a class as well
    fps = written(known.groupBy("fp").agg(F.min("rep").alias("rep"), F.count(F.lit(1)).alias("n")))
    equal = known.select("fp", F.col("rep").alias("a")).join(fps.filter("n > 1").select("fp", F.col("rep").alias("b")), "fp").select("a", "b")
    words = known.agg(F.sum("words")).first()[0] or 0
    keyed = prefix_links(prefix_keys(src, words, size, similarity), known)
    named = components(links(fps.select("fp", "rep"), k).unionByName(equal).unionByName(keyed)).select(F.col("node").alias("rep"), F.col("component").alias("class"))
    members = written(known.join(named, "rep").select(F.col("rep").alias("id"), "k1", "k2", "class"))
    inside = src.join(_named(members).hint("merge"), _same("id", "k1", "k2")).select("id", F.col("_class").alias("class"), "text")
    sets = written(shingle_sets(inside, size).dropDuplicates(["class", "id", "shingles"]))
    groups = components(similar_links(sets, similarity)).filter("node <> component").select(F.col("node").alias("rep"), F.lit(True).alias("lost"))
    decided = written(texts.join(groups, "rep", "left").filter("n > 1 OR lost").select("k1", "k2", "rep", F.coalesce("lost", F.lit(False)).alias("lost")))
    gone = prints.join(_named(decided), _same("k1", "k2")).filter(F.col("_lost") | ~F.col("id").eqNullSafe(F.col("_rep")))
    twice = prints.join(_named(texts.filter("n > 1").select("k1", "k2")), _same("k1", "k2")).groupBy("id", "k1", "k2").count().filter("count > 1")
    return written(gone.select("id", "k1", "k2").distinct()), written(twice.select("id", "k1", "k2"))


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, k: int = 7) -> DataFrame:
    """The documents that stay, with all their columns. They are dealt by their key
    and meet the keys that go there, at every size alike."""
    gone, twice = losers(docs, id, text, size, similarity, k)
    k1, k2 = digest2(F.col(text))
    packed = docs.select(F.struct("*").alias("row"), F.col(id).cast("long").alias("id"), k1.alias("k1"), k2.alias("k2"))
    kept = packed.join(_named(gone).hint("merge"), _same("id", "k1", "k2"), "left_anti")
    if not twice.isEmpty():
        once = kept.join(_named(twice), _same("id", "k1", "k2"), "left_anti")
        many = kept.join(_named(twice), _same("id", "k1", "k2"), "left_semi").dropDuplicates(["id", "k1", "k2"])
        kept = once.unionByName(many)
    return kept.select("row.*")
