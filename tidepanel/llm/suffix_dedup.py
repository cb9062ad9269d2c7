"""Exact substring dedup over a sparse suffix array.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier
in the corpus (a smaller id, or the same document further left). All texts count as
their UTF-8 bytes; matches end with the document.

1. Anchors. Of the 20-byte grams inside a window of 100 bytes the one with the least
   hash is the window's anchor. Equal windows have equal anchors at equal places, so
   only anchors whose gram occurs twice anywhere can lie in a repeated window. About
   one position in forty is an anchor.
2. Grams are counted by a grouped sum (combined before the shuffle), and the
   repeated ones go back to their documents by the document's key.
3. For each candidate the text around it that its windows span is sent to the
   partition of its gram. Equal contexts of one batch collapse first: the earliest
   is sent, the others are known to be repeats. A gram with more than ``HOT``
   occurrences is sent window by window to the partition of the window's own hash, so
   that a common passage does not meet in one task.
4. Each partition sorts the suffixes at its anchors, and the reversed texts before
   them, by the deep-shallow method: multikey quicksort on words of 8 bytes down to a
   shallow depth, then blind tries order the groups that still agree. With the common
   prefixes of neighbours both orders give, for each distance of a window's start
   to its anchor, the classes of equal windows; all but the earliest are repeats.
5. The repeats' byte ranges go back to their documents, are united and cut out.

Only real bytes decide (hashes only route), so the result is exact.

Defined cases: a NULL text is empty; documents with equal ids are ordered by their
text's digests; rows equal in id and text are one document, in whatever batches and
partitions they lie (their anchors collapse before the sort), and get equal results;
NULL ids come first; an empty table gives an empty result; other columns are left
out; long texts are worked on in pieces of ``PIECE`` windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import bucketed, written
from .base import digest2, parts_for

LENGTH, GRAM = 100, 20
SPAN = LENGTH - GRAM + 1  # grams of a window
SHALLOW = 3               # words of 8 bytes that the quicksort looks at
PIECE = 8_000_000
HOT = 50_000
ANCHORS_PER_TASK = 100_000
#: Documents of a bucket of the stored source, about, and the most buckets.
DOCUMENTS_PER_BUCKET, MOST_BUCKETS = 20_000, 20_000
_PLACE = np.uint64((1 << 24) - 1)
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def gram_hashes(x: np.ndarray) -> np.ndarray:
    h = (x.astype(np.uint64) + np.uint64(1)) * _M[0]
    h2 = h[:-1] * _M[1] + h[1:]
    h4 = h2[:-2] * _M[2] + h2[2:]
    h8 = h4[:-4] * _M[3] + h4[4:]
    h16 = h8[:-8] * _M[4] + h8[8:]
    g = h16[:-4] * _M[5] + h4[16:]
    g ^= g >> np.uint64(32)
    g *= _M[1]
    g ^= g >> np.uint64(29)
    return g


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window, gram hash) of each anchor."""
    out = []
    for lo in range(0, max(0, len(data) - LENGTH + 1), PIECE):
        x = np.frombuffer(data, np.uint8)[lo:lo + PIECE + LENGTH - 1]
        g = gram_hashes(x)
        m = g & ~_PLACE | np.arange(len(g), dtype=np.uint64)  # of equal hashes the left one
        for s in (1, 2, 4, 8, 16, 32):
            m = np.minimum(m[:-s], m[s:])
        m = np.minimum(m[:-(SPAN - 64)], m[SPAN - 64:])
        place = (m & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        last = np.r_[first[1:], len(place)] - 1
        at = place[first]
        out.append((at + lo, first + lo, last + lo, g[at].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out))


# --- deep-shallow sort -------------------------------------------------------

def blind_trie_order(strings: list[bytes], group: list[int]) -> list[int]:
    """Orders distinct strings by a blind trie: inner nodes keep only the place where
    their branches differ, a new string is compared with one leaf."""
    root = None  # a leaf is a number, a node is (place, {byte or -1: child})

    def char(s: bytes, at: int) -> int:
        return s[at] if at < len(s) else -1
    for k in group:
        s = strings[k]
        if root is None:
            root = k
            continue
        node = root
        while not isinstance(node, int):  # blind way down, to any leaf
            c = char(s, node[0])
            node = node[1][c] if c in node[1] else next(iter(node[1].values()))
        t = strings[node]
        common = _common(s, t)
        above, node = None, root
        while not isinstance(node, int) and node[0] < common:
            above, node = node, node[1][char(s, node[0])]
        if not isinstance(node, int) and node[0] == common:
            node[1][char(s, common)] = k
        else:
            new = (common, {char(s, common): k, char(t, common): node})
            if above is None:
                root = new
            else:
                above[1][char(s, above[0])] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack.extend(node[1][c] for c in sorted(node[1], reverse=True))
    return out


def _common(s: bytes, t: bytes) -> int:
    lo, hi = 0, min(len(s), len(t))
    while lo < hi:  # halving: slices are compared at once
        mid = (lo + hi + 1) // 2
        if s[lo:mid] == t[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def deep_shallow_order(strings: list[bytes]) -> np.ndarray:
    """Order of distinct strings."""
    if not strings:
        return np.zeros(0, np.int64)
    width = 8 * SHALLOW
    words = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(-1, SHALLOW).astype(np.uint64)
    out: list[int] = []
    stack: list[tuple[np.ndarray, int]] = [(np.arange(len(strings)), 0)]
    while stack:
        idx, depth = stack.pop()
        if len(idx) <= 1:
            out.extend(idx.tolist())
        elif depth == SHALLOW:
            out.extend(blind_trie_order(strings, idx.tolist()))
        else:
            w = words[idx, depth]
            pivot = np.partition(w[:: max(1, len(w) // 31)], len(w[:: max(1, len(w) // 31)]) // 2)[len(w[:: max(1, len(w) // 31)]) // 2]
            stack += [(idx[w > pivot], depth), (idx[w == pivot], depth + 1), (idx[w < pivot], depth)]
    return np.array(out, np.int64)


class Order:
    """Sorted distinct strings and the common prefixes of neighbours."""

    def __init__(self, strings: list[bytes]):
        known: dict[bytes, int] = {}
        number = np.fromiter((known.setdefault(s, len(known)) for s in strings), np.int64, len(strings))
        distinct = list(known)
        order = deep_shallow_order(distinct)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.place = place[number]  # of each string given
        text = np.frombuffer(b"".join(distinct[i].ljust(LENGTH, b"\0") for i in order), np.uint8).reshape(-1, LENGTH)
        size = np.fromiter((len(distinct[i]) for i in order), np.int64, len(order))
        self.common = np.zeros(len(order), np.int64)  # with the one before
        for lo in range(1, len(order), 20_000):
            hi = min(len(order), lo + 20_000)
            differ = np.c_[text[lo - 1:hi - 1] != text[lo:hi], np.ones(hi - lo, bool)]
            self.common[lo:hi] = np.minimum(differ.argmax(axis=1), np.minimum(size[lo - 1:hi - 1], size[lo:hi]))

    def classes(self, depth: int) -> np.ndarray:
        """A number for each string given; equal where the first bytes agree."""
        return np.cumsum(self.common < depth)[self.place]


def repeated_windows(contexts: list[bytes], most: np.ndarray, least: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """contexts: the bytes from the first window of an anchor, which begins ``most``
    bytes before it, to the end of the last, ``least`` bytes before it. Returns a
    matrix (anchor, distance) that marks the windows of which one ranks earlier."""
    right = Order([c[m:m + LENGTH] for c, m in zip(contexts, most)])
    left = Order([c[:m][::-1] for c, m in zip(contexts, most)])
    repeated = np.zeros((len(contexts), SPAN), bool)
    by_rank = np.argsort(rank, kind="stable")
    for d in range(SPAN):
        own = by_rank[(least[by_rank] <= d) & (d <= most[by_rank])]
        if len(own) > 1:
            key = right.classes(LENGTH - d)[own] * np.int64(len(contexts) + 1) + left.classes(d)[own]
            first = np.unique(key, return_index=True)[1]
            later = np.ones(len(own), bool)
            later[first] = False
            repeated[own[later], d] = True
    return repeated


def ranges_of(repeated: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, end) of the bytes that runs of repeated windows cover."""
    edge = np.diff(np.pad(repeated.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    who, near = np.nonzero(edge == 1)
    far = np.nonzero(edge == -1)[1] - 1
    return who, place[who] - far, place[who] - near + LENGTH


# --- Spark steps -------------------------------------------------------------

KEY = ["id", "k1", "k2"]
#: Stands for a NULL id in keys: it is ordered first.
LOWEST = -(1 << 63)


def _bytes(value) -> bytes:
    return (value.as_py() or "").encode("utf-8", "replace")


def _source(docs: DataFrame, id: str, text: str) -> DataFrame:
    """The documents, stored once and dealt by ``route``, so that both joins leave the texts in place."""
    k1, k2 = digest2(F.col(text))
    src = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(LOWEST)).alias("id"), k1.alias("k1"), k2.alias("k2"), F.col(id).isNull().alias("no_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    buckets = parts_for(docs.count(), DOCUMENTS_PER_BUCKET, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return bucketed(src.withColumn("route", F.xxhash64(*KEY)), "route", min(MOST_BUCKETS, buckets))


def candidates(src: DataFrame) -> DataFrame:
    """(route, grams, hot): the repeated grams of each document that has any."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            routes, grams, counts = [], [], []
            for route, t in zip(rb.column(0).to_numpy(), rb.column(1)):
                g, n = np.unique(anchors(_bytes(t))[3], return_counts=True)
                routes.append(np.full(len(g), route))
                grams.append(g)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (routes, grams, counts)], names=["route", "gram", "n"])
    # found once and stored, since they are both counted and joined with the counts
    grams = written(src.select("route", "text").mapInArrow(batches, "route long, gram long, n long"))
    # equal rows are one document, so a gram counts documents by their route
    repeated = grams.groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    mine = grams.join(repeated.select("gram", F.col("n").alias("all")), "gram")
    return mine.groupBy("route").agg(F.collect_list(F.struct("gram", (F.col("all") > HOT).alias("hot"))).alias("grams"), F.sum("n").alias("anchors"))


def contexts(src: DataFrame, found: DataFrame) -> DataFrame:
    """Rows for the sort (``context``) and, with no context, ranges that are known to
    be repeated because an equal context stands earlier in the batch."""
    joined = src.join(found, "route").select(*KEY, "text", F.col("grams.gram").alias("gram"), F.col("grams.hot").alias("hot"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            first: dict[tuple, tuple] = {}
            out: list[tuple] = []

            def offer(doc, place, begin, end, gram, context):
                """begin: of the first window; end: of the last window's bytes."""
                row, what = (*doc, place, begin, end), (gram, place - begin, context)
                held = first.get(what)
                if held is None:
                    first[what] = row
                elif row == held:
                    pass  # the same document once more
                else:
                    early, late = (held, row) if (held[:3], held[4]) < (row[:3], row[4]) else (row, held)
                    first[what] = early
                    out.append((None, *late, None))
            for k, i in enumerate(rb.column(0).to_pylist()):
                doc = (i, rb.column(1)[k].as_py(), rb.column(2)[k].as_py())
                data = _bytes(rb.column(3)[k])
                place, begin, last, gram = anchors(data)
                wanted, hot = rb.column(4)[k].values.to_numpy(), rb.column(5)[k].values.to_numpy(zero_copy_only=False)
                hits = np.flatnonzero(np.isin(gram, wanted))
                busy = np.isin(gram, wanted[hot]) if hot.any() else np.zeros(len(gram), bool)
                for h in hits.tolist():
                    if busy[h]:
                        for w in range(int(begin[h]), int(last[h]) + 1):
                            window = data[w:w + LENGTH]
                            offer(doc, w, w, w + LENGTH, int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little", signed=True), window)
                    else:
                        a, e = int(begin[h]), int(last[h]) + LENGTH
                        offer(doc, int(place[h]), a, e, int(gram[h]), data[a:e])
            out += [(gram, *row, context) for (gram, _, context), row in first.items()]
            cols = list(zip(*out)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "context" else pa.int64()) for c, n in zip(cols, names)], names=names)
    names = ["gram", *KEY, "place", "begin", "end", "context"]
    return joined.mapInArrow(batches, "gram long, id long, k1 long, k2 long, place long, begin long, end long, context binary")


def repeats(rows: DataFrame, tasks: int) -> DataFrame:
    """(id, k1, k2, start, end): byte ranges to remove."""
    names = [*KEY, "start", "end"]

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [rb for rb in batches if len(rb)]
        if not parts:
            return
        t = pa.Table.from_batches(parts)
        place, begin, end, k2, k1, id = (t[c].to_numpy() for c in ("place", "begin", "end", "k2", "k1", "id"))
        # rows equal in all of these are one anchor of one document, sent by several batches
        order = np.lexsort((end, begin, place, k2, k1, id))
        ordered = np.stack([c[order] for c in (id, k1, k2, place, begin, end)])
        once = order[np.r_[True, (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)]]
        place, begin, end, k2, k1, id = (c[once] for c in (place, begin, end, k2, k1, id))
        held = t["context"].take(pa.array(once)).to_pylist()
        marked = repeated_windows(held, place - begin, place - (end - LENGTH), np.arange(len(once)))
        who, start, stop = ranges_of(marked, place)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (id[who], k1[who], k2[who], start, stop)], names=names)
    known = rows.filter(F.col("context").isNull()).select(*KEY, F.col("begin").alias("start"), "end")
    sortable = rows.filter(F.col("context").isNotNull()).repartition(tasks, "gram")
    return sortable.mapInArrow(sort, "id long, k1 long, k2 long, start long, end long").unionByName(known)


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: id, n_bytes, n_removed, n_spans, spans (byte ranges removed) and
    the bytes kept."""
    src = _source(docs, id, text)
    found = written(candidates(src))
    total = found.agg(F.sum("anchors")).first()[0] or 0
    marked = repeats(contexts(src, found), parts_for(total, ANCHORS_PER_TASK, docs.sparkSession.sparkContext.defaultParallelism))
    ranges = written(marked.groupBy(F.xxhash64(*KEY).alias("route")).agg(F.collect_list(F.struct(*KEY, "start", "end")).alias("ranges")))
    joined = src.join(ranges, "route", "left").select(*KEY, "no_id", "text", "ranges")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            size, gone, spans, kept = [], [], [], []
            keys = zip(*(c.to_pylist() for c in rb.columns[:3]))
            for key, t, r in zip(keys, rb.column(4), rb.column(5).to_pylist()):
                data = _bytes(t)  # documents of one route are told apart by the key
                cut = united([(x["start"], x["end"]) for x in r or () if (x["id"], x["k1"], x["k2"]) == key])
                size.append(len(data))
                gone.append(sum(b - a for a, b in cut))
                spans.append([{"start": a, "end": b} for a, b in cut])
                edges = [0, *[e for c in cut for e in c], len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(rb.column(3), None, rb.column(0)), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])
    return joined.mapInArrow(batches, "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary")
