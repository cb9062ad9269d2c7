"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are compared as lower-case words with single blanks between. An
item of m characters may differ in k = m * ``error_rate`` edits. It is cut into
k + 1 pieces; k edits leave at least one of them whole, so every match holds an
exact hit of a piece in its place. An Aho-Corasick automaton finds the hits of all
pieces of all items in one pass over a document, and Myers' bit-parallel distance
decides around each hit. Nothing is lost and no pair of document and item without
a hit is looked at.

The benchmark is a query set: it is taken in blocks of at most ``BLOCK_CHARS``
characters (one automaton each, sent to all executors), and each block is one pass
over all documents. Documents are never shuffled, so no key can be hot; a task
holds one Arrow batch.

Defined cases: NULL or wordless texts match nothing; an item with fewer than
``min_words`` words and fewer than ``MIN_CHARS`` normalised characters is common speech if it
is changed a little, so it is matched exactly, between the borders of words (a script without
blanks has few words, so its items are judged by their characters too); of one or two such
words nothing can be told, these match nothing (``left_out`` counts them);
equal items are all reported; equal documents get equal rows; empty tables on either
side give no match; offsets are code points of the original text, end exclusive;
other columns are carried along by ``clean_documents`` and never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 1_000_000
ERROR_RATE = 0.07
MIN_WORDS = 8
#: Items of fewer words, and fewer characters than ``MIN_CHARS``, are not looked for.
LEAST_WORDS = 3
#: Items of so many normalised characters are looked for, however few words they have.
MIN_CHARS = 40

WORDS = re.compile(r"[^\W_]+")


def normal(text: str | None) -> str:
    return " ".join(WORDS.findall(text or "")).lower()


def original_span(text: str, start: int, end: int) -> tuple[int, int]:
    """Place in the original text of the words that a normalised span touches."""
    at, first, last = 0, None, None
    for m in WORDS.finditer(text):
        n = len(m[0].lower())
        if at + n > start and at < end:
            first = m.start() if first is None else first
            last = m.end()
        at += n + 1
        if at >= end:
            break
    return (first or 0, last or 0)


def cuts(m: int, pieces: int) -> list[tuple[int, int]]:
    ends = [m * i // pieces for i in range(pieces + 1)]
    return list(zip(ends, ends[1:]))


class Myers:
    """Edit distance of a pattern to substrings of a text, one column a character;
    the whole pattern is one integer."""

    def __init__(self, pattern: str):
        self.m = len(pattern)
        self.mask = (1 << self.m) - 1
        self.masks: dict[str, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: str, k: int, anchored: bool = False) -> tuple[int, int] | None:
        """(distance, end) of the closest substring (the first of several), if its
        distance is k or less. ``anchored``: it must begin where the text does."""
        vp, vn, score, top, mask, get = self.mask, 0, self.m, 1 << self.m - 1, self.mask, self.masks.get
        low, found = k + 1, None
        if score < low:
            low, found = score, (score, 0)
        for at, c in enumerate(text, 1):
            eq = get(c, 0)
            d0 = (((eq & vp) + vp) ^ vp) | eq | vn
            hp = vn | ~(d0 | vp) & mask
            hn = vp & d0
            if hp & top:
                score += 1
            elif hn & top:
                score -= 1
            hp = (hp << 1 | anchored) & mask
            vp = (hn << 1 | ~(d0 | hp)) & mask
            vn = hp & d0
            if score < low:
                low, found = score, (score, at)
        return found


@dataclass
class Item:
    id: int
    text: str
    k: int
    whole: bool = False  # matches between the borders of words only

    def __post_init__(self):
        self.forward, self.backward = Myers(self.text), Myers(self.text[::-1])


class Matcher:
    """Finds all items of one block in a normalised text."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float, min_words: int = 0):
        self.items = [Item(i, t, 0, True) if short(t, min_words) else Item(i, t, int(len(t) * error_rate)) for i, t in items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, it in enumerate(self.items):
            for a, b in cuts(len(it.text), it.k + 1):
                owners.setdefault(it.text[a:b], []).append((n, a))
        self.keys = ahocorasick.Automaton()
        for piece, own in owners.items():
            self.keys.add_word(piece, (len(piece), own))
        if owners:
            self.keys.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end): for each item its closest place."""
        if not self.items or not text:
            return []
        places: dict[int, set[int]] = {}
        for end, (n, own) in self.keys.iter(text):
            for item, a in own:
                places.setdefault(item, set()).add(end + 1 - n - a)
        found = []
        for n, starts in places.items():
            if hit := self._closest(self.items[n], text, sorted(starts)):
                found.append((self.items[n].id, *hit))
        return found

    @staticmethod
    def _closest(it: Item, text: str, starts: list[int]) -> tuple[int, int, int] | None:
        m = len(it.text)
        for s in starts:
            if s >= 0 and text.startswith(it.text, s) and not (it.whole and (text[s - 1:s].strip() or text[s + m:s + m + 1].strip())):
                return 0, s, s + m
        if it.whole:
            return None
        best, lo = None, 0
        while lo < len(starts):
            hi = lo  # places closer than 2 k share a window
            while hi + 1 < len(starts) and starts[hi + 1] - starts[hi] <= 2 * it.k:
                hi += 1
            a = max(0, starts[lo] - it.k)
            window = text[a:starts[hi] + m + it.k]
            got = it.forward.best(window, it.k if best is None else best[0] - 1)
            if got:
                distance, end = got
                back = it.backward.best(window[:end][::-1], distance, True)
                best = (distance, a + end - back[1], a + end)
            lo = hi + 1
        return best


def short(t: str, min_words: int) -> bool:
    """Too short to be found with errors."""
    return t.count(" ") + 1 < min_words and len(t) < MIN_CHARS


def too_short(t: str, min_words: int) -> bool:
    return not t or short(t, min(min_words, LEAST_WORDS))


def left_out(benchmark: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> int:
    """The number of items that are too short to be looked for."""
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            yield pa.RecordBatch.from_arrays([pa.array([sum(too_short(normal(t.as_py()), min_words) for t in rb.column(0))], pa.int64())], names=["n"])
    return benchmark.select(F.col(text).alias("text")).mapInArrow(batches, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def blocks_of(benchmark: DataFrame, id: str, text: str, min_words: int, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The normalised items, block by block; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(id).cast("long"), F.col(text)).toLocalIterator():
        t = normal(row[1])
        if too_short(t, min_words):
            continue
        if block and size + len(t) > block_chars:
            yield block
            block, size = [], 0
        block.append((row[0], t))
        size += len(t)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
            error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, start, end) for each document and item that it
    holds within the item's error budget: one row for each, with its closest place (of
    equally close ones the first); further places of the same item have no row."""
    src = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = f"doc_id {src.schema['id'].dataType.simpleString()}, item_id long, distance long, start long, end long"
    spark, out = docs.sparkSession, None
    for block in blocks_of(benchmark, item_id, item_text, min_words, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def batches(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, min_words)
            for rb in rows:
                at, found = [], []
                for k, t in enumerate(rb.column(1)):
                    t = t.as_py() or ""
                    for item, distance, a, b in matcher.find(normal(t)):
                        at.append(k)
                        found.append((item, distance, *original_span(t, a, b)))
                cols = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(at, pa.int64())), *cols], names=["doc_id", "item_id", "distance", "start", "end"])
        part = src.mapInArrow(batches, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                    error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents without any match, with all their columns."""
    at = docs.columns.index(text)
    for block in blocks_of(benchmark, item_id, item_text, min_words, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def batches(rows: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, error_rate, min_words)
            for rb in rows:
                yield rb.filter(pa.array([not matcher.find(normal(t.as_py())) for t in rb.column(at)], pa.bool_()))
        docs = docs.mapInArrow(batches, docs.schema)
    return docs
