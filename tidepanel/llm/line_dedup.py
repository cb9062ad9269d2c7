"""Substring dedup by line or paragraph hashing.

Units (lines, or paragraphs at blank lines) are normalised (A-Z lowered, white space
runs to one blank, trimmed) and hashed to 128 bits. Globally, the occurrence of a
digest that ranks first (smallest id, then text digest, then place) is kept; all
others are removed, with their original offsets. Blank units are never removed; a floor
of ``min_words`` words for the others is an option.

The first occurrence of a digest is a grouped minimum, which combines before the
shuffle, so a line that a third of all documents share is one row per task. The
occurrences that won go back to their documents by the document's key, and no join
on a hot digest is needed: what a document did not win, it loses.

Defined cases: a NULL text has no units and stays NULL; rows equal in id and text are
one document and keep the same units; NULL ids rank first; an empty table gives an
empty result; all columns of the input are kept, whatever their names: a new column whose
name is taken gets an underscore at its end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import digest2, free

MIN_WORDS = 1


def units(text: str, separator: str, min_words: int) -> Iterator[tuple[int, int, bytes | None]]:
    """(start, end, digest) of each unit; no digest if it is too short."""
    at = 0
    for part in text.split(separator):
        words = part.encode("utf-8", "replace").lower().split()
        sha = hashlib.blake2b(b" ".join(words), digest_size=16).digest() if len(words) >= min_words and words else None
        yield at, at + len(part), sha
        at += len(part) + len(separator)


def winners(docs: DataFrame, id: str, text: str, separator: str = "\n", min_words: int = MIN_WORDS) -> DataFrame:
    """(_id, _k1, _k2, _won): for each document the numbers of the units that are
    the first of their digest."""
    k1, k2 = digest2(F.col(text))
    src = docs.select(F.col(text).alias("text"), F.col(id).alias("_id"), k1.alias("_k1"), k2.alias("_k2"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            at, no, digests = [], [], []
            for k, t in enumerate(rb.column(0)):
                seen = set()  # later copies inside a document have lost already
                for n, (_, _, sha) in enumerate(units(t.as_py() or "", separator, min_words)):
                    if sha and sha not in seen:
                        seen.add(sha)
                        at.append(k)
                        no.append(n)
                        digests.append(sha)
            pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rest = [rb.column(c).take(pa.array(at, pa.int64())) for c in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(no, pa.int32()), pa.array(pair[:, 0]), pa.array(pair[:, 1])],
                                             names=["_id", "_k1", "_k2", "no", "d1", "d2"])
    kind = src.schema["_id"].dataType.simpleString()
    found = src.mapInArrow(batches, f"_id {kind}, _k1 long, _k2 long, no int, d1 long, d2 long")
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("_id", "_k1", "_k2", "no")).alias("x")).select("x.*")
    return first.groupBy("_id", "_k1", "_k2").agg(F.collect_set("no").alias("_won"))


def deduplicated(docs: DataFrame, id: str = "doc_id", text: str = "text", paragraphs: bool = False, min_words: int = MIN_WORDS,
                 kept: str = "kept_text", removed: str = "removed", count: str = "n_units") -> DataFrame:
    """Adds the kept text, the removed spans (start, end; code points of the
    original) and the number of units."""
    separator = "\n\n" if paragraphs else "\n"
    k1, k2 = digest2(F.col(text))
    kept, removed, count = (free(docs, name) for name in (kept, removed, count))
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"), F.col(id).alias("id"), k1.alias("k1"), k2.alias("k2"))
    won = winners(docs, id, text, separator, min_words)
    joined = packed.join(won, F.col("id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left").select("row", "text", "_won")

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in rows:
            texts, spans, counts = [], [], []
            for t, won in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist()):
                keep, gone, n, mine = [], [], 0, set(won or ())
                for n, (a, b, sha) in enumerate(units(t, separator, min_words) if t is not None else (), 1):
                    if sha and n - 1 not in mine:
                        gone.append({"start": a, "end": b})
                    else:
                        keep.append(t[a:b])
                texts.append(separator.join(keep) if t is not None else None)
                spans.append(gone)
                counts.append(n)
            yield pa.RecordBatch.from_arrays(
                [rb.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(counts, pa.int64())],
                names=["row", "kept", "removed", "count"])
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("kept", T.StringType()), T.StructField("removed", span), T.StructField("count", T.LongType())])
    return joined.mapInArrow(batches, schema).select("row.*", F.col("kept").alias(kept), F.col("removed").alias(removed), F.col("count").alias(count))
