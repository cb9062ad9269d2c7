"""Token ids in binary shards with Elias-Fano document boundaries.

Documents are dealt to ranges of their id, so the shards, in order, hold all
documents in ascending order. A task packs its range into shards of at most
``SHARD_IDS`` ids (a longer document has one of its own). A shard holds the ids in
16 or 32 bits, and two Elias-Fano sequences: the document ids (relative to the
first) and the boundaries, whose select gives the place of any document. Shards are
written and read by Spark (one row is one file), so any store will do.

Shard layout: magic, version, bytes of an id, range, number in the range, documents,
documents without id, first id, ids, then the two sequences, the ids, a line feed.

Defined cases: a NULL text is an empty one; documents with a NULL id come first;
documents with equal ids are ordered by their text's hash; an empty table writes
no shard and reads as an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, written
from . import elias_fano
from .base import parts_for
from .bpe import CUT, as_bytes, taken

MAGIC = b"EFTOKEN1"
HEAD = struct.Struct("<8sB3xIIQQqQ")
SHARD_IDS = 4_000_000
DOCS_PER_RANGE = 4_000
#: Ranges whose offsets are one running sum; a thousand million documents are fewer blocks than that.
RANGES_PER_BLOCK = 1_000
#: Parts of texts that a worker keeps, about: a table of some 50 bytes each.
KEPT = 400_000
#: White space (of str.isspace) at a part's end, at its begin or after its line feed, or nothing at all.
_SPACE = r"\t\x0b-\r\x1c-\x20\x{85}\p{Zs}\x{2028}\x{2029}"
ODD = rf"\A\z|\A\n?[{_SPACE}]|\A\n\n|[\n{_SPACE}]\z"
#: Bytes of text that are cut and looked up at once.
BLOCK = 16_000_000


def pack(part: int, number: int, ids: list[int | None], tokens: list[np.ndarray], width: int) -> bytes:
    nulls = sum(i is None for i in ids)
    known = np.array(ids[nulls:], np.int64)
    base = int(known[0]) if len(known) else 0
    ends = np.cumsum([0, *map(len, tokens)])
    flat = np.concatenate(tokens) if tokens else np.array([], np.uint32)
    if len(flat) and int(flat.max()) >> 8 * width:
        raise ValueError(f"a token id does not fit in {width} bytes")
    relative = (known - base).view(np.uint64) if len(known) else known.view(np.uint64)
    return b"".join([HEAD.pack(MAGIC, width, part, number, len(ids), nulls, base, len(flat)), elias_fano.encode(relative),
                     elias_fano.encode(ends), flat.astype(f"<u{width}").tobytes(), b""])


class Shard:
    """One shard; documents are found by select, without a table of offsets."""

    def __init__(self, data: bytes):
        magic, self.width, self.part, self.number, self.docs, self.nulls, self.base, self.n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.keys = elias_fano.Sequence(data, HEAD.size)
        self.ends = elias_fano.Sequence(data, HEAD.size + self.keys.size)
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n, HEAD.size + self.keys.size + self.ends.size)

    def __len__(self) -> int:
        return self.docs

    def doc_ids(self) -> list[int | None]:
        return [None] * self.nulls + (self.keys.all().view(np.int64) + self.base).tolist()

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends[i]:self.ends[i + 1]]


class LibraryEncoder:
    """Ids by the tokenizers library. Texts are cut where the tokenizer cuts too (before a blank
    or a line feed between two characters that are no white space, and before a full stop or
    comma at a part's end), and each distinct part is encoded once. Texts are cut, their parts looked up
    among those known and the ids gathered in Arrow; Python sees new parts only. New parts are given to
    the library many in one text; the bytes that the ids stand for tell where a part ends. Each text
    is cut as the rest of a line, whose line feed is dropped from the ids. A text with other white
    space between its parts is cut with care; one that has the string of a special token goes to the library as it is."""

    def __init__(self, json: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.size = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes: byte-level tokens have a letter for each
        for token, i in vocabulary.items():
            self.size[i] = len(token)
        full_stop, comma, feed = self._ask([".", ",", "\n"])
        self.tails = full_stop, comma
        self.feed = len(feed) // 4
        self.known = pa.array([], pa.large_string())
        self.ids = pa.array([], pa.large_binary())
        self.last = np.zeros(0, np.int64)  # the block that used a part last
        self.block = 0

    def _ask(self, texts: list[str]) -> list[bytes]:
        return as_bytes([e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _parts(self, parts: pa.Array, many: int = 400) -> pa.Array:
        """Ids of parts, which begin with a blank or a line feed and end before another one."""
        if not len(parts):
            return pa.array([], pa.large_binary())
        starts = np.r_[np.arange(0, len(parts), many), len(parts)]
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(starts), parts), pa.scalar("", pa.large_string()))
        upto = np.cumsum(pc.binary_length(parts).to_numpy())
        flat, counts = [], []
        for e, lo, hi in zip(self.tokenizer.encode_batch_fast(joined.to_pylist(), add_special_tokens=False), starts.tolist(), starts[1:].tolist()):
            got = np.array(e.ids, "<u4")
            ends = upto[lo:hi] - (upto[lo - 1] if lo else 0)
            told = np.cumsum(self.size[got])
            last = np.searchsorted(told, ends)
            if len(got) and last[-1] == len(got) - 1 and (told[last] == ends).all():
                flat.append(got)
                counts.append(np.diff(last, prepend=-1))
            else:  # parts were cut otherwise
                one = self._ask(parts.slice(lo, hi - lo).to_pylist())
                flat.append(np.frombuffer(b"".join(one), "<u4"))
                counts.append(np.array(list(map(len, one))) // 4)
        return binaries(np.concatenate(flat), np.concatenate(counts))

    def _learn(self, new: pa.Array, base_at: np.ndarray) -> np.ndarray:
        """Takes up new parts, and returns their places. ``base_at`` is the place of the part without its last
        character, below zero if it is not known; one before a full stop or comma may be."""
        tailed = pc.match_substring_regex(new, r"\p{L}[.,]\z")
        long, where = new.filter(tailed), tailed.to_numpy(zero_copy_only=False)
        place, held, none = base_at[where], len(self.known), pa.scalar("", pa.large_string())
        unknown = place < 0
        ask = pa.concat_arrays([new.filter(pc.invert(tailed)), pc.utf8_slice_codeunits(long.filter(pa.array(unknown)), 0, -1)]).dictionary_encode()
        codes = ask.indices.to_numpy()
        place[unknown] = held + codes[len(new) - len(long):]
        asked = pc.binary_join_element_wise(pc.if_else(pc.starts_with(ask.dictionary, "\n"), none, pa.scalar(" ", pa.large_string())), ask.dictionary, none)
        ids = pa.concat_arrays([self.ids, self._parts(asked)])
        tails = pc.if_else(pc.ends_with(long, "."), *(pa.scalar(t, pa.large_binary()) for t in self.tails))
        joined = pc.binary_join_element_wise(ids.take(pa.array(place)), tails, pa.scalar(b"", pa.large_binary()))
        self.known, self.ids = pa.concat_arrays([self.known, ask.dictionary, long]), pa.concat_arrays([ids, joined])
        self.last = np.r_[self.last, np.full(len(ask.dictionary) + len(long), self.block)]
        at = np.empty(len(new), np.int64)
        at[~where] = held + codes[:len(new) - len(long)]
        at[where] = held + len(ask.dictionary) + np.arange(len(long))
        return at

    def _forget(self) -> None:
        """Half of a full table stays: the parts used last."""
        if len(self.known) > KEPT:
            keep = np.sort(np.argsort(-self.last, kind="stable")[:KEPT // 2])
            self.known, self.ids, self.last = self.known.take(pa.array(keep)), self.ids.take(pa.array(keep)), self.last[keep]

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each part among those known, first part of each text, texts with an odd part)."""
        feed = pa.scalar("\n", pa.large_string())
        lists = pc.split_pattern(pc.binary_join_element_wise(feed, pc.replace_substring(texts, "\n", " \n"), pa.scalar("", pa.large_string())), " ")
        parts, bounds = lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        tailed = pc.or_(pc.ends_with(parts, "."), pc.ends_with(parts, ","))
        both = pa.concat_arrays([parts, pc.utf8_slice_codeunits(parts.filter(tailed), 0, -1)])
        found = pc.index_in(both, value_set=self.known)  # builds a table of all known parts, so once
        base_found, found = found.slice(len(parts)), found.slice(0, len(parts))
        unknown = found.is_null()
        code = pc.fill_null(found, 0).to_numpy().astype(np.int64)
        apart = np.zeros(len(texts), bool)
        if pc.any(unknown).as_py():
            fresh = parts.filter(unknown).dictionary_encode()
            numbers = fresh.indices.to_numpy()
            where = np.flatnonzero(unknown.to_numpy(zero_copy_only=False))
            row = np.empty(len(fresh.dictionary), np.int64)
            row[numbers] = where  # a row that has the part
            tailed = tailed.to_numpy(zero_copy_only=False)
            base_at = np.full(len(row), -1)
            base_at[tailed[row]] = pc.fill_null(base_found, -1).to_numpy()[np.cumsum(tailed)[row[tailed[row]]] - 1]
            odd = pc.match_substring_regex(fresh.dictionary, ODD).to_numpy(zero_copy_only=False)
            at = np.zeros(len(odd), np.int64)
            at[~odd] = self._learn(fresh.dictionary.filter(pa.array(~odd)), base_at[~odd])
            code[where] = at[numbers]
            apart[np.searchsorted(bounds, where[odd[numbers]], "right") - 1] = True
        return code, bounds, apart

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no NULLs), one after another, and where each text's begin and end."""
        special = np.zeros(len(texts), bool)
        for s in self.special:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        self._forget()
        self.block += 1
        code, bounds, apart = self._coded(texts)
        apart |= special
        if len(self.last):
            self.last[code] = self.block
        ids, rows = self.ids, np.flatnonzero(apart)
        if not len(rows):
            data, ends = taken(ids, code)
            flat, ends = np.frombuffer(data, "<u4", int(ends[-1]) // 4), ends[bounds] // 4
            keep = np.ones(len(flat), bool)
            keep[(ends[:-1, None] + np.arange(self.feed)).ravel()] = False  # each text's line feed
            return flat[keep], ends - self.feed * np.arange(len(ends))
        near = np.flatnonzero(~apart)
        flat, ends = self.encode_array(texts.take(pa.array(near))) if len(near) else (None, None)
        held = {k: flat[a:b] for k, a, b in zip(near.tolist(), ends.tolist(), ends[1:].tolist())} if len(near) else {}
        cut = {k: [t] if special[k] else CUT.split(t) for k, t in zip(rows.tolist(), texts.take(pa.array(rows)).to_pylist())}
        cut = {k: [p if n == 0 else " " + p for n, p in enumerate(ps)] for k, ps in cut.items()}
        wanted = list({p for ps in cut.values() for p in ps})
        got = dict(zip(wanted, self._ask(wanted)))
        held |= {k: np.frombuffer(b"".join(map(got.__getitem__, ps)), "<u4") for k, ps in cut.items()}
        all_ids = [held[k] for k in range(len(texts))]
        return np.concatenate(all_ids), np.cumsum([0, *map(len, all_ids)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if not texts:
            return []
        flat, ends = self.encode_array(pa.array(texts, pa.large_string()))
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]


def binaries(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as bytes."""
    ends = np.r_[0, np.cumsum(counts)].astype(np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


def text_blocks(texts: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of rows with about so many bytes of text each."""
    upto = np.cumsum(pc.binary_length(texts).to_numpy())
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + size)) + 1)
        yield lo, hi
        lo = hi


_ENCODERS: dict[str, LibraryEncoder] = {}


def _encoder(json: str) -> LibraryEncoder:
    """One encoder per worker process and tokenizer. Tasks call it by name: a table that their own
    function names would be sent with it, empty, to each task."""
    key = hashlib.sha256(json.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = LibraryEncoder(json)
    return _ENCODERS[key]


def id_width(json: str, end_id: int) -> int:
    from tokenizers import Tokenizer
    most = max([end_id, *Tokenizer.from_str(json).get_vocab(with_added_tokens=True).values()])
    if min(end_id, most) < 0 or most >= 1 << 32:
        raise ValueError("token ids must fit in 32 bits")
    return 2 if most < 1 << 16 else 4


def write(docs: DataFrame, json: str, end_id: int, id: str = "doc_id", text: str = "text", path: str | None = None,
          shard_ids: int = SHARD_IDS) -> str:
    """Writes all shards and returns their folder. ``json`` is the tokenizer's
    definition; its largest id decides on the bytes of an id (2 up to 65,535, else 4)."""
    width = id_width(json, end_id)
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    shared = spark.sparkContext.broadcast(json)
    src = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("tie"))
    ranges = parts_for(src.select("id").count(), DOCS_PER_RANGE, spark.sparkContext.defaultParallelism)
    dealt = src.repartitionByRange(ranges, "id", "tie").sortWithinPartitions("id", "tie")

    def shards(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = _encoder(shared.value)
        part, number, ids, tokens, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([pack(part, number, ids, tokens, width)], pa.binary())], names=["value"])
        for rb in rows:
            texts = pc.fill_null(rb.column(1).cast(pa.large_string()), "")
            for lo, hi in text_blocks(texts):
                flat, ends = encoder.encode_array(texts.slice(lo, hi - lo))
                for i, a, b in zip(rb.column(0).slice(lo, hi - lo).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    t = flat[a:b]
                    if tokens and size + len(t) + 1 > shard_ids:
                        yield flush()
                        number, ids, tokens, size = number + 1, [], [], 0
                    ids.append(i)
                    tokens.append(np.append(t, np.uint32(end_id)))
                    size += len(t) + 1
        if ids:
            yield flush()
    files = dealt.mapInArrow(shards, "value binary").select(F.col("value").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("lineSep", "\n").text(path)
    return path


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: part, number (of its shard), place, doc_id, start (within the
    shard), n_tokens, ids_crc32."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for value in rb.column(0):
                if not (data := value.as_py()):
                    continue  # Spark writes an empty file for an empty result
                s = Shard(data)
                ends = s.ends.all().astype(np.int64)
                crc = [zlib.crc32(s.ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])]
                n = len(s)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s.part] * n, pa.int64()), pa.array([s.number] * n, pa.int64()), pa.array(s.doc_ids(), pa.int64()),
                     pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                    names=["part", "number", "doc_id", "start", "n_tokens", "ids_crc32"])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(rows, "part long, number long, doc_id long, start long, n_tokens long, ids_crc32 long")


def directory(spark: SparkSession, path: str) -> DataFrame:
    """Per document its global start. Offsets of shards are running sums: inside each range,
    inside each block of ``RANGES_PER_BLOCK`` ranges, and over the blocks."""
    docs = written(read(spark, path))
    shards = docs.groupBy("part", "number").agg(F.sum("n_tokens").alias("n"))
    before = "coalesce(sum(n) OVER ({} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    parts = written(shards.groupBy("part").agg(F.sum("n").alias("n")).withColumn("block", F.expr(f"part div {RANGES_PER_BLOCK}")))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.expr(before.format("ORDER BY block")).alias("start"))
    parts = parts.select("part", "block", F.expr(before.format("PARTITION BY block ORDER BY part")).alias("within")).join(blocks, "block")
    at = shards.select("part", "number", F.expr(before.format("PARTITION BY part ORDER BY number")).alias("place")).join(parts, "part")
    offsets = written(at.select("part", "number", (F.col("start") + F.col("within") + F.col("place")).alias("offset")))
    return docs.join(offsets, ["part", "number"]).select("doc_id", (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
