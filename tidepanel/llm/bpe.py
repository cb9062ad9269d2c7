"""Byte-level BPE by corpus-level merge replay.

The merges of a word depend on the word alone, so a task replays them once over
the distinct words that its blocks of documents bring up. An inverted index maps each pair
of neighbouring tokens to the places (in the concatenated words) where it stands. A
queue of pairs by rank applies every merge in rank order to all its places, and a
merge touches only its two neighbours. Two things keep the ids equal to those of
greedy merging word by word: places of one rank are taken from left to right, and
if a merge creates a pair of a lower rank, that rank is taken up first again.
The ids of words, and of the parts of texts between blanks, are kept for later blocks
of the task, up to a fixed number; one that isn't kept is only replayed again.

Nothing is shuffled, so no hot word, source or group of copies meets in one task,
and memory is bounded by one Arrow batch and the kept words.

Defined cases: a NULL text is an empty one and has no ids; equal rows give equal
results; an empty table gives no rows; other columns are carried along, and if one has the
name of the ids, theirs gets an underscore at its end.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import free

#: Parts of texts, and as many words, in one generation of what a task keeps.
KEPT_WORDS = 400_000


def load_ranks(path: str) -> list[str]:
    """The lines of a rank file, read on the driver: a fixed vocabulary."""
    with open(path, encoding="ascii") as f:
        return [s for s in f.read().split("\n") if s]


def parse_ranks(lines: Iterable[str]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (s.split() for s in lines)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks.get(bytes([b])) for b in range(256)]
        # rank of two neighbours by both ids in one number: every token can be cut
        # in as many ways as it has bytes, so the table is a few times the vocabulary
        self.pairs: dict[int, int] = {}
        for word, r in ranks.items():
            for k in range(1, len(word)):
                x, y = ranks.get(word[:k]), ranks.get(word[k:])
                if x is not None and y is not None:
                    self.pairs[x << 32 | y] = r

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word. All words stand one after another in one array."""
        whole = [self.ranks.get(w) for w in words]
        todo = [w for w, r in zip(words, whole) if r is None]
        single, pair = self.single, self.pairs.get
        # at the first byte of a token its id, else -1; a -1 also ends each word
        token: list[int] = []
        for w in todo:
            token += [single[b] for b in w]
            token.append(-1)
        n = len(token)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        index: dict[int, list[int]] = {}  # rank of a pair -> places of its first token
        before = -1
        for i, t in enumerate(token):
            if before >= 0 and t >= 0 and (r := pair(before << 32 | t)) is not None:
                if r in index:
                    index[r].append(i - 1)
                else:
                    index[r] = [i - 1]
            before = t
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            places = index.pop(r, None)
            if places is None:
                continue
            places.sort()
            stop = -1  # up to here reaches the word that went back to a lower rank
            back: list[int] = []
            for i in places:
                if i < stop:
                    back.append(i)
                    continue
                a, j = token[i], right[i]
                if a < 0 or (b := token[j]) < 0 or pair(a << 32 | b) != r:
                    continue  # a merge before has taken it
                token[i], token[j] = r, -1
                right[i] = nxt = right[j]
                left[nxt] = i
                low = False
                if (t := token[nxt]) >= 0 and (q := pair(r << 32 | t)) is not None:
                    low = q < r
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(queue, q)
                prv = left[i]
                if prv >= 0 and (t := token[prv]) >= 0 and (q := pair(t << 32 | r)) is not None:
                    low = low or q < r
                    if q in index:
                        index[q].append(prv)
                    else:
                        index[q] = [prv]
                        heapq.heappush(queue, q)
                if low:
                    stop = i
                    while token[stop] >= 0:
                        stop = right[stop]
            if back:
                index.setdefault(r, []).extend(back)
                heapq.heappush(queue, r)
        out, ids, i = [], [], 0
        while i < n:
            if token[i] >= 0:
                ids.append(token[i])
            else:
                out.append(ids)
                ids = []
            i = right[i]
        rest = iter(out)
        return [[r] if r is not None else next(rest) for r in whole]


#: A blank between two characters that are no white space: no piece of the pattern
#: reaches over its left side, so texts can be cut there before they are split.
CUT = re.compile(r"(?<=\S) (?=\S)")


def as_bytes(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian 32-bit numbers."""
    data = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
    ends = np.cumsum([0, *map(len, ids)]) * 4
    return [data[x:y] for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


class PartCache:
    """Ids of parts of texts, as bytes. A full cache becomes the old one, from which
    parts that are still in use come back; the rest is forgotten and, if it comes
    up again, encoded again."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def learn(self, wanted: set[str]) -> None:
        """Afterwards all wanted parts are in ``young``."""
        missing = wanted.difference(self.young)
        if len(self.young) + len(missing) > self.limit:
            self.old, self.young, missing = self.young, {}, wanted
        again = missing.intersection(self.old)
        self.young.update((p, self.old[p]) for p in again)
        new = list(missing - again)
        self.young.update(zip(new, self.encode(new)))

    def ids(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of each text, given as its parts."""
        self.learn(set().union(*texts))
        get = self.young.__getitem__
        return [b"".join(map(get, parts)) for parts in texts]


def taken(table: pa.Array, codes: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of the table's rows with these numbers, one after another, and where each begins."""
    got = table.take(pa.array(codes))
    offsets = np.frombuffer(got.buffers()[1], np.int64, len(got) + 1)
    data = got.buffers()[2]
    return memoryview(data if data is not None else b""), offsets


class TextCache:
    """Ids of texts, cut at blanks. ``encode`` gets parts with their blank. Texts are cut, their
    parts numbered and the ids gathered in Arrow; Python sees the distinct parts of a block."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int):
        self.encode = encode
        self.after_blank = PartCache(lambda ps: encode([" " + p for p in ps]), limit)

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(number of each part, first part of each text, distinct parts)."""
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        numbered = lists.flatten().dictionary_encode()
        parts, codes = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        bounds = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
        odd = np.array([not p or p[0].isspace() or p[-1].isspace() for p in parts], bool)
        if not odd.any():
            return codes, bounds, parts
        # blanks beside other white space do not cut: such texts are cut with care
        number = {p: i for i, p in enumerate(parts)}
        careful = np.add.reduceat(odd[codes], bounds[:-1]) > 0
        out = []
        for k, c in enumerate(careful.tolist()):
            mine = codes[bounds[k]:bounds[k + 1]]
            out.append(np.array([number.setdefault(p, len(number)) for p in CUT.split(texts[k])], codes.dtype) if c else mine)
        return np.concatenate(out), np.r_[0, np.cumsum([len(c) for c in out])], list(number)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as 32-bit numbers."""
        if not texts:
            return []
        codes, bounds, parts = self._cut(texts)
        firsts = bounds[:-1]
        used = np.zeros(len(parts), bool)
        rest = np.ones(len(codes), bool)
        rest[firsts] = False
        used[codes[rest]] = True
        self.after_blank.learn({parts[i] for i in np.flatnonzero(used).tolist()})
        young = self.after_blank.young
        table = [young[p] if u else b"" for p, u in zip(parts, used.tolist())]
        heads = self.encode([parts[i] for i in codes[firsts].tolist()])
        codes = codes.astype(np.int64)
        codes[firsts] = len(parts) + np.arange(len(texts))
        data, at = taken(pa.array(table + heads, pa.large_binary()), codes)
        flat, ends = np.frombuffer(data, "<u4", int(at[-1]) // 4), (at[bounds] // 4).tolist()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]


# Patterns of which no piece reaches over a blank inside a text, so that texts
# may be cut there. Texts of other patterns are split whole.
CUT_AT_BLANKS = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
}


class Codec:
    """Encodes texts block by block. ``lines`` are those of a rank file."""

    def __init__(self, lines: list[str], pattern: str):
        self.replay = MergeReplay(parse_ranks(lines))
        split = regex.compile(pattern)
        self.words = PartCache(lambda ws: as_bytes(self.replay.encode([w.encode("utf-8", "replace") for w in ws])), KEPT_WORDS)

        def ids(texts: list[str]) -> list[bytes]:
            return self.words.ids([[m[0] for m in split.finditer(t)] for t in texts] if split.groups else list(map(split.findall, texts)))
        self.parts = TextCache(ids, KEPT_WORDS) if pattern in CUT_AT_BLANKS else None
        self.whole = ids
        top = max(self.replay.bytes_of, default=-1) + 1
        self.bytes_table = pa.array([self.replay.bytes_of.get(i, b"") for i in range(top)], pa.large_binary())
        self.decimal_table = pa.array([b"%d " % i for i in range(top)], pa.large_binary())

    def forget(self) -> None:
        """An idle worker holds the vocabulary only."""
        for cache in (self.words, *([self.parts.after_blank] if self.parts else [])):
            cache.young, cache.old = {}, {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        return self.parts.ids(texts) if self.parts else [np.frombuffer(b, "<u4") for b in self.whole(texts)]

    def decode(self, ids: np.ndarray) -> memoryview:
        data, at = taken(self.bytes_table, ids)
        return data[:int(at[-1])]

    def decimals(self, ids: np.ndarray) -> memoryview:
        """The ids as decimal numbers, joined by one blank."""
        data, at = taken(self.decimal_table, ids)
        return data[:max(0, int(at[-1]) - 1)]


_CODECS: dict[tuple[str, str], Codec] = {}


def digest_of(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _codec(lines: list[str], digest: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary; ``digest`` is that of all lines."""
    key = (digest, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(lines, pattern)
    return _CODECS[key]


def blocks(rb: pa.RecordBatch, column: int, chars: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with about so many characters of text each."""
    texts = [t or "" for t in rb.column(column).to_pylist()]
    lo, size = 0, 0
    for hi, t in enumerate(texts, 1):
        size += len(t)
        if size >= chars or hi == len(texts):
            yield rb.slice(lo, hi - lo), texts[lo:hi]
            lo, size = hi, 0


def encoded(docs: DataFrame, lines: list[str], pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the array of ids of each text to the rows."""
    ids = free(docs, ids)
    shared, digest = docs.sparkSession.sparkContext.broadcast(lines), digest_of(lines)
    at = docs.columns.index(text)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, digest, pattern)
        for rb in rows:
            for part, texts in blocks(rb, at):
                got = codec.encode(texts)
                ends = pa.array(np.cumsum([0, *map(len, got)]), pa.int32())
                got = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(got).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, got], names=[*part.schema.names, ids])
        codec.forget()
    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(batches, schema)


def round_trip(docs: DataFrame, lines: list[str], pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, and digests of the ids and of the bytes decoded from them."""
    shared, digest = docs.sparkSession.sparkContext.broadcast(lines), digest_of(lines)
    src = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, digest, pattern)
        for rb in rows:
            for part, texts in blocks(rb, 1):
                n, by_ids, by_bytes = [], [], []
                for ids in codec.encode(texts):
                    n.append(len(ids))
                    by_ids.append(hashlib.sha256(codec.decimals(ids)).hexdigest())
                    by_bytes.append(hashlib.sha256(codec.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(by_ids, pa.string()), pa.array(by_bytes, pa.string())],
                                                 names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(batches, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
