"""WARC archives and their capture index.

Writing: each page is one record. Of pages with equal payloads of at least
``least`` bytes, the one with the largest id keeps the payload as a response and
the others become revisits that refer to it. A task packs records into files of at
most ``FILE_BYTES`` (a longer record has one of its own); Spark writes each as one
file of plain text lines, so the bytes are a WARC file and any store will do.

Reading: each file is parsed record by record, every payload's digest is checked,
and its index entries are sorted by (url key, time, id): one locally sorted run for
each file. The runs meet in ranges of that key; in each range a loser tree merges
the runs' parts, so that the ranges in order hold all capture histories in order.
A hot url is cut by time and id, as ranges are cut by the whole key.

Only groups with two or more equal payloads take part in the join that finds the
revisits; they are written first, so Spark broadcasts them only while they are
small and splits a hot payload otherwise.

Defined cases: a NULL payload is empty; a NULL url or time is an empty url and the
epoch; of equal rows with the largest id one refers to the id it shares (rows that
share that id are all responses); an empty table gives an empty archive and index;
payloads may hold any bytes, the record separator included; other columns are left
out.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder, written
from .base import parts_for

FILE_BYTES = 16_000_000
ENTRIES_PER_RANGE = 200_000
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ENTRY = "url_key string, time long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string, offset long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int, url: str, seconds: int, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    body = b"" if revisit else payload
    stamp = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    safe = "".join(c if c not in "\r\n" else "%0D" if c == "\r" else "%0A" for c in url)
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {stamp}",
            f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{sha1}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def records(data: bytes) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(headers, offset, length, block) of each record of a file."""
    at = 0
    while at < len(data):
        if data[at:at + 2] == b"\r\n":  # the end of a file line
            at += 2
            continue
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if lines[0] != "WARC/1.0":
            raise ValueError(f"no record at {at}")
        head = dict(s.split(": ", 1) for s in lines[1:])
        size = int(head["Content-Length"])
        stop = end + 4 + size
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"broken record at {at}")
        yield head, at, stop + 4 - at, data[end + 4:stop]
        at = stop + 4


def write(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", time: Column | None = None, least: int = 0,
          path: str | None = None) -> str:
    """Writes the archive and returns its folder. ``time``: seconds since 1970; by
    default the id, since the pages have no time of their own."""
    spark = pages.sparkSession
    path = path or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"),
                        F.coalesce(time if time is not None else F.col(id), F.lit(0)).cast("long").alias("time"),
                        body.alias("payload"), F.sha1(body).alias("sha1"))
    large = F.octet_length("payload") >= least
    groups = written(rows.filter(large).groupBy("sha1").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    paired = rows.join(groups, "sha1", "left")
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))), F.col("keeper"))
    packed = paired.select("page_id", "url", "time", "payload", refers.alias("refers_to"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        for rb in batches:
            for page, u, t, data, ref in zip(*(c.to_pylist() for c in rb.columns)):
                r = record(page, u, t, data, digest(data), ref)
                if held and size + len(r) > FILE_BYTES:
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r)
        if held:
            yield flush()
    out = packed.mapInArrow(files, "value binary").select(F.col("value").cast("string").alias("value"))
    out.write.option("maxRecordsPerFile", 1).option("lineSep", "\r\n").text(path)
    return path


def runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of all files; those of a file are one sorted run."""
    names = [f.split(" ")[0] for f in ENTRY.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            for name, data in zip(rb.column(0).to_pylist(), rb.column(1)):
                entries = []
                for head, at, n, block in records(data.as_py()):
                    page = head["WARC-Record-ID"][len("<urn:page:"):-1]
                    kind, sha1 = head["WARC-Type"], head["WARC-Payload-Digest"][5:]
                    if kind == "response" and digest(block) != sha1:
                        raise ValueError(f"{name} at {at}: wrong digest")
                    ref = head.get("WARC-Refers-To")
                    seconds = int(datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=timezone.utc).timestamp())
                    u = head["WARC-Target-URI"]
                    entries.append((url_key(u), seconds, None if page == "None" else int(page), u, kind, int(head["X-Payload-Length"]), sha1,
                                    int(ref[len("<urn:page:"):-1]) if ref else None, name, at, n))
                entries.sort(key=order)
                if entries:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries), _TYPES)], names=names)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, ENTRY)


_TYPES = [pa.string() if f.endswith("string") else pa.int64() for f in ENTRY.split(", ")]


def url_key(url: str) -> str:
    """Host labels in reverse, then the rest: the captures of a site stand together."""
    rest = url.split("://", 1)[1] if "://" in url else url
    cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host = rest[:cut].encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return ",".join(reversed(host.split("."))) + ")" + rest[cut:]


def order(e: tuple) -> tuple:
    """Strings by their UTF-8 bytes, as Spark orders them; NULL ids first."""
    return e[0].encode("utf-8", "surrogatepass"), e[1], e[2] is not None, e[2] or 0, e[8], e[9]


class LoserTree:
    """Merges k sorted runs. Each inner node keeps the run that lost there; after a
    step only the winner's path to the root is played again."""

    def __init__(self, sources: Iterable[Iterable[tuple]], key):
        self.sources, self.key = [iter(s) for s in sources], key
        k = len(self.sources)
        self.heads = [self._next(i) for i in range(k)]
        self.losers = [-1] * k
        for i in range(k):
            self._play(i)

    def _next(self, i: int):
        e = next(self.sources[i], None)
        return None if e is None else (self.key(e), e)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x[0], a) < (y[0], b))

    def _play(self, winner: int) -> None:
        node = (winner + len(self.heads)) // 2
        while node > 0:
            other = self.losers[node]
            if other < 0:  # the first to come here waits for its rival
                self.losers[node] = winner
                return
            if self._less(other, winner):
                self.losers[node], winner = winner, other
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.heads and (head := self.heads[w := self.losers[0]]) is not None:
            yield head[1]
            self.heads[w] = self._next(w)
            self._play(w)


def merged(entries: DataFrame) -> DataFrame:
    """The entries with ``range`` and ``place``: in this order they are the global
    index. Adds nothing to what a range's runs hold but their order."""
    table = written(entries)
    ranges = parts_for(table.count(), ENTRIES_PER_RANGE, table.sparkSession.sparkContext.defaultParallelism)
    dealt = table.repartitionByRange(ranges, F.col("url_key").asc_nulls_first(), "time", F.col("page_id").asc_nulls_first(), "file", "offset")
    names = table.columns

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[str, list[tuple]] = {}
        for rb in batches:
            for e in zip(*(c.to_pylist() for c in rb.columns)):
                parts.setdefault(e[8], []).append(e)
        for run in parts.values():  # blocks of one file may arrive in any order
            keys = [order(e) for e in run]
            if any(a > b for a, b in zip(keys, keys[1:])):
                run.sort(key=order)
        block, place, part = [], 0, TaskContext.get().partitionId()

        def flush():
            n = len(block)
            return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(zip(*block), _TYPES)], pa.array([part] * n, pa.int64()),
                                               pa.array(range(place - n, place), pa.int64())], names=[*names, "range", "place"])
        for e in LoserTree([parts[f] for f in sorted(parts)], order):
            block.append(e)
            place += 1
            if len(block) == 10_000:
                yield flush()
                block = []
        if block:
            yield flush()
    return dealt.mapInArrow(merge, f"{ENTRY}, range long, place long")


def histories(index: DataFrame) -> DataFrame:
    """Adds ``capture``, the number of a capture in the history of its url. A url
    may reach over several ranges: the counts of those before are added."""
    from pyspark.sql import Window
    table = written(index)
    inside = Window.partitionBy("range", "url_key").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = table.groupBy("url_key", "range").count().select("url_key", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("past"))
    return table.withColumn("capture", F.count(F.lit(1)).over(inside)).join(counts, ["url_key", "range"]).withColumn(
        "capture", F.col("capture") + F.col("past")).drop("past")
