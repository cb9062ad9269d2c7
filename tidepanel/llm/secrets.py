"""Secret scan: keyword automaton, anchored expressions, embedded checksums.

An Aho-Corasick automaton over the lower-cased bytes of a text finds keywords.
Only where one stands is an expression tried, anchored to that place; long runs of
hexadecimal digits have no keyword and are found by one expression of their own.
Token formats that carry a checksum (six base-62 digits of the CRC-32 of the body)
are kept only if it holds. A task holds one Arrow batch of texts at a time; nothing
is shuffled, so no source or group can be hot.

Defined cases: a NULL or empty text has no spans; texts of any length are scanned
whole; equal rows give equal results; an empty table gives no rows; other columns
are carried along and never read; if one has the name of the spans, theirs gets an underscore.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import free

# The kinds, their keywords (lower case) and expressions.
KINDS = ["assign", "access", "hex"]
KEYWORDS = {"assign": ["password", "passwd", "secret", "token", "apikey", "api_key"], "access": ["akia"],
            "checked": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"]}
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
SPANS = T.ArrayType(SPAN)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def base62(n: int, width: int = 6) -> str:
    out = ""
    for _ in range(width):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


def scan(text: str, keys: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end) in code points, by start and kind."""
    found = [("hex", *m.span()) for m in HEX.finditer(text)]
    raw = text.encode("utf-8", "surrogatepass")
    hits: dict[str, list[int]] = {}
    for end, (kind, n) in keys.iter(raw.lower().decode("latin-1")):
        hits.setdefault(kind, []).append(end + 1 - n)
    if hits:
        plain = len(raw) == len(text)  # else byte places become code points, in one pass
        for kind, expression, good in (("assign", ASSIGN, lambda m: len(m[1]) >= 6), ("access", ACCESS, lambda m: m.end() - m.start() >= 20),
                                       ("checked", CHECKED, lambda m: checksum_holds(m[1], m[2]))):
            over, at, byte = 0, 0, 0
            for place in sorted(hits.get(kind, ())):
                at, byte = (place, place) if plain else (at + len(raw[byte:place].decode("utf-8", "surrogatepass")), place)
                if at >= over and (m := expression.match(text, at)):
                    over = m.end()
                    if good(m):
                        found.append((kind, at, over))
    order = {k: i for i, k in enumerate([*KINDS, "checked"])}
    return sorted(found, key=lambda s: (s[1], order[s[0]], s[2]))


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Adds the array of spans of each text."""
    column = F.pandas_udf(_spans_of_batches, SPANS)
    return docs.withColumn(free(docs, out), column(F.col(text)))


def _spans_of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    keys = automaton()
    for texts in batches:
        yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in scan(t, keys)] if t else [] for t in texts], dtype=object)


def findings(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the id, counts of the base kinds and the spans."""
    import hashlib

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = automaton()
        for rb in rows:
            counts, shas, spans = {k: [] for k in KINDS}, [], []
            for t in rb.column(1):
                all_ = scan(t.as_py() or "", keys)
                base = [s for s in all_ if s[0] in KINDS]
                for k in KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                shas.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(all_))
            yield pa.RecordBatch.from_arrays([rb.column(0), *[pa.array(counts[k], pa.int64()) for k in KINDS], pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                                             names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])
    src = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(batches, f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(text: str, spans: list, mask: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; secrets in ``text`` are replaced."""
    @F.pandas_udf(T.StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        keys = automaton()
        for texts in batches:
            yield pd.Series([redact(t, s, mask) if t and (s := scan(t, keys)) else t for t in texts], dtype=object)
    return docs.withColumn(text, clean(F.col(text)))
