"""Quality rules: cross-document line frequency per host, and text statistics.

All of it is DataFrame functions. Lines are normalised (A-Z lowered, white space
runs to one blank, trimmed) and hashed to 128 bits. For each host and line the
distinct *document identities* are counted, in two partial aggregations that
combine before they shuffle, so neither a hot host nor a hot line meets in one
task. A document's identity is all of its normalised lines, so only copies collapse and
do not turn their own content into boilerplate. A line is above the limits if more documents of
the host have it than ``max_share`` of them, but ``max_docs`` at least and ``enough_docs`` at
most, so that a line on very many pages is one in a host of any size.
Such lines are removed (``kept_documents`` returns the texts without
them; blank lines and all others stay as they are); a document that loses more than
``max_removed_pct`` percent of its words is depleted.

Defined cases: a NULL text has no words and no lines, so it fails the base rule; a
NULL host is a host of its own; rows that are equal in id, host and text get equal
verdicts; an empty table gives an empty result; other columns are never touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import SPACE, SPACE_CHARS, WORD_CHAR, ascii_lower, digest2, words_of

# The symbols that the base rule counts.
SYMBOLS = "#*$%&|<>"


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda s: s.rlike(WORD_CHAR))


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(line), f"[{SPACE}]+", " "))


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more. The windows' hashes
    are sorted with their places, equal neighbours are repeats, and the repeats'
    places, in order, cover up to three words each: n log n for any length."""
    spots = F.when(F.size(words) >= 3, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>"))
    keyed = F.sort_array(F.transform(spots, lambda i: F.struct(
        F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        same = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
        places = F.sort_array(F.transform(same, lambda x: x.i))
        return F.get(F.transform(F.array(places), lambda p: F.aggregate(
            p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
            lambda a, x: F.struct((a.n + F.least(F.lit(3), x - a["last"])).cast("long").alias("n"), x.alias("last")),
            lambda a: a.n)), F.lit(0))
    # a one-element transform binds an array to a name, so that it is made once
    return F.get(F.transform(F.array(keyed), covered), F.lit(0))


def statistics(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    stripped = F.length(F.translate(t, SPACE_CHARS, ""))
    words = words_of(text)
    pair = F.get(F.transform(F.array(words), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))), F.lit(0))
    dup = F.get(F.transform(F.array(worded_lines(text)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")), F.lit(0))
    return {"_words": pair, "word_chars": stripped.cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"), "n_dup_lines": dup}


def frequent_lines(docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = 10, max_share: float = 0.005, enough_docs: int = 1000) -> DataFrame:
    """(host, line digests) of the lines that are above the limits."""
    d = docs.select(F.col(host).alias("host"), F.transform(worded_lines(F.col(text)), normal).alias("lines"))
    i1, i2 = digest2(F.array_join("lines", "\n"))
    h = d.select("host", i1.alias("i1"), i2.alias("i2"), F.transform(F.array_distinct("lines"), lambda x: F.struct(  # strings are told apart by hash, structs by all pairs
        *[c.alias(n) for c, n in zip(digest2(x), ("a", "b"))])).alias("keys"))
    # one row per host and identity first: both counts start from rows without copies
    rows = h.select("host", "i1", "i2", F.explode("keys").alias("k")).select("host", "i1", "i2", "k.a", "k.b")
    seen = rows.groupBy("host", "a", "b", "i1", "i2").count().groupBy("host", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    hosts = (h.groupBy("host", "i1", "i2").count().groupBy("host").agg(F.count(F.lit(1)).alias("n_host"))
             .withColumnRenamed("host", "host_"))
    return (seen.filter(F.col("n") > max_docs).join(hosts, F.col("host").eqNullSafe(F.col("host_")))
            .filter(F.col("n") > F.least(F.greatest(F.lit(max_docs), F.col("n_host") * max_share), F.lit(enough_docs))).select("host", "a", "b"))


def judge(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", min_words: int = 50,
          max_repeat_pct: int = 50, max_docs: int = 10, max_share: float = 0.005, enough_docs: int = 1000, max_removed_pct: int = 60) -> DataFrame:
    """One row per document row: its key (id, host, k1, k2), the statistics,
    ``base_failed``, ``n_removed_words`` and ``kept``. Texts are never shuffled."""
    return judged(docs, id, text, host, min_words, max_repeat_pct, max_docs, max_share, enough_docs, max_removed_pct).drop("removed_lines")


def judged(docs: DataFrame, id: str, text: str, host: str, min_words: int = 50, max_repeat_pct: int = 50, max_docs: int = 10,
           max_share: float = 0.005, enough_docs: int = 1000, max_removed_pct: int = 60) -> DataFrame:
    """As ``judge``, with the numbers of the lines to remove (NULL if there are none)."""
    from ..session import written
    k1, k2 = digest2(F.col(text))
    base = docs.select(F.col(id).alias("id"), F.col(host).alias("host"), k1.alias("k1"), k2.alias("k2"),
                       *[c.alias(n) for n, c in statistics(F.col(text)).items()])
    base = base.select("id", "host", "k1", "k2", "_words.n_words", "word_chars", "n_symbols", "n_dup_lines", "_words.n_repeat_words")
    # the frequent lines are written, so that their size is known when the join is planned
    often = written(frequent_lines(docs, text, host, max_docs, max_share, enough_docs)).select(F.col("host").alias("h_"), "a", "b")
    lines = docs.select(F.col(id).alias("id"), F.col(host).alias("host"), k1.alias("k1"), k2.alias("k2"),
                        F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line")).filter(F.col("line").rlike(WORD_CHAR))
    a, b = digest2(normal(F.col("line")))
    lines = lines.select("id", "host", "k1", "k2", "no", a.alias("a_"), b.alias("b_"), F.size(words_of(F.col("line"))).alias("w"))
    gone = lines.join(often, F.col("host").eqNullSafe(F.col("h_")) & (F.col("a_") == F.col("a")) & (F.col("b_") == F.col("b")))
    keys = ["id", "host", "k1", "k2"]
    removed = gone.groupBy(*keys).agg(F.sum("w").alias("w"), F.collect_set("no").alias("removed_lines"))
    copies = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    facts = _same(removed, copies, keys).select(*[F.col(k).alias(f"_{k}") for k in keys],
                                                (F.col("w") / F.col("copies")).cast("long").alias("_w"), "removed_lines")
    out = base.join(facts, _equal(keys), "left").select(*base.columns, F.coalesce("_w", F.lit(0).cast("long")).alias("n_removed_words"), "removed_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (100 * F.col("n_removed_words") <= max_removed_pct * F.col("n_words")))


def _equal(keys: list[str], prefix: str = "_") -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return cond


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(r, _equal(keys)).drop(*[f"_{k}" for k in keys])


def without_lines(text: Column, numbers: Column) -> Column:
    """The text without the lines of these numbers; the others keep their order."""
    lines = F.split(text, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), numbers)
    # a one-element transform binds the lines to a name, so that they are made once
    return F.get(F.transform(F.array(lines), lambda x: F.array_join(F.transform(left, lambda i: F.get(x, i)), "\n")), F.lit(0))


def kept_documents(docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str | None = None, **limits) -> DataFrame:
    """The documents that pass, with all their columns, and without the lines above the
    limits; the column ``n_chars`` follows the texts that change. Documents are dealt by
    their key and meet the rejected keys and the lines to remove there, at every size alike."""
    from ..session import written
    keys = ["id", "host", "k1", "k2"]
    found = judged(docs, id, text, host, **limits).filter(~F.col("kept") | F.col("removed_lines").isNotNull())
    found = written(found.select(*keys, "kept", "removed_lines").dropDuplicates(keys))
    k1, k2 = digest2(F.col(text))
    packed = docs.select(F.struct("*").alias("row"), F.col(id).alias("_id"), F.col(host).alias("_host"), k1.alias("_k1"), k2.alias("_k2"))
    met = packed.join(found.hint("merge"), _equal(keys), "left").filter(F.coalesce("kept", F.lit(True)))
    changed, new = F.col("removed_lines").isNotNull(), without_lines(F.col("row")[text], F.col("removed_lines"))
    met = met.select("row", changed.alias("changed"), F.when(changed, new).otherwise(F.col("row")[text]).alias("new"))
    follow = {text: F.col("new")}
    if n_chars:
        follow[n_chars] = F.when(F.col("changed"), F.length("new")).otherwise(F.col("row")[n_chars]).cast(docs.schema[n_chars].dataType)
    return met.select(*[follow.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
