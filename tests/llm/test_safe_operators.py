"""Names that are taken, vocabularies, id widths, texts of megabytes."""

import base64
import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import bpe, decontaminate, line_dedup, near_documents, quality_rules, secrets, simhash, suffix_dedup, token_files, warc


def rank_lines(extra):
    """A rank file with all bytes and more tokens."""
    tokens = [bytes([i]) for i in range(256)] + [t.encode() for t in extra]
    return [f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)]


def test_vocabularies_are_told_apart(spark):
    """Two rank files of one length, first and last line equal."""
    one, two = rank_lines(["ab", "xy", "zz"]), rank_lines(["ab", "cd", "zz"])
    df = spark.createDataFrame([(1, "abcdxy")], "doc_id long, text string").coalesce(1)
    a, b = (bpe.encoded(df, lines, r"[\s\S]+").first().ids for lines in (one, two))
    assert a == [256, 99, 100, 257] and b == [256, 257, 120, 121]


def test_pieces_may_reach_over_blanks(spark):
    lines = rank_lines([" b", "a b"])
    df = spark.createDataFrame([(1, "a b"), (2, "a  b a b")], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in bpe.encoded(df, lines, r"[\s\S]+").collect()}
    assert got == {1: [257], 2: [97, 32, 256, 32, 257]}
    groups = bpe.encoded(df, lines, r"(a) ?|[\s\S]").collect()  # a pattern with a group
    assert {r.doc_id: bytes(b for i in r.ids for b in {256: b" b", 257: b"a b"}.get(i, bytes([i]))) for r in groups} == {1: b"a b", 2: b"a  b a b"}


def test_taken_names(spark):
    df = spark.createDataFrame([(1, "one two\none two\npassword = hunter2hunter2", "mine", "k", 3, 4)], "doc_id long, text string, ids string, removed string, spans int, N_Units int")
    out = bpe.encoded(df, rank_lines([]), r"\S+|\s+")
    assert out.columns == [*df.columns, "ids_"] and out.first().ids == "mine" and len(out.first().ids_) == len(df.first().text)
    out = line_dedup.deduplicated(df)
    assert out.columns == [*df.columns, "kept_text", "removed_", "n_units_"] and out.first().removed == "k" and len(out.first().removed_) == 1 and out.first().n_units_ == 3
    out = secrets.with_spans(df)
    assert out.columns == [*df.columns, "spans_"] and out.first().spans == 3 and len(out.first().spans_) == 1


def test_ids_beyond_16_bits(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers
    words = {f"w{i}": i for i in range(70_001)}
    t = Tokenizer(models.WordLevel(words, unk_token="w0"))
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    assert token_files.id_width(t.to_str(), 2) == 4 and token_files.id_width(t.to_str(), 70_005) == 4
    blob = token_files.pack(0, 0, [5], [np.array([70_000, 1], np.uint32)], 4)
    assert token_files.Shard(blob).document(0).tolist() == [70_000, 1]
    with pytest.raises(ValueError):
        token_files.pack(0, 0, [5], [np.array([70_000], np.uint32)], 2)
    with pytest.raises(ValueError):
        token_files.id_width(t.to_str(), -1)


def test_offsets_over_blocks_of_ranges(spark, monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(token_files, "DOCS_PER_RANGE", 3)
    monkeypatch.setattr(token_files, "RANGES_PER_BLOCK", 2)
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    df = spark.createDataFrame([(i * 7, f"text number {i} " * (i % 5)) for i in range(40)], "doc_id long, text string")
    got = sorted(token_files.directory(spark, token_files.write(df, definition, end_id=2)).collect(), key=lambda r: r.doc_id)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert len(got) == 40


LONG = "".join(f"Word{i * 7919 % 10007} and number {i}, line\n" for i in range(160_000))  # five megabytes


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(1, LONG, "en", "host", len(LONG)), (2, LONG[:-1], "en", "host", len(LONG) - 1), (3, "short text of a few words only", "en", "host", 30), (4, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_long_texts_of_fingerprints_and_lines(spark, long_docs):
    got = {r.id: r for r in simhash.classes(long_docs).collect()}
    assert len(got) == 4 and got[1].component == got[2].component == 1 and got[3].component == 3
    kept = {r.doc_id for r in near_documents.kept_documents(long_docs).collect()}
    assert kept == {1, 3, 4}
    lines = {r.doc_id: r for r in line_dedup.deduplicated(long_docs).collect()}
    assert len(lines[1].removed) == 0 and len(lines[2].removed) == 160_000 and lines[1].kept_text == LONG and lines[2].kept_text == ""


def test_long_texts_of_statistics_and_spans(spark, long_docs):
    r = {r.id: r for r in quality_rules.judge(long_docs).collect()}[1]
    words = LONG.split()
    grams = {}
    for i in range(len(words) - 2):
        grams.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(words), sum(map(len, words)), len(repeated))
    hidden = LONG[:4_000_000] + " api_key: abcdef123456 " + LONG[4_000_000:]
    df = spark.createDataFrame([(1, hidden)], "doc_id long, text string")
    assert secrets.findings(df).first().spans.startswith(f"assign:{hidden.index('api_key')}:")
    item = "a question of the benchmark that nobody else would ever ask in these words"
    leak = spark.createDataFrame([(1, LONG[:4_900_000] + " " + item.upper() + " " + LONG[4_900_000:]), (2, LONG)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = decontaminate.matches(leak, bench).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in found] == [(1, 9, 0)]


def test_long_texts_of_tokens_and_files(spark, long_docs):
    import public_tokenizers
    import tiktoken
    lines = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    r = {r.id: r for r in bpe.round_trip(long_docs, lines, public_tokenizers.PATTERN).collect()}[1]
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(lines), special_tokens={})
    ids = plain.encode_ordinary(LONG)
    assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert r.decoded_sha256 == hashlib.sha256(LONG.encode()).hexdigest()
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        got = {r.doc_id: r for r in token_files.directory(spark, token_files.write(long_docs, f.read(), end_id=2)).collect()}
    assert got[1].n_tokens == len(ids) + 1 and got[4].n_tokens == 1
    pages = long_docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/").alias("url"), F.col("text").alias("html"))
    index = {r.page_id: r for r in warc.merged(warc.runs(spark, warc.write(pages))).collect()}
    assert index[1].payload_bytes == len(LONG.encode()) and index[1].payload_digest == base64.b32encode(hashlib.sha1(LONG.encode()).digest()).decode()


def test_long_texts_of_repeated_bytes(spark):
    rng = np.random.default_rng(2)
    text = bytes(rng.integers(97, 123, 1_500_000, np.uint8)).decode()
    docs = [(1, text), (2, "x" + text[500_000:900_000] + "y"), (3, text[1_499_950:])]
    got = {r.id: r for r in suffix_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 400_000 and got[2].n_spans == 1 and got[3].n_removed == 0
