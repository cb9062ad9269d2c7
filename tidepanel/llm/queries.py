"""The registered queries of this package: thin contracts around the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import bpe, decontaminate, heap_kmeans, jaccard_join, line_dedup, merkle, quality_rules, secrets, simhash, suffix_dedup, token_files, url_filter, warc
from .base import table
from .sql import ORACLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def oracles() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "n_removed_words", "kept")


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.round_trip(table(spark, sf_dir, "documents"), lines, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


@query
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        json = f.read()
    path = token_files.write(table(spark, sf_dir, "documents"), json, end_id=2)
    return token_files.directory(spark, path)


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# The rules of the contract.
RULES = [url_filter.Rule("allow", "com"), url_filter.Rule("block", "example.com", "/en/"), url_filter.Rule("allow", "www.example.com", "/en/"),
         url_filter.Rule("block", "net", "/es/"), url_filter.Rule("block", "net", "/fr/")]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    labelled = url_filter.labelled_by_documents(pages, table(spark, sf_dir, "labels"))
    return url_filter.judge(pages, RULES, labelled=labelled).select("page_id", "host", "path", "rule", "verdict")


@query
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write(table(spark, sf_dir, "pages"))
    return warc.merged(warc.runs(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "range", "place")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return line_dedup.deduplicated(docs).select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


@query
def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0  # the contract's tampering; a NULL id is left as it is
    one_more = F.when(altered, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))
    return merkle.manifest(table(spark, sf_dir, "documents"), claims={"n_chars": one_more}).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@query
def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents"), size=3, similarity=(9, 10)).select(
        F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@query
def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_kmeans.clustered(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
