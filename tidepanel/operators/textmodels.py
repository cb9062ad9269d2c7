"""TF-IDF with truncated SVD, and PCA fitted on the past only (Spark ML)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.feature import (PCA, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer,
                                StopWordsRemover)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written


def tfidf(df: DataFrame, text: str, features: int = 5000, min_df: float = 2.0, max_df: float = 0.95) -> DataFrame:
    """Words and word pairs without English stop words; smooth inverse document
    frequency plus one; unit length. A NULL text has no words."""
    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern=r"\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="_tok", outputCol="_words"),
        NGram(n=2, inputCol="_words", outputCol="_pairs")])
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    d = pipe.fit(df).transform(df)
    terms, docs, n = vocabulary(d.select("_words"), features, min_df, max_df)
    if not terms:
        raise ValueError("no term lies within the limits of document frequency")
    d = CountVectorizerModel.from_vocabulary(terms, "_terms", "_tf").transform(d.withColumn("_terms", F.concat("_words", "_pairs")))
    weight = ElementwiseProduct(scalingVec=DenseVector(np.log((n + 1) / (np.array(docs) + 1)) + 1.0), inputCol="_tf", outputCol="_w")
    return Normalizer(inputCol="_w", outputCol="tfidf").transform(weight.transform(d)) \
        .drop("_text", "_tok", "_words", "_pairs", "_terms", "_tf", "_w")


def vocabulary(words: DataFrame, features: int, min_df: float, max_df: float) -> tuple[list[str], list[int], int]:
    """The most frequent words and word pairs within the limits of document frequency (shares
    below 1 of ``min_df``, up to 1 of ``max_df``), their numbers of documents, and that of all. Equal
    counts go by the term. A pair is no more frequent than its words, so only pairs of words at least as
    frequent as the last word that could be taken are counted; the rest cannot be taken."""
    singles = written(term_counts(words, None))
    n = words.count()
    low, high = (min_df if min_df >= 1 else min_df * n), (max_df if max_df > 1 else max_df * n)
    fits = F.col("docs").between(low, high)
    top = singles.filter(fits).orderBy(F.desc("n"), "term").limit(features).collect()
    least = top[-1]["n"] if len(top) == features else 0
    # words of too many documents may still be part of a pair
    part = sorted(r["term"] for r in singles.filter((F.col("n") >= least) & (F.col("docs") >= low)).select("term").collect())
    pairs = term_counts(words, part).filter(fits).orderBy(F.desc("n"), "code").limit(features).collect()
    found = [(-r["n"], r["term"], r["docs"]) for r in top]
    found += [(-r["n"], f"{part[r['code'] // len(part)]} {part[r['code'] % len(part)]}", r["docs"]) for r in pairs]
    found = sorted(found)[:features]
    return [t for _, t, _ in found], [k for _, _, k in found], n


def term_counts(words: DataFrame, part: list[str] | None) -> DataFrame:
    """(term or code, n, docs): occurrences and documents of each word, or of each pair of
    neighbours that both are in ``part`` (its code has both places). Arrow batches are counted before the shuffle."""
    shared = words.sparkSession.sparkContext.broadcast(part)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if shared.value is None else pa.array(shared.value, pa.string())
        for rb in rows:
            lists = rb.column(0)
            flat = lists.flatten()
            doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            if known is None:
                coded = flat.dictionary_encode()
                code, doc_of = coded.indices.to_numpy().astype(np.int64), doc
            else:
                at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy().astype(np.int64)
                ok = (at[:-1] >= 0) & (at[1:] >= 0) & (doc[:-1] == doc[1:])
                code, doc_of = (at[:-1] * len(known) + at[1:])[ok], doc[:-1][ok]
            names, inverse, n = np.unique(code, return_inverse=True, return_counts=True)
            held = np.unique(doc_of * max(1, len(names)) + inverse)  # a term once for each document
            docs = np.bincount(held % max(1, len(names)), minlength=len(names))
            term = pa.array(names) if known is not None else coded.dictionary.take(pa.array(names))
            yield pa.RecordBatch.from_arrays([term, pa.array(n.astype(np.int64)), pa.array(docs.astype(np.int64))], names=[name, "n", "docs"])
    name, kind = ("term", "string") if part is None else ("code", "long")
    return words.mapInArrow(batches, f"{name} {kind}, n long, docs long").groupBy(name).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def sparse_rows(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, index, value) of the entries of a batch of vectors."""
    values = pc.struct_field(vectors, "values")
    row = np.repeat(np.arange(len(vectors)), pc.list_value_length(values).to_numpy(zero_copy_only=False))
    index = pc.struct_field(vectors, "indices")
    if index.null_count:  # dense vectors have no indices
        index = pa.array([i if i is not None else list(range(len(v))) for i, v in zip(index.to_pylist(), values.to_pylist())], pa.list_(pa.int32()))
    return row, index.flatten().to_numpy(), values.flatten().to_numpy()


def times(row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
    """Product of sparse rows with a dense matrix, a column at a time."""
    return np.stack([np.bincount(row, value * m[index, j], n) for j in range(m.shape[1])], axis=1)


def truncated_svd(df: DataFrame, vector: str, k: int, out: str, passes: int = 5, extra: int = 10) -> DataFrame:
    """Project rows on the leading right singular vectors, found by block power
    iteration: every pass is one job over the written rows that adds up a terms x (k + extra) matrix
    inside each partition, a batch at a time. Only that matrix, bounded by the vocabulary, moves.
    Signs make each component's largest loading positive."""
    df = written(df)
    rows = df.select(vector)
    first = rows.first()
    size = len(first[0]) if first else 0
    basis = np.random.default_rng(0).normal(size=(size, min(size, k + extra)))
    sc = df.sparkSession.sparkContext

    def gram_times(held):
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m, total = np.ascontiguousarray(held.value), np.zeros_like(held.value)
            for rb in batches:
                row, index, value = sparse_rows(rb.column(0))
                total += times(index, row, value, len(m), times(row, index, value, rb.num_rows, m))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
        sums = rows.mapInArrow(partial, "sums binary").rdd.map(lambda r: np.frombuffer(r[0]))
        return sums.treeReduce(np.add).reshape(basis.shape)
    for _ in range(passes):
        basis = gram_times(sc.broadcast(np.linalg.qr(basis)[0]))
    q = np.linalg.qr(basis)[0]
    small = q.T @ gram_times(sc.broadcast(q))
    values, rot = np.linalg.eigh((small + small.T) / 2)
    v = q @ rot[:, np.argsort(-values)[:k]]
    loadings = sc.broadcast(v * np.where(np.abs(v.max(axis=0)) >= np.abs(v.min(axis=0)), 1.0, -1.0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            scores = times(*sparse_rows(rb.column(rb.schema.get_field_index(vector))), rb.num_rows, loadings.value)
            ends = pa.array(np.arange(rb.num_rows + 1) * scores.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.ListArray.from_arrays(ends, pa.array(scores.ravel()))], names=[*rb.schema.names, out])
    return df.mapInArrow(project, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))


def pca_past(df: DataFrame, vec: str, is_train, k: int, out: str) -> DataFrame:
    """PCA fitted on rows before the cutoff, applied to all rows after removing
    the training mean; each component's largest loading is positive."""
    d = df.withColumn("_v", array_to_vector(F.transform(F.col(vec), lambda x: x.cast("double"))))
    train = d.filter(is_train)
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(train)
    dims = model.pc.numRows
    means = train.agg(F.array(*[F.avg(F.col(vec)[i].cast("double")) for i in range(dims)]).alias("m"))
    pc = model.pc.toArray()
    sign = [1.0 if abs(c.max()) >= abs(c.min()) else -1.0 for c in pc.T]
    shift = means.withColumn("_v", array_to_vector("m"))
    base = vector_to_array(model.transform(shift).select("_p").scalar())
    scores = model.transform(d).withColumn("_a", vector_to_array("_p")).withColumn("_b", base)
    s = F.array(*[F.lit(v) for v in sign])
    return scores.withColumn(out, F.zip_with(F.zip_with("_a", "_b", lambda a, b: a - b), s, lambda a, b: a * b)) \
        .drop("_v", "_p", "_a", "_b")


