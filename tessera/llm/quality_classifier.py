"""Quality classifier on supervised subword embeddings.

A document is the average of the vectors of its features: hashed lower-case
words, hashed word bigrams (a word said twice running is one feature, whatever
the word) and hashed character n-grams (3 and 4 bytes, across word ends). Vectors
and softmax weights are learned by stochastic gradient descent in numpy over a
bounded sample of labelled rows (``SAMPLE_DOCS``, chosen by a hash of doc_id).
Since the average is linear, a feature's part of the decision is one number;
scoring adds those up, over every byte of every text.

A null or empty text has no features: its score is what the bias alone gives.
Without labelled rows of both classes every score is the share of label 1 (or
0.5). Of clashing labels of a document the greatest counts, and of repeated
rows of a document in the sample the least text. Labels of texts of more than
``SAMPLE_CHARS`` (see ``_store``) characters are not learned from; scoring takes
every text whole, a very long one alone in its batch. Repeated rows score
alike, so do equal texts (ties of scores stand); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._store import bounded_batches, documents, free_name, sample_texts
from ._words import bounds, buffers, hashes, mix, slabs

SAMPLE_DOCS = 3000
HASH_BITS, DIM, EPOCHS, RATE = 16, 10, 6, 20.0
NGRAMS = (3, 4)
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32


def features(text: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For words and each n-gram size: (bucket of every feature, first feature of each row and the total)."""
    data, off = buffers(text)
    n = len(off) - 1
    shift = np.uint64(64 - HASH_BITS)
    start, end, row = bounds(data, off)
    h = hashes(data, start, end)
    pairs = mix(h[:-1] * np.uint64(3) + h[1:]) if len(h) else h
    pairs[h[:-1] == h[1:]] = 0
    inner = row[:-1] == row[1:]
    ids = [(h >> shift).astype(np.int32), (pairs >> shift).astype(np.int32)[inner]]
    firsts = [np.searchsorted(row, np.arange(n + 1)), np.searchsorted(row[:-1][inner], np.arange(n + 1))]
    low = _LOWER[data]
    for k in NGRAMS:
        size = max(len(low) - k + 1, 0)
        code = np.full(size, k, np.uint64)
        for i in range(k):
            code = (code << np.uint64(8)) | low[i : i + size]
        inside = np.ones(size, bool)
        for edge in off[1:-1]:
            inside[max(0, edge - k + 1) : edge] = False
        ids.append((mix(code) >> shift).astype(np.int32)[inside])
        firsts.append(np.concatenate([[0], np.cumsum(np.maximum(np.diff(off) - k + 1, 0))]))
    return ids, firsts


class SubwordClassifier:
    """Feature vectors and softmax weights; after training one number per feature."""

    def __init__(self, prior: float = 0.5):
        self.bias = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
        self.parts = np.zeros(1 << HASH_BITS, np.float32)

    def fit(self, text: pa.Array, y: np.ndarray, seed: int = 7) -> SubwordClassifier:
        rng = np.random.default_rng(seed)
        docs: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(len(text)):
            f = np.concatenate(features(text.slice(i, 1))[0])
            unique, count = np.unique(f, return_counts=True)
            docs.append((unique, (count / max(len(f), 1)).astype(np.float32)))
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << HASH_BITS, DIM)).astype(np.float32)
        out = np.zeros((DIM, 2), np.float32)
        bias = np.array([0.0, self.bias], np.float32)
        steps, step = EPOCHS * len(docs), 0
        for _ in range(EPOCHS):
            for i in rng.permutation(len(docs)):
                ids, share = docs[i]
                rate = RATE * (1 - step / steps)
                step += 1
                v = vectors[ids]
                hidden = share @ v
                z = hidden @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[y[i]] -= 1
                back = out @ p
                out -= rate * 0.05 * np.outer(hidden, p)
                bias -= rate * 0.002 * p
                vectors[ids] = v - rate * share[:, None] * back[None, :]
        self.parts = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32)
        self.bias = float(bias[1] - bias[0])
        return self

    def score(self, text: pa.Array) -> np.ndarray:
        """Probability of label 1 of each row."""
        total, count = np.zeros(len(text)), np.zeros(len(text))
        for ids, first in zip(*features(text), strict=True):
            run = np.concatenate([[0.0], np.cumsum(self.parts[ids], dtype=np.float64)])
            total += np.diff(run[first])
            count += np.diff(first)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -50, 50)))


def learnable(doc_id) -> F.Column:
    """Whether labels of a row may be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS != HELD_OUT


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> SubwordClassifier:
    known = labels.where("doc_id is not null and quality in (0, 1)").where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = sample_texts(docs, known, sample).toPandas()
    if rows.empty:
        return SubwordClassifier()
    rows = rows.sort_values(["doc_id", "text"], kind="stable")
    y = rows["quality"].to_numpy(np.int64)
    model = SubwordClassifier(float(y.mean()))
    return model.fit(pa.array(rows["text"], pa.string()), y) if 0 < y.mean() < 1 else model


def score_quality(docs: DataFrame, model: SubwordClassifier, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``; a column that has this name already is replaced, the others stay."""
    bounded_batches(docs.sparkSession)
    model_parts, bias = model.parts, model.bias
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SubwordClassifier()
        own.parts, own.bias = model_parts, bias
        for batch in slabs(batches, text_col, 1 << 20):
            text = batch.column(batch.schema.get_field_index(text_col))
            yield batch.append_column(name, pa.array(own.score(text)))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = ~learnable(F.col("doc_id"))
    return score_quality(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not rejected."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "quality")
    return score_quality(docs, model, name=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)
