"""Corpus preparation as five stages, each on all that the one before kept.

1. quality classifier: documents scored below the threshold go;
2. n-gram Jaccard join: one document (the smallest doc_id) of each group of near copies stays;
3. benchmark decontamination: documents that hold a test item go;
4. secret scans: found secrets are cut out of the texts;
5. BPE encoding: every remaining document with its token ids.

A null or empty text is scored as any other; it has no group, holds no item and
no secret, and is encoded as no ids. Rows with a null doc_id are judged by
their texts; where they are near copies of a row with a doc_id, that one stays.
Repeated rows are copies, one doc_id may have several texts. Very long texts
are taken whole at every stage. Other columns stay until the last stage, which
gives ids in place of the text. An empty table gives an empty result.

SQL cannot express the classifier, so there is no SQL for the whole; the tests
hold each stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontamination, jaccard_join, quality_classifier, secrets
from tessera.llm._store import materialise, release

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("ngram_jaccard_join", jaccard_join.stage),
    ("benchmark_decontamination", decontamination.stage),
    ("secret_scans", secrets.stage),
    ("bpe_encoding", bpe.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and reread as the next one's input."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if done is not None:
            release(done)
        done = docs
    return STAGES[-1][1](spark, docs, sf_dir)
