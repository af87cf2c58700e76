"""Corpus preparation: STAGES applied in turn to ``documents``.

Toxic documents go; of each group of near copies one stays; documents that hold a
benchmark item go; personal data is replaced by its kind; the rest becomes token ids.
Each stage calls one operator of ``eoframe.llm`` with that operator's defaults.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from eoframe.llm import decontamination, jaccard_join, pii, sentencepiece, toxicity
from eoframe.llm.common import scratch_table, table, two_columns

#: Rows that move between Spark and Python at once. Rows hold whole texts, and both sides of
#: every task hold a batch of them; Spark's own 10,000 are tens of MB each.
BATCH_ROWS = 2_000


def in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that the grammar rejects. It learns from the labelled ones
    among ``docs``."""
    in_small_batches(spark)
    grammar = toxicity.learn(two_columns(docs, "doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, grammar)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8."""
    in_small_batches(spark)
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that hold an item of ``benchmark``."""
    in_small_batches(spark)
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redact(docs, length_col="n_chars")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) of all documents."""
    in_small_batches(spark)
    return sentencepiece.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("sentencepiece", encode_tokens),
]

#: Learnt weights and merges are beyond SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Between stages the documents are written to the shared folder
    and read again, so a lost executor costs its own part of one stage."""
    docs = spark.read.parquet(os.path.join(sf_dir, "documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
