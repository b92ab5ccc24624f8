"""Corpus pipeline: five stages over ``documents``, each by one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame.  Its result is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm import bpe, decontaminate, near_dedup, quality, secret_scan
from tidelog.llm.common import bound_batches, saved, scratch, table
from tidelog.llm.queries import tokenizer_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject; it learns from the given labels
    and the documents that are labelled."""
    bound_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates."""
    bound_batches(spark)
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item was found."""
    bound_batches(spark)
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, each secret replaced by the name of its kind.

    ``n_chars`` follows the new text where the table has it.
    """
    bound_batches(spark)
    return secret_scan.redact(docs, secret_scan.scan_secrets(docs, scratch(spark, "ledger")))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of every row."""
    bound_batches(spark)
    return bpe.encode_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_classifier", quality_stage),
    ("near_dedup", dedup_stage),
    ("decontamination", decontaminate_stage),
    ("secret_scan", secrets_stage),
    ("bpe_encoding", encode_stage),
]

#: No SQL: the classifier and the tokenizer cannot be expressed; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
