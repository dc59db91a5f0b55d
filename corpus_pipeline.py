"""From raw documents to packed sequences: quality rules, quality classifier, near-duplicates, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apotheca.llm import line_crf, minhash, personal_data, quality_rules, queries
from apotheca.llm.scratch import Table


def drop_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_documents(docs)


def drop_by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model, fitted on labelled raw documents, scores at 0.7 or more."""
    return line_crf.keep_documents(docs, queries.quality_model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return minhash.keep_one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the new text."""
    redacted = personal_data.redact_documents(docs, personal_data.fit(docs))
    return redacted.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return queries.packed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", drop_by_rules),
    ("quality_classifier", drop_by_classifier),
    ("minhash_near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack),
]

#: SQL can't express the learned stages; tests/llm/test_group_operators.py holds run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``; each one's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = Table(stage(spark, docs, sf_dir), name).df
    return STAGES[-1][1](spark, docs, sf_dir)
