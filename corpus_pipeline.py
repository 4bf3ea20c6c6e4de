"""Corpus pipeline: ``documents`` through language ID, quality rules, near-duplicate removal, PII redaction and packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. All but
the last return the columns of ``documents``; the last returns one row for each document left, with its place in the packed batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelworks.llm import language, neardup, packing, pii, quality
from parcelworks.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents in which the network, trained on a bounded sample of the labelled rows, recognises no language."""
    return language.stage(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that fail the base rules or the fences of their language and source."""
    return quality.stage(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps one document, that of the least id, of every group linked by five-word shingles and a similarity of 0.8."""
    return neardup.stage(docs, 80, 5)


def redact_pii(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Puts the kind in brackets for every personal span of the texts; ``n_chars`` is counted anew."""
    return pii.stage(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, lang, source, text and the document's length, bucket, batch and padding."""
    packed = packing.pack(docs, ["doc_id", "lang", "source", "text"])
    return packed.select("row.*", "n_tokens", "bucket", "batch", "padding")


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("redact_pii", redact_pii),
    ("pack_batches", pack_batches),
]

#: The stages learn from the data; no SQL says the same. A brute-force version of each stage is in the tests.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
