"""The training-data pipeline: each stage's rows are written as Parquet and read as the next one's documents.

All stages but the last return the columns of documents. The last adds token_ids (little-endian unsigned 32-bit integers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import exact_dedup, mixing, rank_bpe, simhash, toxicity
from seqloom.llm.common import discard, materialize, table
from seqloom.session import ship


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, learned from the labels of these documents, does not reject."""
    return toxicity.reject_toxic(docs, table(ship(spark), sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the document with the largest id."""
    ship(spark)
    return exact_dedup.drop_exact_duplicates(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture."""
    ship(spark)
    return mixing.mixed_rows(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids."""
    ship(spark)
    return rank_bpe.encode_documents(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("byte_bpe", encoded),
]

#: The toxicity, near-duplicate and tokenizer stages cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(ship(spark), sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
