"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import bounded_batches, delete, discard, materialize, shared_path, shared_root

__all__ = ["bounded_batches", "delete", "discard", "materialize", "shared_path", "shared_root"]

#: White space between words: the space and the bytes 09 to 0D.
WORD_GAP = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[pa.Array]:
    """A column of a batch in runs of rows of about `most` bytes, for work that needs many times a text's bytes."""
    rows = max(1, len(column) * most // max(1, column.nbytes))
    for a in range(0, len(column), rows):
        yield column.slice(a, rows)


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def crc_of_id(name: str = "doc_id"):
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary"))


def free_name(taken: list[str], wanted: str) -> str:
    """wanted, or wanted with underscores before it, so that it clashes with none of the columns."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted = "_" + wanted
    return wanted


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add: its own take the place of earlier ones."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])
