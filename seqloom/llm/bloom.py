"""A blocked Bloom filter as a table (block, word): blocks of 64 bits, a few of them for each key. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys for each block of 64 bits, and bits for each key.
KEYS_A_BLOCK, PROBES = 4, 4
#: A filter of at most so many blocks (16 bytes each) is broadcast; a larger one is joined by a shuffle.
BROADCAST_BLOCKS = 1 << 16


def _block(key: Column, blocks: int) -> Column:
    return F.xxhash64(key).bitwiseAND(blocks - 1)


def _bits(key: Column) -> Column:
    h = F.xxhash64(key, F.lit(1))
    out = F.lit(0).cast("long")
    for k in range(PROBES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(63).cast("int")))
    return out


def build(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """((block, word), number of blocks)."""
    blocks = 1 << max(0, (keys.count() // KEYS_A_BLOCK).bit_length())
    words = keys.select(_block(F.col(key), blocks).alias("block"), _bits(F.col(key)).alias("bits"))
    return words.groupBy("block").agg(F.bit_or("bits").alias("word")), blocks


def probe(rows: DataFrame, key: Column, words: DataFrame, blocks: int) -> DataFrame:
    """rows with __possible: false only for keys that are not in the filter; null keys are not."""
    words = words.select(F.col("block").alias("__block"), F.col("word").alias("__word"))
    if blocks <= BROADCAST_BLOCKS:
        words = F.broadcast(words)
    bits = _bits(key)
    hit = F.coalesce(key.isNotNull() & (bits.bitwiseAND(F.col("__word")) == bits), F.lit(False))
    return rows.join(words, _block(key, blocks) == F.col("__block"), "left").withColumn("__possible", hit).drop("__block", "__word")
