"""Exact deduplication by distributed most-significant-digit radix partitioning.

Texts are split by their length and first FIRST_BYTES bytes, then by successive runs of bytes, each three times as long as all before it,
until a group has one text or its texts have ended; texts that stay together to the end are equal, without any digest. Only groups with
more than one row go on. Each split is an aggregation that combines on the map side, and a join of rows to the groups that are left: always
a merge join, whose plan is the same at any size, and which adaptive execution splits where one group holds many of the rows.

Rows are told apart by a number that a copy of the input has, written once; groups carry it through all splits. A set of rows is a
table of bitmaps, one for each BLOCK_ROWS row numbers, so the whole texts of a set are taken from the copy by a broadcast of one bit a row,
without a shuffle; beyond BROADCAST_BLOCKS bitmaps rows and bitmaps are joined by a shuffle.

Null texts count as empty. Null ids are allowed: a group's keeper is its largest id that is not null, or null. Rows that repeat id
and text are all returned; one of them, any, is the row that stays if theirs is the keeper. Rows of a group without any id
that isn't null keep one row too. Columns of any name may follow; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, lower_ascii, materialize, table

FIRST_BYTES = 64
#: After each split so many times the bytes before it have been read.
WIDEN = 4
#: Row numbers of a bitmap, and the bitmaps (512 bytes each) that are broadcast at most.
BLOCK_ROWS = 4096
BROADCAST_BLOCKS = 1 << 17


def _norm(text: Column) -> Column:
    return lower_ascii(F.coalesce(text.cast("string"), F.lit(""))).cast("binary")


def _bitmaps(rows: DataFrame, row: str) -> DataFrame:
    """(__block, __bits): of rows(row), the blocks with any, as 64 words of 64 bits."""
    at = F.col(row).bitwiseAND(BLOCK_ROWS - 1)
    words = rows.select(F.shiftright(row, 12).alias("__block"), F.shiftright(at, 6).cast("int").alias("__w"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int")).alias("__b"))
    words = words.groupBy("__block", "__w").agg(F.bit_or("__b").alias("__b"))
    found = F.map_from_entries(F.collect_list(F.struct("__w", "__b")))
    return words.groupBy("__block").agg(found.alias("__found")).select("__block", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.coalesce(F.col("__found")[k], F.lit(0).cast("long"))).alias("__bits"))


def rows_of(copy: DataFrame, row: str, rows: DataFrame, inside: bool, most_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """The rows of copy whose number is (inside) or is not in rows(row)."""
    maps = materialize(_bitmaps(rows, row), "dedup-bitmaps")
    few = maps.count() <= most_blocks
    block, bits = free_name(copy.columns, "block_of_rows"), free_name(copy.columns, "bits_of_rows")
    maps = maps.select(F.col("__block").alias(block), F.col("__bits").alias(bits))
    at = F.col(row).bitwiseAND(BLOCK_ROWS - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    has = F.coalesce(F.get(F.col(bits), F.shiftright(at, 6).cast("int")).bitwiseAND(bit) != 0, F.lit(False))
    both = copy.join(F.broadcast(maps) if few else maps, F.shiftright(row, 12) == F.col(block), "inner" if inside else "left")
    return both.where(has if inside else ~has).select(*[F.col(f"`{c}`") for c in copy.columns])


def numbered(df: DataFrame, row: str) -> DataFrame:
    """A copy of df with a number for each row, written so that the numbers stay."""
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), "dedup-copy")


def groups_of_equals(copy: DataFrame, row: str, id_col: str = "doc_id", text_col: str = "text", most_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(row, keep_row, keep_id, group_size) for the rows of a numbered table that have equal others."""
    text = _norm(F.col(f"`{text_col}`"))
    base = copy.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_col}`").alias("id"), text.alias("text"))
    keys = materialize(base.select("row", "id", F.length("text").alias("n"), F.substring("text", 1, FIRST_BYTES).alias("digit")), "dedup-keys")
    size, keep, new = F.count("*").alias("size"), F.max(F.struct("id", "row")).alias("keep"), F.monotonically_increasing_id().alias("new")
    split = materialize(keys.groupBy("n", "digit").agg(size, keep).where("size > 1").select(F.col("n").alias("of"), F.col("digit").alias("as"), "size", "keep", new), "dedup-groups")
    named = keys.join(split.hint("merge"), (F.col("n") == F.col("of")) & (F.col("digit") == F.col("as"))).select("row", "id", "n", "size", "keep", "new")
    named = materialize(named, "dedup-rows")
    equal = named.where(F.col("n") <= FIRST_BYTES).select("row", "size", "keep")
    left = named.where(F.col("n") > FIRST_BYTES).select("row", "id", "n", F.col("new").alias("gid"))
    rest = rows_of(base.select("row", "text"), "row", left.select("row"), True, most_blocks)
    live = materialize(rest.join(left.hint("merge"), "row").select("row", "id", "n", "gid", F.expr(f"substring(text, {FIRST_BYTES + 1})").alias("rest")), "dedup-live")
    at = FIRST_BYTES
    while not live.isEmpty():
        width = at * (WIDEN - 1)
        digit = F.substring("rest", 1, width)
        split = live.groupBy("gid", digit.alias("digit")).agg(size, keep).where("size > 1").select(F.col("gid").alias("of"), F.col("digit").alias("as"), "size", "keep", new)
        split = materialize(split, "dedup-groups")
        now = live.join(split.hint("merge"), (F.col("gid") == F.col("of")) & (digit == F.col("as")))
        at += width
        equal = equal.unionByName(materialize(now.where(F.col("n") <= at).select("row", "size", "keep"), "dedup-done"))
        longer = materialize(now.where(F.col("n") > at).select("row", "id", "n", F.col("new").alias("gid"), F.expr(f"substring(rest, {width + 1})").alias("rest")), "dedup-live")
        discard(live)
        live = longer
    return equal.select("row", F.col("keep.row").alias("keep_row"), F.col("keep.id").alias("keep_id"), F.col("size").alias("group_size"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row of df."""
    copy = numbered(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "row")
    equal = groups_of_equals(copy, "row", "id", "text", most_blocks)
    rows = copy.select("row", "id", F.sha2(_norm(F.col("text")), 256).alias("text_sha256")).join(equal, "row", "left")
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return rows.select("id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256")


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """The rows of df that stay, with its columns."""
    row = free_name(df.columns, "row_number")
    copy = numbered(df, row)
    gone = groups_of_equals(copy, row, id_col, text_col, most_blocks).where("row <> keep_row").select(F.col("row").alias(row))
    return rows_of(copy, row, gone, False, most_blocks).drop(row)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(t) text_sha256
from d window w as (partition by t)
"""
