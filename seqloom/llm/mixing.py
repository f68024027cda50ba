"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's rows, in an order shuffled by a hash, form blocks of `block_rows`. A source with share a of W
has block j (from 1) released at slot floor((j-1)W/a) and due at slot ceil(jW/a); in each slot the released block with the
earliest deadline runs. As the shares add up to one processor, every deadline is met and each source has, after any
t slots, less than one block more or less than t*a/W, as long as it has rows. A source that has run out leaves its slots empty
and the others keep theirs, so no row is lost and none is repeated.

The schedule repeats after W slots, so only one such period is simulated; rows find their slot by arithmetic
and a join to the period's W rows (at most MAX_SHARES, checked). Only narrow rows are ordered: a row's number in a written copy, its id and
its source. Its place among its source's comes from counts of hash buckets, so no source is gathered into one task; a
bucket of more than HOT rows (repeated rows, or rows without ids) is split by row number. Whole rows then meet their order in one
join by number and are dealt out once by ranges.

Null sources are a source of their own. Repeated rows each get a place of their own. Columns that are named like an added one are
replaced; other columns may have any name. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, table, without

BLOCK_ROWS = 16
MAX_SHARES = 100_000
#: Rows of a hash bucket, about; one of over HOT rows is split.
BUCKET_ROWS, HOT = 2_000, 8_000
#: Target shares of the query and of the pipeline; sources not listed have DEFAULT_SHARE.
SHARES = {"src0": 4, "src1": 2, "src2": 2}
DEFAULT_SHARE = 1
ADDED = ("seq", "block", "slot", "mix_order")


def schedule(shares: list[int]) -> list[tuple[int, int, int]]:
    """(source's number, its block from 0, slot) over one period of sum(shares) slots."""
    total = sum(shares)
    if any(a < 1 for a in shares):
        raise ValueError("shares are positive integers")
    waiting = [(0, i, 0) for i in range(len(shares))]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * total // shares[i]), i, j))
        due, i, j = heapq.heappop(ready)
        assert slot < due
        out.append((i, j, slot))
        if j + 1 < shares[i]:
            heapq.heappush(waiting, ((j + 1) * total // shares[i], i, j + 1))
    return out


def mixture(rows: DataFrame, shares: Mapping[str | None, int], default_share: int = DEFAULT_SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(row, seq, block, slot, mix_order) of written rows(row, id, source): seq is the place within the source; mix_order sorts the mixture."""
    spark = rows.sparkSession
    counts = rows.groupBy("source").count().orderBy("source").limit(MAX_SHARES + 1).collect()
    own = [shares.get(r["source"], default_share) for r in counts]
    if sum(own) > MAX_SHARES:
        raise ValueError(f"shares add up to {sum(own)}; at most {MAX_SHARES} are allowed")
    names = dict(rows.dtypes)["source"]
    sources = spark.createDataFrame([(r["source"], k, a) for k, (r, a) in enumerate(zip(counts, own, strict=True))], f"name {names}, s int, own long")
    period = spark.createDataFrame([(i, j, slot) for i, j, slot in schedule(own)] if own else [], "ps int, pj long, place long")
    bits = max(1, (sum(r["count"] for r in counts) // BUCKET_ROWS).bit_length())
    key = F.xxhash64("id", "source")
    keyed = rows.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name"))).select("row", "s", "own", key.alias("key"), F.shiftrightunsigned(key, 64 - bits).alias("bucket"))
    # there are few hot buckets, as each holds many times its due
    hot = materialize(keyed.groupBy("s", "bucket").count().where(F.col("count") > HOT).select(F.col("s").alias("hs"), F.col("bucket").alias("hb"), F.ceil(F.col("count") / BUCKET_ROWS).alias("parts")), "mix-hot")
    keyed = keyed.join(F.broadcast(hot), (F.col("s") == F.col("hs")) & (F.col("bucket") == F.col("hb")), "left").drop("hs", "hb")
    keyed = keyed.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0).cast("long")))
    per = materialize(keyed.groupBy("s", "bucket", "part").count(), "mix-counts")
    before = Window.partitionBy("s").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("s", "bucket", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("s", "bucket", "part").orderBy("key", "row")) - 1
    placed = keyed.withColumn("nth", within).join(per, ["s", "bucket", "part"])
    placed = placed.withColumn("seq", (F.col("before") + F.col("nth")).cast("long")).withColumn("block", F.floor(F.col("seq") / block_rows).cast("long"))
    placed = placed.join(F.broadcast(period), (F.col("s") == F.col("ps")) & (F.col("block") % F.col("own") == F.col("pj")))
    slot = F.floor(F.col("block") / F.col("own")).cast("long") * sum(own) + F.col("place")
    return placed.select("row", "seq", "block", slot.alias("slot"), (slot * block_rows + F.col("seq") % block_rows).alias("mix_order"))


def mix(df: DataFrame, shares: Mapping[str | None, int], default_share: int = DEFAULT_SHARE, block_rows: int = BLOCK_ROWS, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """df's rows with seq (place within the source), block, slot and mix_order (sorts the mixture). Columns of these names are replaced."""
    df = without(df, *ADDED)
    row = free_name(df.columns, "row_number")
    copy = materialize(df.withColumn(row, F.monotonically_increasing_id()), "mix-copy")
    rows = copy.select(F.col(f"`{row}`").alias("row"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"))
    order = mixture(rows, shares, default_share, block_rows).withColumnRenamed("row", row)
    return copy.join(order, row).select(*[F.col(f"`{c}`") for c in df.columns], *ADDED)


def mixed_rows(df: DataFrame, shares: Mapping[str | None, int] = SHARES, **options) -> DataFrame:
    """df's rows and columns, laid out in the order of the mixture: by partition, and within each."""
    return mix(df, shares, **options).repartitionByRange("mix_order").sortWithinPartitions("mix_order").select(*[F.col(f"`{c}`") for c in without(df, *ADDED).columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "source"), SHARES)
