"""Interval joins by bins: an equi-join on (key, bin), then the exact test. No cross join, whatever the intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binned(df: DataFrame, start: Column, end: Column, width: int) -> DataFrame:
    """df with a row for each bin that [start, end) touches."""
    return df.withColumn("__bin", F.explode(F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width))))


def contained(outer: DataFrame, inner: DataFrame, key: str, width: int = 16384) -> DataFrame:
    """outer(key, o_start, o_end, ...) with the inner(key, i_start, i_end, ...) that lie inside them. An inner interval has one bin, its start's."""
    i = inner.withColumn("__bin", F.floor(F.col("i_start") / width))
    return binned(outer, F.col("o_start"), F.col("o_end"), width).join(i, [key, "__bin"]).where("o_start <= i_start and i_end <= o_end").drop("__bin")


def overlaps(a: DataFrame, b: DataFrame, key: str, width: int = 16384) -> DataFrame:
    """a(key, a_start, a_end, ...) with b(key, b_start, b_end, ...) that they overlap; each pair once, in the bin where both have begun."""
    first = F.floor(F.greatest("a_start", "b_start") / width)
    both = binned(a, F.col("a_start"), F.col("a_end"), width).join(binned(b, F.col("b_start"), F.col("b_end"), width), [key, "__bin"])
    return both.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("__bin") == first)).drop("__bin")


def points_within(intervals: DataFrame, points: DataFrame, key: str, width: int = 16384) -> DataFrame:
    """intervals(key, o_start, o_end, ...) with the points(key, at, ...) in them."""
    p = points.withColumn("__bin", F.floor(F.col("at") / width))
    return binned(intervals, F.col("o_start"), F.col("o_end"), width).join(p, [key, "__bin"]).where("o_start <= at and at < o_end").drop("__bin")


def highest_within(intervals: DataFrame, points: DataFrame, key: str, score: str, width: int = 16384) -> DataFrame:
    """(interval's columns, at, score): of the points(key, at, score) in each interval the highest score at every position."""
    return points_within(intervals, points, key, width).groupBy(*intervals.columns, "at").agg(F.max(score).alias(score))


def pair_quality(first: DataFrame, second: DataFrame, max_gap: int, match: int = 2, sub_diff: int = 8) -> DataFrame:
    """Best pair of each fragment as in pair_hits, with the quality of both hits drawn towards the pair's.

    first and second: (frag, rid, rev, rs, re, score, mapq). The pair's quality is the better of both, at most what its lead over the
    second pair allows, less for each pair within sub_diff of it. A hit below it takes four fifths of it; a pair without an equal leaves no hit at 0.
    """
    columns = ("rev", "rs", "re", "score", "mapq")
    a = first.select("frag", "rid", *[F.col(c).alias(f"{c}1") for c in columns])
    b = second.select("frag", "rid", *[F.col(c).alias(f"{c}2") for c in columns])
    total = F.col("score1") + F.col("score2")
    pairs = a.join(b, ["frag", "rid"]).where((F.col("rev1") != F.col("rev2")) & (F.greatest("rs1", "rs2") - F.least("re1", "re2") <= max_gap)).withColumn("pair_score", total)
    order = Window.partitionBy("frag").orderBy(F.desc("pair_score"), "rid", "rs1", "rs2", F.desc("rev1"), F.desc("re1"), F.desc("re2"))
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top = F.first("pair_score").over(all_)
    rows = pairs.withColumns({"__nth": F.row_number().over(order), "__next": F.nth_value("pair_score", 2).over(all_), "__top": top})
    rows = rows.withColumn("__subs", F.count_if(F.col("pair_score") + sub_diff >= F.col("__top")).over(all_)).where("__nth = 1")
    lead = F.col("__top") - F.col("__next")
    allowed = (6.02 * lead / F.lit(float(match)) - 4.343 * F.log(F.col("__subs").cast("double"))).cast("int")
    pair = F.least(F.greatest("mapq1", "mapq2"), F.coalesce(allowed, F.greatest("mapq1", "mapq2")))
    least = F.when(F.col("__next").isNull(), 2).when(lead > 0, 1).otherwise(0)
    drawn = lambda q: F.greatest(F.when(F.col(q) < F.col("__pair"), (0.2 * F.col(q) + 0.8 * F.col("__pair") + 0.499).cast("int")).otherwise(F.col(q)), least)
    return rows.withColumn("__pair", pair).select("frag", "rid", "rev1", "rs1", "re1", "rs2", "re2", "pair_score", drawn("mapq1").alias("mapq1"), drawn("mapq2").alias("mapq2"))


def pair_hits(first: DataFrame, second: DataFrame, max_gap: int) -> DataFrame:
    """Hits of a fragment's two reads on one target, on opposite strands, whose span leaves at most max_gap bases between them.

    first and second: (frag, rid, rev, rs, re, score). Returns the best pair of each fragment; ties go to the leftmost.
    """
    a = first.select("frag", "rid", *[F.col(c).alias(f"{c}1") for c in ("rev", "rs", "re", "score")])
    b = second.select("frag", "rid", *[F.col(c).alias(f"{c}2") for c in ("rev", "rs", "re", "score")])
    gap = F.greatest("rs1", "rs2") - F.least("re1", "re2")
    pairs = a.join(b, ["frag", "rid"]).where((F.col("rev1") != F.col("rev2")) & (gap <= max_gap))
    best = F.max_by(F.struct("rid", "rev1", "rs1", "re1", "rs2", "re2"), F.struct((F.col("score1") + F.col("score2")).alias("s"), -F.col("rid"), -F.col("rs1"), -F.col("rs2")))
    return pairs.groupBy("frag").agg(best.alias("p"), F.max(F.col("score1") + F.col("score2")).alias("pair_score"), F.count("*").alias("pairs")).select("frag", "p.*", "pair_score", "pairs")
