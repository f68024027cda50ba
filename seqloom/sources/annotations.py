"""Junctions, splice scores and lists of names from text files, by Spark's own readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("value <> '' and not value rlike '^(#|track|browser)'")
    return lines.select(F.split("value", "\t").alias("f"))


def _int(i: int) -> Column:
    return F.try_element_at(F.col("f"), F.lit(i + 1)).try_cast("int")


def introns_of(bed: DataFrame) -> DataFrame:
    """(contig, start, end, strand, score) of introns: of BED12 rows those between blocks, of shorter rows themselves. bed(f array<string>)."""
    bed = bed.where(F.size("f") >= 3).select("f", F.get("f", 0).alias("contig"), _int(1).alias("st"), _int(2).alias("en"), F.coalesce(F.get("f", 5), F.lit(".")).alias("strand"), F.coalesce(_int(4), F.lit(-1)).alias("score"))
    bed = bed.where("st is not null and en is not null and st >= 0 and st < en")
    ints = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int"))
    twelve = bed.where(F.size("f") >= 12).withColumn("sizes", ints(F.get("f", 10))).withColumn("starts", ints(F.get("f", 11)))
    between = F.transform(F.filter(F.sequence(F.lit(1), F.size("starts")), lambda i: i < F.size("starts")), lambda i: F.struct((F.col("st") + F.get("starts", i - 1) + F.get("sizes", i - 1)).alias("start"), (F.col("st") + F.get("starts", i)).alias("end")))
    introns = twelve.select("contig", "strand", "score", F.explode(between).alias("x")).select("contig", "x.start", "x.end", "strand", "score").where("start < end")
    return bed.where(F.size("f") < 12).select("contig", F.col("st").alias("start"), F.col("en").alias("end"), "strand", "score").unionByName(introns)


def read_junctions(spark: SparkSession, path: str) -> DataFrame:
    """Introns of a BED file; of equal intervals one stays, that of the least strand and then score."""
    first = F.min(F.struct("strand", "score")).alias("x")
    return introns_of(_fields(spark, path)).groupBy("contig", "start", "end").agg(first).select("contig", "start", "end", "x.strand", "x.score")


def jump_junctions(junctions: DataFrame, least_score: int = -1) -> DataFrame:
    """(contig, left, right, strand, flag): each intron from both of its ends, less those with a score from 0 to least_score."""
    j = junctions.where(~((F.col("score") >= 0) & (F.col("score") < least_score)))
    return j.select("contig", F.col("start").alias("left"), F.col("end").alias("right"), "strand").unionByName(j.select("contig", F.col("end").alias("left"), F.col("start").alias("right"), "strand"))


def read_splice_scores(spark: SparkSession, path: str, lengths: DataFrame, most: int, scale: float = 1.0) -> DataFrame:
    """(contig, at, strand, kind, score): scores scaled, rounded and held within most; sites strictly inside the contig. lengths(contig, len)."""
    rows = _fields(spark, path).where(F.size("f") >= 5).select(F.get("f", 0).alias("contig"), _int(1).alias("at"), F.get("f", 2).alias("strand"), F.get("f", 3).alias("kind"), _int(4).alias("score"))
    scaled = F.col("score") * F.lit(scale) + F.when(F.col("score") < 0, -0.499).otherwise(0.499) if 0 < scale < 1 else F.col("score")
    top = min(most, 63)
    rows = rows.where("at is not null and score is not null and strand in ('+', '-') and kind in ('D', 'A')").join(lengths, "contig").where("at > 0 and at < len").drop("len")
    return rows.withColumn("score", F.greatest(F.least(scaled.cast("int"), F.lit(top)), F.lit(-top)))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): the first word of each line."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S+)", 1).alias("name")).where("name <> ''").distinct()


def flag_names(targets: DataFrame, names: DataFrame, column: str = "is_alt") -> DataFrame:
    """targets with column: whether their name is in names."""
    return targets.join(names.select("name", F.lit(True).alias(column)), "name", "left").withColumn(column, F.coalesce(column, F.lit(False)))
