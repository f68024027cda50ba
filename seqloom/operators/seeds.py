"""The seed index, and joins of reads' seeds to it. All DataFrame operations.

The index is a table of seeds with the number of their occurrences; a read's seeds meet it in an equi-join on the hash, after frequent
hashes have been cut, so a repeat never multiplies before it is pruned. Spark picks a broadcast only when the index is small.

Seeds that come through a filter of the targets' hashes (sketch's `only`) bring the read's bases, len, and the number of all its seeds, seeds; then
nothing is joined or counted for these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_lengths(rows: DataFrame, lengths: DataFrame | None) -> DataFrame:
    """rows(id) with len, by lengths(id, len) if they have none."""
    return rows if "len" in rows.columns else rows.join(lengths, "id")


def occurrences(seeds: DataFrame) -> DataFrame:
    """(hash, occ)."""
    return seeds.groupBy("hash").agg(F.count("*").alias("occ"))


def added_up(seeds: DataFrame, shard: Column) -> DataFrame:
    """(hash, occ) from counts by shard. Seeds are dealt out by hash once, which serves both counts."""
    counted = seeds.select(shard.alias("shard"), "hash").repartition("hash").groupBy("shard", "hash").agg(F.count("*").alias("n"))
    return counted.groupBy("hash").agg(F.sum("n").alias("occ"))


def build_index(target_seeds: DataFrame, max_occ: int | None = None) -> DataFrame:
    """(hash, rid, tpos, tstrand, occ) without hashes of more than max_occ occurrences."""
    counts = occurrences(target_seeds)
    counts = counts.where(F.col("occ") <= max_occ) if max_occ else counts
    return target_seeds.select("hash", F.col("id").alias("rid"), F.col("pos").alias("tpos"), F.col("strand").alias("tstrand")).join(counts, "hash")


def save_index(index: DataFrame, path: str) -> None:
    """Parquet, clustered by hash, so that readers skip row groups by hash."""
    index.repartitionByRange("hash").sortWithinPartitions("hash", "rid", "tpos").write.parquet(path)


def mid_occ(counts: DataFrame, fraction: float = 2e-4, least: int = 10, most: int = 0) -> DataFrame:
    """One row mid_occ: one more than the count at rank int((1 - fraction) n) of the hashes' counts, within least and most.

    The counts' histogram is summed, which has few rows, instead of sorting all hashes.
    """
    histogram = counts.groupBy("occ").agg(F.count("*").alias("hashes"))
    upto = Window.orderBy("occ").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = histogram.agg(F.sum("hashes").alias("n"))
    ranked = histogram.withColumn("upto", F.sum("hashes").over(upto)).crossJoin(F.broadcast(total))
    rank = F.least(F.floor((1 - F.lit(fraction)) * F.col("n")), F.col("n") - 1)
    out = F.greatest(F.coalesce(F.min(F.when(F.col("upto") > rank, F.col("occ"))) + 1, F.lit(1)), F.lit(max(least, 1)))
    out = F.least(out, F.lit(most)) if most > least else out
    return ranked.agg(out.cast("long").alias("mid_occ"))


def drop_repeats_in_query(seeds: DataFrame, most: int, fraction: float) -> DataFrame:
    """Without seeds that one read has more than `most` times and in over a fraction of its seeds, of reads with over `most` seeds."""
    counted = seeds.withColumn("__same", F.count("*").over(Window.partitionBy("id", "hash", "span")))
    counted = counted.withColumn("__all", F.col("seeds") if "seeds" in seeds.columns else F.count("*").over(Window.partitionBy("id")))
    often = (F.col("__all") > most) & (F.col("__same") > most) & (F.col("__same") > F.floor(F.col("__all") * F.lit(fraction)))
    return counted.where(~often).drop("__same", "__all")


def flag_tandem(seeds: DataFrame) -> DataFrame:
    """With tandem: whether a neighbouring seed of the read has the same hash."""
    w = Window.partitionBy("id").orderBy("ord")
    return seeds.withColumn("tandem", F.coalesce(F.lag("hash").over(w) == F.col("hash"), F.lit(False)) | F.coalesce(F.lead("hash").over(w) == F.col("hash"), F.lit(False)))


def select_seeds(matched: DataFrame, lengths: DataFrame | None, max_occ: int, max_max_occ: int, distance: int) -> DataFrame:
    """matched(id, ord, pos, span, occ) with kept: in each run of frequent seeds the rarest few stay, one for each `distance` bases.

    lengths(id, len). A run lies between seeds of at most max_occ occurrences; ties go to the earlier; none of over max_max_occ stays.
    """
    w = Window.partitionBy("id").orderBy("ord")
    often = F.col("occ") > max_occ
    rare = F.when(~often, F.col("pos"))
    rows = with_lengths(matched, lengths).withColumn("__run", F.sum(F.when(often, 0).otherwise(1)).over(w)).withColumn("__before", F.max(rare).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # the next rare seed by a walk from the end: a frame that ends with the read would be read anew for every row
    rows = rows.withColumn("__after", F.min(rare).over(Window.partitionBy("id").orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)))
    quota = F.least(F.floor((F.coalesce("__after", "len") - F.coalesce("__before", F.lit(0))) / F.lit(float(distance)) + 0.499), F.lit(128))
    nth = F.row_number().over(Window.partitionBy("id", "__run", often).orderBy("occ", "ord"))
    rows = rows.withColumn("kept", ~often | ((nth <= quota) & (F.col("occ") <= max_max_occ)))
    return rows.drop("__run", "__before", "__after", *([] if "len" in matched.columns else ["len"]))


def choose_seeds(read_seeds: DataFrame, counts: DataFrame, lengths: DataFrame | None, mid_occ: int, max_occ: int, distance: int) -> DataFrame:
    """The reads' seeds that targets have, with occ and kept: those of at most mid_occ occurrences, and of the others what select_seeds keeps.

    counts(hash, occ) are the targets'. Without a distance, or with max_occ not above mid_occ, none of the others stays.
    """
    matched = read_seeds.join(counts, "hash")
    if distance > 0 and max_occ > mid_occ:
        return select_seeds(matched, lengths, mid_occ, max_occ, distance)
    return matched.withColumn("kept", F.col("occ") <= mid_occ)


def repetitive_length(dropped: DataFrame) -> DataFrame:
    """(id, rep_len): bases under seeds(id, pos, span) that were dropped for their frequency; a seed that only touches the last joins it."""
    start, end = F.col("pos") + 1 - F.col("span"), F.col("pos") + 1
    w = Window.partitionBy("id").orderBy("pos", "span")
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = dropped.select("id", "pos", start.alias("s"), end.alias("e"), reach.alias("reach"))
    rows = rows.select("id", F.greatest("s", F.coalesce("reach", "s")).alias("s"), "e")
    return rows.groupBy("id").agg(F.sum(F.greatest(F.col("e") - F.col("s"), F.lit(0))).cast("long").alias("rep_len"))


def anchors(read_seeds: DataFrame, index: DataFrame, lengths: DataFrame | None, max_occ: int, keep_len: bool = False) -> DataFrame:
    """(id, rid, rev, ref_pos, query_pos, span[, len]): matches of at most max_occ occurrences. On the reverse strand query_pos counts from the read's end."""
    hits = with_lengths(read_seeds.join(index.where(F.col("occ") <= max_occ), "hash"), lengths)
    rev = F.col("strand") != F.col("tstrand")
    query = F.when(rev, F.col("len") - F.col("pos") + F.col("span") - 2).otherwise(F.col("pos")).cast("int")
    return hits.select("id", "rid", rev.alias("rev"), F.col("tpos").alias("ref_pos"), query.alias("query_pos"), "span", *(["len"] if keep_len else []))


def all_vs_all(seeds: DataFrame, names: DataFrame, max_occ: int) -> DataFrame:
    """Anchors among reads: (qid, tid, rev, tpos, qpos), each pair of reads once (names in order), a read never with its own diagonal.

    names(id, name).
    """
    counts = occurrences(seeds).where(F.col("occ") <= max_occ)
    s = seeds.join(counts, "hash").join(names, "id")
    q = s.select("hash", F.col("id").alias("qid"), F.col("name").alias("qname"), F.col("pos").alias("qpos"), F.col("strand").alias("qs"))
    t = s.select("hash", F.col("id").alias("tid"), F.col("name").alias("tname"), F.col("pos").alias("tpos"), F.col("strand").alias("ts"))
    both = q.join(t, "hash").where((F.col("qname") <= F.col("tname")) & ~((F.col("qname") == F.col("tname")) & (F.col("qpos") == F.col("tpos"))))
    return both.select("qid", "tid", (F.col("qs") != F.col("ts")).alias("rev"), "tpos", "qpos")
