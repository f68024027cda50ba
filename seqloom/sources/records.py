"""PAF, SAM and junction records from hits, and PAF read back. All DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paf(hits: DataFrame) -> DataFrame:
    """(id, rank, line) of hits(id, qname, qlen, qs, qe, rev, tname, tlen, rs, re, mlen, blen, mapq, cnt, score, rank, parent, second, rep_len)."""
    root = F.col("rank") == F.col("parent")
    kind = F.when(root, "P").otherwise("S")
    fields = ["qname", "qlen", "qs", "qe", F.when(F.col("rev"), "-").otherwise("+"), "tname", "tlen", "rs", "re", "mlen", "blen", "mapq"]
    tags = [F.concat(F.lit("tp:A:"), kind), F.concat(F.lit("cm:i:"), "cnt"), F.concat(F.lit("s1:i:"), "score"), F.when(root, F.concat(F.lit("s2:i:"), "second")), F.concat(F.lit("rl:i:"), "rep_len")]
    return hits.select("id", "rank", F.concat_ws("\t", *[F.col(c) if isinstance(c, str) else c for c in fields], *tags).alias("line"))


def paf_aligned(hits: DataFrame) -> DataFrame:
    """(id, rank, line) of aligned hits, with the CIGAR and the tags that follow from it."""
    root = F.col("rank") == F.col("parent")
    fields = ["qname", "qlen", "qs", "qe", F.when(F.col("rev"), "-").otherwise("+"), "tname", "tlen", "rs", "re", "mlen", "blen", "mapq"]
    tag = lambda name, kind, c: F.concat(F.lit(f"{name}:{kind}:"), c)
    tags = [tag("NM", "i", "nm"), tag("ms", "i", "dp_max"), tag("AS", "i", "as_"), tag("nn", "i", "nn"), tag("tp", "A", F.when(root, "P").otherwise("S")), tag("cm", "i", "cnt"), tag("s1", "i", "score"), F.when(root, tag("s2", "i", "second")), tag("de", "f", F.format_string("%.4f", "de")), tag("rl", "i", "rep_len"), tag("cg", "Z", "cigar"), tag("cs", "Z", "cs"), tag("MD", "Z", "md")]
    return hits.select("id", "rank", F.concat_ws("\t", *[F.col(c) if isinstance(c, str) else c for c in fields], *tags).alias("line"))


def parse_paf(lines: DataFrame) -> DataFrame:
    """The twelve fields of PAF lines(line), and a map of tags."""
    f = F.split("line", "\t")
    names = [("qname", "string"), ("qlen", "long"), ("qs", "long"), ("qe", "long"), ("strand", "string"), ("tname", "string"), ("tlen", "long"), ("rs", "long"), ("re", "long"), ("matches", "long"), ("blen", "long"), ("mapq", "int")]
    tags = F.map_from_entries(F.transform(F.slice(f, F.lit(13), F.greatest(F.size(f) - 12, F.lit(0))), lambda x: F.struct(F.substring(x, 1, 2), F.regexp_replace(x, "^.{0,5}", ""))))
    return lines.select(*[F.get(f, i).cast(t).alias(n) for i, (n, t) in enumerate(names)], tags.alias("tags"))


def unmapped(reads: DataFrame, hits: DataFrame) -> DataFrame:
    """(id, qname, flag, line): SAM lines of the reads without a hit."""
    lost = reads.join(hits.select("id").distinct(), "id", "left_anti")
    return lost.select("id", "qname", F.lit(4).alias("flag"), F.concat_ws("\t", "qname", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), "seq", F.coalesce("qual", F.lit("*"))).alias("line"))


def sam_flag(hit: dict[str, Column]) -> Column:
    """Flag bits of a single-end hit: reverse strand, secondary, supplementary."""
    return F.when(hit["rev"], 16).otherwise(0) + F.when(hit["secondary"], 256).otherwise(0) + F.when(hit["supplementary"], 2048).otherwise(0)


def sam(hits: DataFrame) -> DataFrame:
    """(id, rank, flag, line) of hits with a CIGAR: hits(id, rank, parent, qname, qlen, qs, qe, rev, tname, rs, mapq, cigar, seq, qual, nm, as_).

    Secondary hits have no sequence, supplementary ones are clipped hard, others soft. seq is the read's forward strand. Primary and
    supplementary hits of a read with several name the others in SA, best first.
    """
    from ..functions.nucleotide import revcomp

    secondary = F.col("rank") != F.col("parent")
    supplementary = ~secondary & (F.col("rank") > 0)
    clip = F.when(supplementary, "H").otherwise("S")
    left = F.when(F.col("rev"), F.col("qlen") - F.col("qe")).otherwise(F.col("qs"))
    right = F.when(F.col("rev"), F.col("qs")).otherwise(F.col("qlen") - F.col("qe"))
    ends = lambda n: F.when(n > 0, F.concat(n.cast("string"), clip)).otherwise("")
    seq = F.when(F.col("rev"), revcomp(F.col("seq"))).otherwise(F.col("seq"))
    qual = F.when(F.col("rev"), F.reverse("qual")).otherwise(F.col("qual"))
    part = lambda c: F.when(secondary, "*").when(supplementary, F.substring(c, left + 1, F.col("qlen") - left - right)).otherwise(c)
    flag = sam_flag({"rev": F.col("rev"), "secondary": secondary, "supplementary": supplementary})
    if "sa" in hits.columns:
        others = F.when(F.length("sa") > 0, F.concat(F.lit("SA:Z:"), "sa"))
    else:
        others = F.lit(None).cast("string")
    line = F.concat_ws("\t", "qname", flag, "tname", F.col("rs") + 1, "mapq", F.concat(ends(left), "cigar", ends(right)), F.lit("*\t0\t0"), part(seq), F.coalesce(part(qual), F.lit("*")), F.concat(F.lit("NM:i:"), "nm"), F.concat(F.lit("AS:i:"), "as_"), others)
    return hits.select("id", "rank", flag.alias("flag"), line.alias("line"))


def with_others(hits: DataFrame) -> DataFrame:
    """Aligned hits with sa: place, strand, CIGAR (one match, one gap, clips), quality and edit distance of the read's other hits that are not secondary."""
    root = F.col("rank") == F.col("parent")
    left, right = F.when(F.col("rev"), F.col("qlen") - F.col("qe")).otherwise(F.col("qs")), F.when(F.col("rev"), F.col("qs")).otherwise(F.col("qlen") - F.col("qe"))
    query, target = F.col("qe") - F.col("qs"), F.col("re") - F.col("rs")
    run = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    cigar = F.concat(run(left, "S"), run(F.least(query, target), "M"), run(query - target, "I"), run(target - query, "D"), run(right, "S"))
    text = F.concat(F.concat_ws(",", "tname", F.col("rs") + 1, F.when(F.col("rev"), "-").otherwise("+"), cigar, "mapq", "nm"), F.lit(";"))
    all_ = F.sort_array(F.collect_list(F.when(root, F.struct("rank", text.alias("text")))).over(Window.partitionBy("id")))
    sa = F.when(root, F.array_join(F.transform(F.filter(all_, lambda x: x["rank"] != F.col("rank")), lambda x: x["text"]), ""))
    return hits.withColumn("sa", sa)


def sam_header(targets: DataFrame) -> DataFrame:
    """(line): @HD, an @SQ for each of targets(rid, tname, tlen), @PG; ordered by place."""
    spark = targets.sparkSession
    head = spark.createDataFrame([(-1, "@HD\tVN:1.6\tSO:unsorted\tGO:query")], "place long, line string")
    foot = spark.createDataFrame([(2**62, "@PG\tID:seqloom\tPN:seqloom")], "place long, line string")
    lines = targets.select(F.col("rid").cast("long").alias("place"), F.concat(F.lit("@SQ\tSN:"), "tname", F.lit("\tLN:"), "tlen").alias("line"))
    return head.unionByName(lines).unionByName(foot).orderBy("place").select("line")


def junctions_of(hits: DataFrame, targets: DataFrame) -> DataFrame:
    """(tname, start, end, qname, score, strand): introns of hits(qname, tname, rs, cigar, trans_strand), scored by their ends.

    Ends count GT 3, GC 2, AT 1 and AG 3, AC 1, read on the transcript's strand. targets(tname, seq).
    """
    from ..functions.nucleotide import revcomp

    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHX=])"), F.lit(1))
    length = lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int")
    moves = F.transform(F.col("__ops"), lambda x: F.when(x.rlike("[MDN=X]$"), length(x)).otherwise(0))
    before = F.transform(F.col("__ops"), lambda x, i: F.struct(x.alias("op"), (F.col("rs") + F.aggregate(F.slice("__moves", 1, i), F.lit(0), lambda a, y: a + y)).alias("start")))
    rows = hits.withColumn("__ops", ops).withColumn("__moves", moves).withColumn("__x", F.explode(before)).where(F.col("__x.op").endswith("N"))
    rows = rows.select("qname", "tname", "trans_strand", F.col("__x.start").alias("start"), (F.col("__x.start") + length(F.col("__x.op"))).alias("end")).join(targets, "tname")
    left, right = F.upper(F.expr("substring(seq, start + 1, 2)")), F.upper(F.expr("substring(seq, end - 1, 2)"))
    plus = F.col("trans_strand") > 0
    donor, acceptor = F.when(plus, left).otherwise(revcomp(right)), F.when(plus, right).otherwise(revcomp(left))
    score = F.when(donor == "GT", 3).when(donor == "GC", 2).when(donor == "AT", 1).otherwise(0) + F.when(acceptor == "AG", 3).when(acceptor == "AC", 1).otherwise(0)
    return rows.select("tname", "start", "end", "qname", score.alias("score"), F.when(plus, "+").otherwise("-").alias("strand"))
