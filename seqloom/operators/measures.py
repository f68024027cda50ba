"""Small measures of seeds, anchors and hits, as window functions and expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_and_block_lengths(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mlen, blen) of each chain from its anchors alone: between two ends, the new bases count at most a seed's span as matches."""
    w = Window.partitionBy(*keys).orderBy("ref_pos", "query_pos")
    dr, dq = F.col("ref_pos") - F.lag("ref_pos").over(w), F.col("query_pos") - F.lag("query_pos").over(w)
    rows = anchors.withColumn("__near", F.least(dr, dq)).withColumn("__far", F.greatest(dr, dq))
    return rows.groupBy(*keys).agg(
        F.greatest(F.sum(F.coalesce(F.least("__near", "span"), "span")), F.lit(0)).cast("long").alias("mlen"),
        F.greatest(F.sum(F.coalesce("__far", "span")), F.lit(0)).cast("long").alias("blen"),
    )


def longest_stretch(anchors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, anchors): of the runs of anchors on one diagonal the one with most bases, the first of equals. first counts from 0."""
    w = Window.partitionBy(*keys).orderBy("ref_pos", "query_pos")
    dr, dq = F.col("ref_pos") - F.lag("ref_pos").over(w), F.col("query_pos") - F.lag("query_pos").over(w)
    rows = anchors.withColumn("__nth", F.row_number().over(w) - 1).withColumn("__new", F.coalesce(dr != dq, F.lit(True)))
    rows = rows.withColumn("__gain", F.when(F.col("__new"), F.col("span")).otherwise(F.least(dq, F.col("span"))))
    rows = rows.withColumn("__run", F.sum(F.col("__new").cast("int")).over(w))
    runs = rows.groupBy(*keys, "__run").agg(F.min("__nth").alias("first"), F.count("*").alias("anchors"), F.sum("__gain").alias("gain"))
    best = F.max_by(F.struct("first", "anchors"), F.struct("gain", -F.col("first"))).alias("x")
    return runs.groupBy(*keys).agg(best).select(*keys, F.col("x.first").cast("long").alias("first"), F.col("x.anchors").alias("anchors"))


def scale_alternative(score: Column, fraction: float) -> Column:
    """A score on an alternative contig: less by the fraction, rounded, at least 1; negative scores stay."""
    scaled = F.floor(score.cast("float") * (F.lit(1.0).cast("float") - F.lit(fraction).cast("float")) + F.lit(0.499).cast("float")).cast("int")
    return F.when(score < 0, score).otherwise(F.greatest(scaled, F.lit(1)))


def divergence(chains: DataFrame, matched: DataFrame, lengths: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Chains with div: 1 - (seeds matched / seeds passed)^(1/k), where ends that leave room for a seed count as one more passed.

    matched(id, pos): the reads' seeds that the index has. lengths(id, len); targets(rid, tlen).
    """
    places = matched.groupBy("id").agg(F.sort_array(F.collect_set("pos")).alias("__pos"))
    rows = chains.join(places, "id").join(lengths, "id").join(targets, "rid")
    passed = F.size(F.filter("__pos", lambda p: (p >= F.col("qs") + k - 1) & (p < F.col("qe"))))
    ends = F.when((F.col("qs") > k) & (F.col("rs") > k), 1).otherwise(0) + F.when((F.col("len") - F.col("qs") > k) & (F.col("tlen") - F.col("re") > k), 1).otherwise(0)
    total = passed + ends
    div = F.when(F.col("cnt") >= total, F.lit(0.0)).otherwise(1 - F.pow(F.col("cnt") / total, F.lit(1.0 / k)))
    return rows.withColumn("div", div).drop("__pos", "len", "tlen")


def segment_offsets(segments: DataFrame) -> DataFrame:
    """segments(frag, seg, len) with offset: bases of the fragment's segments before it."""
    before = Window.partitionBy("frag").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long"))


def mate_fields(hits: DataFrame) -> DataFrame:
    """Primary hits(frag, seg, tname, rev, rs, re) of two segments with rnext, pnext and template length; without a mate, their own place."""
    mate = hits.select("frag", (1 - F.col("seg")).alias("seg"), F.col("tname").alias("__t"), F.col("rev").alias("__rev"), F.col("rs").alias("__rs"), F.col("re").alias("__re"))
    both = hits.join(mate, ["frag", "seg"], "left")
    end = lambda rev, rs, re: F.when(F.col(rev), F.col(re) - 1).otherwise(F.col(rs))
    span = end("__rev", "__rs", "__re") - end("rev", "rs", "re")
    span = F.when(F.col("__t") == F.col("tname"), span + F.signum(span).cast("int")).otherwise(0)
    rnext = F.when(F.col("__t").isNull() | (F.col("__t") == F.col("tname")), "=").otherwise(F.col("__t"))
    return both.select(*hits.columns, rnext.alias("rnext"), (F.coalesce("__rs", "rs") + 1).alias("pnext"), span.cast("long").alias("tlen"))


def _mix32(x: np.ndarray) -> np.ndarray:
    """Thomas Wang's 32-bit integer hash."""
    u = np.uint32
    x = x + ~(x << u(15))
    x = x ^ (x >> u(10))
    x = x + (x << u(3))
    x = x ^ (x >> u(6))
    x = x + ~(x << u(11))
    return x ^ (x >> u(16))


def read_hash(names: list[str | None], lengths: np.ndarray, seed: int = 11) -> np.ndarray:
    """A read's number for breaking ties, from its name (None: no name) and length."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(names), np.uint32)
        for i, name in enumerate(names):
            b = (name or "").encode()
            v = b[0] if b else 0
            for c in b[1:]:
                v = (31 * v + c) & 0xFFFFFFFF
            h[i] = v
        return _mix32(h ^ (_mix32(lengths.astype(np.uint32)) + _mix32(np.array([seed], np.uint32))))
