"""Ranking a read's hits: parents, secondary hits, mapping quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_hits(chains: DataFrame, by: str = "score") -> DataFrame:
    """With rank from 0: by score (or another column), then number of anchors, then place."""
    w = Window.partitionBy("id").orderBy(F.desc(by), F.desc("cnt"), "rid", "rev", "rs", "qs")
    return chains.withColumn("rank", F.row_number().over(w) - 1)


def best_hit(chains: DataFrame) -> DataFrame:
    return rank_hits(chains).where("rank = 0").drop("rank")


def parents_of(qs: np.ndarray, qe: np.ndarray, mask_level: float, mask_len: int) -> np.ndarray:
    """Parent of each of a read's hits, which come best first; a hit without one is its own.

    A hit belongs to the first earlier primary that it overlaps by more than mask_level of the shorter of both, less the part of the
    hit that no primary covers over the longer; a hit with over mask_len uncovered bases is primary. Hits of no length are, too, but hide none.
    """
    out = np.arange(len(qs))
    primaries: list[int] = [0] if len(qs) else []
    for i in range(1, len(qs)):
        s, e = int(qs[i]), int(qe[i])
        if e <= s:
            continue
        over = sorted((max(s, int(qs[p])), min(e, int(qe[p]))) for p in primaries if qe[p] > s and qs[p] < e)
        covered, at = 0, s
        for a, z in over:
            covered += max(0, z - max(a, at))
            at = max(at, z)
        bare = (e - s) - covered
        for p in primaries if over and bare <= mask_len else ():
            length = int(qe[p] - qs[p])
            overlap = min(e, int(qe[p])) - max(s, int(qs[p]))
            if overlap > 0 and length > 0 and np.float32(overlap) / np.float32(min(length, e - s)) - np.float32(bare) / np.float32(max(length, e - s)) > np.float32(mask_level):
                out[i] = out[p]
                break
        else:
            primaries.append(i)
    return out


def assign_parents(chains: DataFrame, mask_level: float = 0.5, mask_len: int = 2**31 - 1, by: str = "score") -> DataFrame:
    """Ranked chains with parent, the rank of the hit that hides it. A read's hits are one row of arrays on their way to Python and back."""
    ranked = rank_hits(chains, by)

    @F.pandas_udf("array<int>")
    def parents(qs: pd.Series, qe: pd.Series) -> pd.Series:
        return pd.Series([parents_of(a, z, mask_level, mask_len).astype(np.int32) if len(a) > 1 else np.zeros(len(a), np.int32) for a, z in zip(qs, qe, strict=True)])

    hits = ranked.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in ranked.columns if c not in ("id", "rank")]))).alias("hits"))
    hits = hits.withColumn("parents", parents(F.col("hits.qs"), F.col("hits.qe")))
    return hits.select("id", F.explode(F.arrays_zip("hits", "parents")).alias("h")).select(*["id" if c == "id" else F.col(f"h.hits.{c}") for c in ranked.columns], F.col("h.parents").alias("parent"))


def second_best(hits: DataFrame) -> DataFrame:
    """Hits with second (best score among those that each hides) and n_sub (how many of them have as many anchors)."""
    family = Window.partitionBy("id", "parent")
    root = F.col("rank") == F.col("parent")
    cnt = F.max(F.when(root, F.col("cnt"))).over(family)
    rows = hits.withColumn("__cnt", cnt).withColumn("__second", F.max(F.when(~root, F.col("score"))).over(family))
    rows = rows.withColumn("__subs", F.count_if(~root & (F.col("cnt") >= F.col("__cnt"))).over(family))
    rows = rows.withColumn("second", F.when(root, F.coalesce("__second", F.lit(0))).otherwise(0)).withColumn("n_sub", F.when(root, F.col("__subs")).otherwise(0))
    return rows.drop("__cnt", "__second", "__subs")


def select_secondary(hits: DataFrame, ratio: float = 0.8, min_diff: int = 38, best_n: int = 5) -> DataFrame:
    """Primary hits, and of the others at most best_n of a read that come near their parent's score and lie elsewhere."""
    primary = F.col("rank") == F.col("parent")
    at = F.struct("rid", "rev", "rs", "re", "qs", "qe")
    family = Window.partitionBy("id", "parent")
    both = hits.withColumn("__parent", F.max(F.when(primary, F.struct("score", at.alias("at")))).over(family))
    near = (F.col("score") >= F.col("__parent.score") * F.lit(ratio).cast("float")) | (F.col("score") + min_diff >= F.col("__parent.score"))
    both = both.withColumn("__kept", ~primary & near & (at != F.col("__parent.at")))
    nth = F.row_number().over(Window.partitionBy("id", "__kept").orderBy("rank"))
    return both.where(primary | F.col("__kept")).withColumn("__nth", nth).where(primary | (F.col("__nth") <= best_n)).drop("__parent", "__kept", "__nth")


def long_enough(hits: DataFrame, min_cnt: int, min_matches: int, min_dp_score: int, max_clip: float = 1.0) -> DataFrame:
    """Aligned hits(cnt, mlen, dp_max, qs, qe, qlen) with enough anchors, matches and score; of those clipped at both ends, by more than max_clip of the read, none."""
    clip = F.col("qlen").cast("float") * F.lit(max_clip).cast("float")
    clipped = (F.col("qs") > clip) & (F.col("qlen") - F.col("qe") > clip)
    return hits.where((F.col("cnt") >= min_cnt) & (F.col("mlen") >= min_matches) & (F.col("dp_max") >= min_dp_score) & ~clipped)


def mapping_quality(hits: DataFrame, repetitive: DataFrame, min_score: int = 40) -> DataFrame:
    """Hits of a read, with second and n_sub as second_best gave them before any was dropped, with mapq as for chains without base alignment, and rep_len.

    repetitive(id, rep_len).
    """
    f = lambda c: c.cast("float")
    read = Window.partitionBy("id")
    root = F.col("rank") == F.col("parent")
    rows = hits.join(repetitive, "id", "left").withColumn("rep_len", F.coalesce("rep_len", F.lit(0).cast("long"))).withColumn("__sum", F.sum(F.when(root, F.col("score"))).over(read))
    unique = F.when(F.col("__sum") > 0, f(F.col("__sum")) / (f(F.col("__sum")) + f(F.col("rep_len")))).otherwise(F.lit(1.0))
    by_score = F.when(F.col("score") > 100, F.lit(1.0)).otherwise(0.01 * F.col("score")) * unique
    by_count = F.when(F.col("cnt") > 10, F.lit(1.0)).otherwise(0.1 * F.col("cnt"))
    x = F.greatest("second", F.lit(min_score)) / F.col("score")
    q = F.least(by_score, by_count) * 40.0 * (1 - x) * F.log(F.col("score").cast("double"))
    q = F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)) - F.floor(4.343 * F.log(F.col("n_sub") + 1.0) + 0.499)
    mapq = F.when(root, F.least(F.greatest(q, F.lit(0)), F.lit(60))).otherwise(0).cast("int")
    return rows.withColumn("mapq", mapq).drop("__sum")


def rescale_scores(hits: DataFrame, match: int, mismatch: int, fraction: float = 0.9) -> DataFrame:
    """Hits(id, dp_max, qs, qe, qlen, mlen, blen, nn, gap_bases, gaps, log_gaps) with dp_max fitted to the best hit's divergence.

    Only where a read's best hit covers most of it and the second comes near: then mismatches and gaps weigh by half over the divergence.
    """
    read = Window.partitionBy("id")
    order = read.orderBy(F.desc("dp_max"), "rank")
    first = lambda c: F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = hits.withColumn("__top", F.max("dp_max").over(read)).withColumn("__next", F.nth_value("dp_max", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    events = F.col("blen") + F.col("nn") - F.col("gap_bases") + F.col("gaps")
    rows = rows.withColumn("__identity", F.when(events > 0, F.col("mlen") / events).otherwise(0.0))
    near = (first(F.col("qe") - F.col("qs")) >= first("qlen") * fraction) & (F.col("__next") >= F.col("__top") * fraction)
    weight = F.lit(0.5) / F.greatest(1 - first("__identity"), F.lit(0.02))
    weight = F.when(weight * match < mismatch, F.lit(match / mismatch)).otherwise(weight)
    rows = rows.withColumn("__near", F.coalesce(near, F.lit(False))).withColumn("__weight", weight)
    off = F.col("blen") + F.col("nn") - F.col("mlen") - F.col("gap_bases")
    new = match * (F.col("mlen") - F.col("__weight") * off - (F.col("gaps") * F.col("__weight") + F.col("log_gaps"))) + 0.499
    fitted = F.when(F.col("__near"), F.greatest(F.floor(new), F.lit(0)).cast("int")).otherwise(F.col("dp_max"))
    return rows.withColumn("dp_max", fitted).drop("__top", "__next", "__identity", "__near", "__weight")


def mapping_quality_aligned(hits: DataFrame, repetitive: DataFrame, match: int, min_score: int = 40) -> DataFrame:
    """Hits(id, rank, parent, score, cnt, mlen, blen, dp_max) with mapq from chains and base-level scores."""
    read, family = Window.partitionBy("id"), Window.partitionBy("id", "parent")
    root = F.col("rank") == F.col("parent")
    rows = hits.join(repetitive, "id", "left")
    total = F.sum(F.when(root, F.col("score"))).over(read)
    second = F.coalesce(F.max(F.when(~root, F.col("score"))).over(family), F.lit(0))
    second_dp = F.coalesce(F.max(F.when(~root, F.col("dp_max"))).over(family), F.lit(0))
    own_cnt = F.max(F.when(root, F.col("cnt"))).over(family)
    rows = rows.withColumns({"__sum": total, "__second": second, "__dp2": second_dp, "__cnt": own_cnt})
    rows = rows.withColumn("__subs", F.sum(F.when(~root & (F.col("cnt") >= F.col("__cnt")), 1).otherwise(0)).over(family))
    unique = F.when(F.col("__sum") > 0, F.col("__sum") / (F.col("__sum") + F.coalesce("rep_len", F.lit(0)))).otherwise(F.lit(1.0))
    sure = F.least(F.when(F.col("score") > 100, F.lit(1.0)).otherwise(0.01 * F.col("score")) * unique, F.when(F.col("cnt") > 10, F.lit(1.0)).otherwise(0.1 * F.col("cnt")))
    identity = F.when(F.col("blen") > 0, F.col("mlen") / F.col("blen")).otherwise(1.0)
    low = F.greatest("__second", F.lit(min_score)) / F.col("score")
    x = F.when(F.col("__dp2") > 0, F.col("__dp2") / F.col("dp_max") * low).otherwise(low)
    base = identity * sure * 40.0
    size = F.log(F.col("dp_max") / F.lit(float(match)))
    pair = F.floor(F.least(base * (1 - x * x) * size, 6.02 * identity * identity * (F.col("dp_max") - F.col("__dp2")) / match + 0.499))
    q = F.when(F.col("__dp2") > 0, pair).otherwise(F.floor(base * (1 - x) * size)) - F.floor(4.343 * F.log(F.col("__subs") + 1.0) + 0.499)
    q = F.least(F.greatest(q, F.lit(0)), F.lit(60))
    q = F.when((q == 0) & (F.col("dp_max") > F.col("__dp2")), 1).otherwise(q)
    return rows.withColumn("mapq", F.when(root & (F.col("dp_max") > 0), q).otherwise(0).cast("int")).drop("__sum", "__second", "__dp2", "__cnt", "__subs", "rep_len")
