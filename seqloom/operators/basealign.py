"""From chains to base-level alignments: gaps between seeds are filled, ends are extended.

A chain brings its read's and its target's sequence by equi-joins; then each row is aligned by itself. Only the stretches between
seeds go through a matrix, and an end's matrix is held within max_gap bases
and what the shorter of both ends can pay for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotide import log2_fast, revcomp
from ..session import bounded_batches
from .pairwise import Scoring, align, cigar_ops, cigar_stats, cs_tag, md_tag, score_of_cigar, segment_max

#: Seeds nearer than this to the last one used are passed over.
SPACING = 64


def joined(parts: list[str]) -> str:
    """One CIGAR of several, equal neighbours merged."""
    out: list[list] = []
    for n, op in (x for p in parts for x in cigar_ops(p)):
        if out and out[-1][1] == op:
            out[-1][0] += n
        else:
            out.append([n, op])
    return "".join(f"{n}{op}" for n, op in out)


def reach(n: int, sc: Scoring, most: int) -> int:
    """Bases that an extension can take beside n bases of the other sequence before its gaps cost more than n matches bring; at most `most`."""
    gaps = [(n * sc.match - q) // e if e else most for q, e in ((sc.q, sc.e), (sc.q2, sc.e2)) if n * sc.match > q]
    return min(most, n + max(gaps, default=0))


def extend(query: str, target: str, sc: Scoring, max_gap: int) -> tuple[int, int, str]:
    """(query's bases, target's bases, CIGAR) of the best extension from both starts within max_gap bases."""
    m, n = min(len(query), max_gap), min(len(target), max_gap)
    _, _, dq, _, dt, cigar = align(query[: min(m, reach(n, sc, max_gap))], target[: min(n, reach(m, sc, max_gap))], sc, "extension")
    return dq, dt, cigar


def align_chain(query: str, target: str, anchors: list[tuple[int, int, int]], sc: Scoring, max_gap: int = 5000) -> tuple[int, int, int, int, str]:
    """(qs, qe, ts, te, CIGAR) of a chain on the query's strand; anchors are (reference end, query end, span), inclusive ends."""
    r0, q0, span = anchors[0]
    q, t = q0 - span + 1, r0 - span + 1
    dq, dt, left = extend(query[max(0, q - max_gap) : q][::-1], target[max(0, t - max_gap) : t][::-1], sc, max_gap)
    parts = ["".join(f"{n}{op}" for n, op in reversed(cigar_ops(left)))]
    qs, ts = q - dq, t - dt
    for k, (r, e, _) in enumerate(anchors):
        if k < len(anchors) - 1 and (e + 1 - q < SPACING or r + 1 - t < SPACING) and k > 0:
            continue
        x, y = query[q : e + 1], target[t : r + 1]
        parts.append(f"{len(x)}M" if x == y else align(x, y, sc)[5])
        q, t = e + 1, r + 1
    dq, dt, right = extend(query[q : q + max_gap], target[t : t + max_gap], sc, max_gap)
    return qs, q + dq, ts, t + dt, joined([*parts, right])


ALIGNED = "id long, rid long, rev boolean, qname string, qlen int, qs int, qe int, tname string, tlen int, rs int, re int, cnt int, score int, as_ int, dp_max int, nm int, mlen int, blen int, nn int, gap_bases int, gaps int, log_gaps double, de double, cigar string, md string, cs string"


def align_hits(hits: DataFrame, reads: DataFrame, targets: DataFrame, scoring: Scoring = Scoring(), max_gap: int = 5000) -> DataFrame:
    """Chains with anchors, with their base-level alignment and what follows from it. reads(id, qname, seq); targets(rid, tname, seq).

    as_ is the alignment's score, dp_max that of its best stretch with gaps by their logarithm.
    """
    q = reads.select("id", "qname", "seq")
    t = targets.select(F.col("rid").cast("long").alias("rid"), "tname", F.col("seq").alias("tseq"))
    rows = hits.join(q, "id").join(t, "rid").withColumn("oriented", F.when(F.col("rev"), revcomp(F.col("seq"))).otherwise(F.upper("seq")))
    names = [x.split()[0] for x in ALIGNED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h in batch.itertuples(index=False):
                target = h.tseq.upper()
                anchors = [(a["ref_pos"], a["query_pos"], a["span"]) for a in h.anchors]
                qs, qe, ts, te, cigar = align_chain(h.oriented, target, anchors, scoring, max_gap)
                s = cigar_stats(cigar, h.oriented, target, qs, ts)
                n = len(h.oriented)
                gaps = [k for k, op in cigar_ops(cigar) if op in "ID"]
                out.append((h.id, h.rid, h.rev, h.qname, n, *((n - qe, n - qs) if h.rev else (qs, qe)), h.tname, len(target), ts, te, h.cnt, h.score, score_of_cigar(cigar, h.oriented, target, scoring, qs, ts), segment_max(cigar, h.oriented, target, scoring, qs, ts), s["nm"], s["matches"], s["block_len"], s["nn"], sum(gaps), len(gaps), float(log2_fast(np.array(gaps) + 1).sum()) if gaps else 0.0, s["de"], cigar, md_tag(cigar, h.oriented, target, qs, ts), cs_tag(cigar, h.oriented, target, qs, ts)))
            yield pd.DataFrame(out, columns=names)

    spark = hits.sparkSession
    bounded_batches(spark)
    # alignment is heavy for few bytes: a shuffle of that size keeps tasks apart that adaptive execution would merge
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id", "rid")
    return rows.select("id", "rid", "rev", "qname", "tname", "tseq", "oriented", "cnt", "score", "anchors").mapInPandas(run, ALIGNED)
