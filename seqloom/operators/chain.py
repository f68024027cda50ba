"""Chains of collinear anchors: greedy (window functions only) and by dynamic programming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nucleotide import log2_fast
from ..session import bounded_batches
from .seeds import with_lengths

CHAIN = "rid long, rev boolean, score int, cnt int, qs int, qe int, rs int, re int"


def _bounds(rows: DataFrame, *keys: str) -> DataFrame:
    """Chains from anchors grouped by keys: query and reference intervals on the forward strand of each."""
    g = rows.groupBy("id", "rid", "rev", *keys).agg(
        F.sum("span").cast("int").alias("score"),
        F.count("*").cast("int").alias("cnt"),
        F.min_by(F.struct("query_pos", "ref_pos", "span"), F.struct("ref_pos", "query_pos")).alias("a"),
        F.max_by(F.struct("query_pos", "ref_pos"), F.struct("ref_pos", "query_pos")).alias("z"),
        F.first("len").alias("len"),
    )
    q0, q1 = F.col("a.query_pos") + 1 - F.col("a.span"), F.col("z.query_pos") + 1
    return g.select(
        "id", "rid", "rev", "score", "cnt",
        F.when(F.col("rev"), F.col("len") - q1).otherwise(q0).cast("int").alias("qs"),
        F.when(F.col("rev"), F.col("len") - q0).otherwise(q1).cast("int").alias("qe"),
        F.greatest(F.col("a.ref_pos") + 1 - F.col("a.span"), F.lit(0)).cast("int").alias("rs"),
        (F.col("z.ref_pos") + 1).cast("int").alias("re"),
    )


def greedy_chains(anchors: DataFrame, lengths: DataFrame | None, max_gap: int = 5000, bandwidth: int = 500) -> DataFrame:
    """Runs of anchors, in order of reference position, without a step back, a gap over max_gap or a shift of the diagonal over bandwidth."""
    w = Window.partitionBy("id", "rid", "rev").orderBy("ref_pos", "query_pos")
    dr, dq = F.col("ref_pos") - F.lag("ref_pos").over(w), F.col("query_pos") - F.lag("query_pos").over(w)
    cut = F.coalesce((dr > max_gap) | (dq < 0) | (dq > max_gap) | (F.abs(dr - dq) > bandwidth), F.lit(True))
    rows = with_lengths(anchors, lengths).withColumn("__cut", cut.cast("int")).withColumn("__chain", F.sum("__cut").over(w))
    return _bounds(rows, "__chain")


def link_scores(dr: np.ndarray, dq: np.ndarray, span: np.ndarray, gap_pen: float, skip_pen: float) -> np.ndarray:
    """Gain of an anchor that follows another by dr and dq bases: new bases less the gap's and the distance's cost."""
    f = np.float32
    gap, near = np.abs(dr - dq), np.minimum(dr, dq)
    gain = np.minimum(span, near)
    linear = f(gap_pen) * gap.astype(f) + f(skip_pen) * near.astype(f)
    log = np.where(gap >= 1, log2_fast(gap + 1), f(0))
    return gain - np.where((gap > 0) | (near > span), (linear + f(0.5) * log).astype(np.int32), 0)


#: Anchors of a group whose pairs are weighed in one go.
AT_ONCE = 256


def best_links(ref: np.ndarray, query: np.ndarray, span: np.ndarray, max_dist: int, bandwidth: int, gap_pen: float, skip_pen: float, max_iter: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """(best score, predecessor or -1) of each anchor by dynamic programming over those before it; of equals the nearest."""
    n = len(ref)
    best, before = span.astype(np.int64).copy(), np.full(n, -1)
    if n <= min(AT_ONCE, max_iter):  # the gains of all pairs at once; then a sum and a maximum for each anchor
        dr, dq = ref[:, None] - ref, query[:, None] - query
        i, j = np.nonzero((dq > 0) & (dq <= max_dist) & (dr > 0) & (dr <= max_dist) & (np.abs(dr - dq) <= bandwidth))
        gains = np.full((n, n), np.iinfo(np.int64).min // 2)
        gains[i, n - 1 - j] = link_scores(dr[i, j], dq[i, j], span[j], gap_pen, skip_pen)
        back = best[::-1]  # from the last anchor to the first: of equals argmax takes the nearest
        for i in np.unique(i).tolist():
            s = back[n - i :] + gains[i, n - i :]
            k = int(s.argmax())
            if s[k] > best[i]:
                best[i], before[i] = s[k], i - 1 - k
        return best, before
    lo = np.searchsorted(ref, ref - max_dist, "left")
    for i in range(n):
        a = max(lo[i], i - max_iter)
        if a == i:
            continue
        dr, dq = ref[i] - ref[a:i], query[i] - query[a:i]
        ok = np.flatnonzero((dq > 0) & (dq <= max_dist) & (dr > 0) & (np.abs(dr - dq) <= bandwidth))
        if len(ok):
            s = best[a + ok] + link_scores(dr[ok], dq[ok], span[a + ok], gap_pen, skip_pen)
            k = len(s) - 1 - int(np.argmax(s[::-1]))
            if s[k] > best[i]:
                best[i], before[i] = s[k], a + ok[k]
    return best, before


def read_chains(best: np.ndarray, before: np.ndarray, bandwidth: int, min_cnt: int, min_score: int) -> list[tuple[int, list[int]]]:
    """[(score, anchors' places)]: read back from the best ends, each up to anchors already used, and cut where the score has dropped by more than bandwidth from its peak."""
    n = len(best)
    used, out = np.zeros(n, bool), []
    for end in sorted(range(n), key=lambda i: (-best[i], -i)):
        if used[end] or best[end] < min_score:
            continue
        path, i = [], end
        peak = 0
        while i >= 0 and not used[i]:
            path.append(i)
            i = before[i]
            rest = best[end] - (best[i] if i >= 0 else 0)
            if rest > peak:
                peak, keep = rest, len(path)
            elif peak - rest > bandwidth:
                break
        path = path[: keep if peak else 0]
        if not path:
            continue
        stop = before[path[-1]]
        score = int(best[end] - (best[stop] if stop >= 0 else 0))
        used[path] = True
        if score >= min_score and len(path) >= min_cnt:
            out.append((score, path[::-1]))
    return out


def chain_group(ref: np.ndarray, query: np.ndarray, span: np.ndarray, max_dist: int, bandwidth: int, min_cnt: int, min_score: int, gap_pen: float, skip_pen: float, max_iter: int = 5000, inner: int | None = None) -> list[tuple[int, list[int]]]:
    """[(score, anchors' places)] of one read, target and strand; anchors are sorted by reference position. inner: chain by range minima, with that inner distance."""
    if inner is None:
        best, before = best_links(ref, query, span, max_dist, bandwidth, gap_pen, skip_pen, max_iter)
    else:
        best, before = rmq_scores(ref, query, span, max(max_dist, bandwidth), gap_pen, skip_pen, bandwidth, inner)
    return read_chains(best, before, bandwidth, min_cnt, min_score)


I32 = pa.int32()
POINT = pa.struct([(c, I32) for c in ("ref_pos", "query_pos", "span")])
ROW = pa.schema([("id", pa.int64()), ("rid", pa.int64()), ("rev", pa.bool_()), ("score", I32), ("cnt", I32), ("qs", I32), ("qe", I32), ("rs", I32), ("re", I32), ("mlen", pa.int64()), ("blen", pa.int64()), ("anchors", pa.list_(POINT))])
CHAINS = f"id long, {CHAIN}, mlen long, blen long, anchors array<struct<ref_pos: int, query_pos: int, span: int>>"


def _rows(key: tuple, found: pa.Scalar, **options) -> Iterator[tuple]:
    """Chains of one group: key is (id, rid, rev, read's length), found its anchors by place."""
    ref, query, span = (found.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    read, rid, rev, n = key
    for score, path in chain_group(ref, query, span, **options):
        a, z = path[0], path[-1]
        q0, q1 = int(query[a] + 1 - span[a]), int(query[z] + 1)
        dr, dq = np.diff(ref[path]), np.diff(query[path])
        mlen = int(span[a] + np.minimum(np.minimum(dr, dq), span[path[1:]]).sum())
        blen = int(span[a] + np.maximum(dr, dq).sum())
        where = (n - q1, n - q0) if rev else (q0, q1)
        yield (read, rid, rev, score, len(path), *where, max(0, int(ref[a] + 1 - span[a])), int(ref[z] + 1), max(0, mlen), max(0, blen), [(int(ref[i]), int(query[i]), int(span[i])) for i in path])


def _chained(groups: DataFrame, **options) -> DataFrame:
    """Chains of groups(id, rid, rev, len, points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key, found in zip(zip(*[b.column(k).to_pylist() for k in range(4)], strict=True), b.column(4), strict=True):
                rows.extend(_rows(key, found, **options))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW.types, strict=True)], schema=ROW)

    bounded_batches(groups.sparkSession)
    return groups.select(F.col("id").cast("long").alias("id"), F.col("rid").cast("long").alias("rid"), "rev", "len", "points").mapInArrow(run, CHAINS)


def dp_chains(anchors: DataFrame, lengths: DataFrame | None, max_dist: int = 5000, bandwidth: int = 500, min_cnt: int = 3, min_score: int = 40, gap_pen: float = 0.8 * 0.01 * 19, skip_pen: float = 0.0, inner: int | None = None) -> DataFrame:
    """Chains by dynamic programming, or by range minima if there is an inner distance, with mlen and blen (matches and block length by their
    seeds); each read, target and strand is a group of its own, so a read's targets spread over tasks.

    anchors: the ends of a chain's seeds, (reference, query, span), on the strand of the chain.
    """
    # groups of too few anchors or bases make no chain: they never reach Python
    points = F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("ref_pos", "query_pos", "span")]))).alias("points")
    groups = with_lengths(anchors, lengths).groupBy("id", "rid", "rev", "len").agg(points, F.sum("span").alias("bases"))
    groups = groups.where((F.size("points") >= min_cnt) & (F.col("bases") >= min_score))
    return _chained(groups, max_dist=max_dist, bandwidth=bandwidth, min_cnt=min_cnt, min_score=min_score, gap_pen=gap_pen, skip_pen=skip_pen, inner=inner)


def rescue_chains(chains: DataFrame, lengths: DataFrame, max_dist: int, bandwidth: int, min_cnt: int, min_score: int, gap_pen: float, skip_pen: float, inner: int, least_bare: int = 1000, least_share: float = 0.1) -> DataFrame:
    """Chains of dp_chains, where reads of several chains are chained again, from the anchors of these, by range minima within a wider bandwidth.

    So it is for reads whose first chain (by strand, target and place) leaves over least_bare bases or spans over least_share of the read.
    The others' rows pass through.
    """
    first = F.min(F.struct("rev", "rid", F.get("anchors", 0)["ref_pos"].alias("at"), (F.get("anchors", F.size("anchors") - 1)["query_pos"] - F.get("anchors", 0)["query_pos"]).alias("span"))).over(Window.partitionBy("id"))
    rows = chains.join(lengths, "id").withColumn("__span", first["span"]).withColumn("__n", F.count("*").over(Window.partitionBy("id")))
    wide = (F.col("__n") > 1) & ((F.col("len") - F.col("__span") > least_bare) | (F.col("__span") > F.floor(F.col("len") * F.lit(least_share))))
    # a row that stays is a group of its own, by its first anchor, which no other chain has
    key = F.when(~wide, F.get("anchors", 0)).alias("__own")
    whole = F.struct(*[F.col(c) for c in chains.columns])
    groups = rows.select("id", "rid", "rev", "len", "anchors", key, whole.alias("__row")).groupBy("id", "rid", "rev", "len", "__own").agg(F.sort_array(F.flatten(F.collect_list("anchors"))).alias("points"), F.first("__row").alias("__row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            stay = b.column(4).is_valid()
            for key, found in zip(zip(*[b.column(k).filter(pc.invert(stay)).to_pylist() for k in range(4)], strict=True), b.column(5).filter(pc.invert(stay)), strict=True):
                rows.extend(_rows(key, found, max_dist=max_dist, bandwidth=bandwidth, min_cnt=min_cnt, min_score=min_score, gap_pen=gap_pen, skip_pen=skip_pen, inner=inner))
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(b.column(6).filter(stay).flatten(), ROW.types, strict=True)], schema=ROW)
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(ROW)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ROW.types, strict=True)], schema=ROW)

    bounded_batches(chains.sparkSession)
    return groups.select("id", "rid", "rev", "len", "__own", "points", "__row").mapInArrow(run, CHAINS)


def rmq_scores(ref: np.ndarray, query: np.ndarray, span: np.ndarray, max_dist: int, gap_pen: float, skip_pen: float = 0.0, bandwidth: int | None = None, inner: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(best score, predecessor) with costs that only depend on both ends' diagonals, so the best predecessor is a range minimum.

    Anchors wait in a segment tree by query position; one that lies over max_dist back on the reference has been removed. Unless the best one
    follows without any cost, all within `inner` bases on both sequences are tried by their true scores. No link shifts by over bandwidth.
    """
    n = len(ref)
    order = np.argsort(query, kind="stable")
    rank = np.empty(n, int)
    rank[order] = np.arange(n)
    sorted_query = query[order]
    size = 1 << max(1, (n - 1).bit_length())
    tree: list[tuple[float, int]] = [(np.inf, -1)] * (2 * size)

    def put(i: int, value: tuple[float, int]) -> None:
        k = rank[i] + size
        tree[k] = value
        while k > 1:
            k >>= 1
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def least(a: int, z: int) -> tuple[float, int]:
        out, a, z = (np.inf, -1), a + size, z + size
        while a < z:
            if a & 1:
                out, a = min(out, tree[a]), a + 1
            if z & 1:
                z -= 1
                out = min(out, tree[z])
            a, z = a >> 1, z >> 1
        return out

    best, before, old, waiting = span.astype(np.int64).copy(), np.full(n, -1), 0, 0
    near = np.searchsorted(ref, ref - inner, "left")
    for i in range(n):
        while waiting < i and ref[waiting] < ref[i]:
            put(waiting, (-(best[waiting] + 0.5 * gap_pen * (ref[waiting] + query[waiting])), waiting))
            waiting += 1
        while old < waiting and ref[old] < ref[i] - max_dist:
            put(old, (np.inf, -1))
            old += 1
        _, j = least(np.searchsorted(sorted_query, query[i] - max_dist, "left"), np.searchsorted(sorted_query, query[i], "left"))
        if j < 0:
            continue
        dr, dq = int(ref[i] - ref[j]), int(query[i] - query[j])
        gain = int(link_scores(np.array([dr]), np.array([dq]), span[j : j + 1], gap_pen, skip_pen)[0])
        if (bandwidth is None or abs(dr - dq) <= bandwidth) and best[j] + gain > best[i]:
            best[i], before[i] = best[j] + gain, j
        if inner and (dr != dq or min(dr, dq) > span[j]):
            a, z = near[i], waiting
            x, y = ref[i] - ref[a:z], query[i] - query[a:z]
            ok = np.flatnonzero((x > 0) & (y > 0) & (y <= inner) & (np.abs(x - y) <= (max_dist if bandwidth is None else bandwidth)))
            if len(ok):
                s = best[a + ok] + link_scores(x[ok], y[ok], span[a + ok], gap_pen, skip_pen)
                k = len(s) - 1 - int(np.argmax(s[::-1]))
                if s[k] > best[i]:
                    best[i], before[i] = s[k], a + ok[k]
    return best, before
