"""SimHash near-duplicates: fingerprints, a grid join over segment popcounts, components.

A fingerprint's 64 bits fall into 32 segments of two; a fingerprint maps to the vector of the segments'
bit counts. One differing bit changes one count by one, so the Manhattan distance of two vectors is at
most the Hamming distance of their fingerprints. Counts 0, 1, 2 are kept as 00, 01, 11: the
distance of two vectors is then the number of differing bits of their codes.

Grid: eight axes of four counts (a byte of the code each). Vectors within distance 4 agree on at
least four of the axes, so each fingerprint goes to the 70 cells that choose four axes, and vectors in
range meet in a cell. Within a cell the vectors' distance and then the fingerprints' are tested.
A cell yields a spanning forest of its links, never its pairs. In cells of over CELL_LIMIT different
fingerprints, links are found through midpoints instead: two fingerprints within 4 bits share
a point within 2 bits of both, and each has 2081 such points, so the work grows with the cell's size.

Null or empty texts have no words and fingerprint zero, and link as any other. Repeated rows are kept, each with
its component. Rows with a null id take part; a component's id is its smallest id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, free_name, in_slices, materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
AXES = list(combinations(range(8), 4))
CELL_LIMIT = 8192
#: Shingles hashed at a time, a bound on memory for very long texts.
SLICE = 1 << 17

_u = np.uint64
_P1, _P2, _P3, _P4, _P5 = map(_u, (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << _u(r)) | (x >> _u(64 - r))


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many slices of a byte array at once. data must have 8 more bytes after the last slice."""
    seed = _u(seed)
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    halves = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    at, left = start.astype(np.int64), length.astype(np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(at), seed + _P5, _u)
        if len(long := np.flatnonzero(left >= 32)):
            acc = [np.full(len(long), v, _u) for v in (seed + _P1 + _P2, seed + _P2, seed, seed - _P1)]
            todo = np.arange(len(long))
            p, n = at[long], left[long]
            while len(todo):
                for k in range(4):
                    acc[k][todo] = _rot(acc[k][todo] + lanes[p[todo] + 8 * k] * _P2, 31) * _P1
                p[todo] += 32
                n[todo] -= 32
                todo = todo[n[todo] >= 32]
            mixed = _rot(acc[0], 1) + _rot(acc[1], 7) + _rot(acc[2], 12) + _rot(acc[3], 18)
            for v in acc:
                mixed = (mixed ^ (_rot(v * _P2, 31) * _P1)) * _P1 + _P4
            h[long] = mixed
            at, left = at.copy(), left.copy()
            at[long], left[long] = p, n
        h += length.astype(_u)
        for _ in range(3):
            if not len(i := np.flatnonzero(left >= 8)):
                break
            h[i] = _rot(h[i] ^ (_rot(lanes[at[i]] * _P2, 31) * _P1), 27) * _P1 + _P4
            at[i] += 8
            left[i] -= 8
        if len(i := np.flatnonzero(left >= 4)):
            h[i] = _rot(h[i] ^ (halves[at[i]].astype(_u) * _P1), 23) * _P2 + _P3
            at[i] += 4
            left[i] -= 4
        for _ in range(3):
            if not len(i := np.flatnonzero(left >= 1)):
                break
            h[i] = _rot(h[i] ^ (data[at[i]].astype(_u) * _P5), 11) * _P1
            at[i] += 1
            left[i] -= 1
        h ^= h >> _u(33)
        h *= _P2
        h ^= h >> _u(29)
        h *= _P3
        h ^= h >> _u(32)
    return h


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings and its offsets into them; nulls are empty."""
    texts = (texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts).fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def fingerprints(texts: pa.Array, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    data, offsets = _bytes_of(texts)
    n = len(offsets) - 1
    out = np.zeros(n, _u)
    if not len(data):
        return out
    word = ~_GAP[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    first[edges] = word[edges]
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(start):
        return out
    size = end - start
    joined = np.concatenate(([0], np.cumsum(size + 1)))  # the words with one space after each
    buffer = np.full(joined[-1] + 8, 32, np.uint8)
    buffer[np.flatnonzero(word) + np.repeat(joined[:-1] - start, size)] = _LOWER[data[word]]
    doc = np.searchsorted(offsets, start, "right") - 1
    head = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    count = np.diff(np.concatenate((head, [len(doc)])))
    shingles = np.maximum(count - words + 1, 1)
    ends = np.cumsum(shingles)
    begin = np.arange(ends[-1]) + np.repeat(head - (ends - shingles), shingles)
    stop = begin + np.repeat(np.minimum(count, words), shingles) - 1
    at, length = joined[begin], joined[stop] + size[stop] - joined[begin]
    owner = np.repeat(np.arange(len(head)), shingles)
    ones = np.zeros((len(head), 64), np.int64)
    for a in range(0, len(at), SLICE):
        part = owner[a : a + SLICE]
        bits = np.unpackbits(xxh64(buffer, at[a : a + SLICE], length[a : a + SLICE]).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ones[part[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    out[doc[head]] = np.packbits(2 * ones > shingles[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _text_hash(text_col: str) -> Column:
    """With the id it tells rows apart where ids are null or repeat."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def add_fingerprint(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, text_hash, fp): the fingerprint as a signed long. One row for each row of df."""
    bounded_batches(df.sparkSession)
    kept = df.select(F.col(f"`{id_col}`").alias("id"), _text_hash(text_col).alias("text_hash"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.concatenate([np.empty(0, _u), *[fingerprints(part) for part in in_slices(b.column(2))]])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], ["id", "text_hash", "fp"])

    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, text_hash long, fp long")


def codes(fp: np.ndarray) -> np.ndarray:
    """Counts of the two-bit segments as 00, 01 and 11."""
    low = _u(0x5555555555555555)
    a, b = fp & low, (fp >> _u(1)) & low
    return (a | b) | ((a & b) << _u(1))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False)
        axes = codes(fp.view(_u)).astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        for k, (p, q, r, s) in enumerate(AXES):
            cell = (k << 32) | (axes[:, p] << 24) | (axes[:, q] << 16) | (axes[:, r] << 8) | axes[:, s]
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(fp)], ["cell", "fp"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b, each node that isn't the smallest of its component, and that smallest node."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def links_in_runs(cell: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between fingerprints of equal cell; cell is sorted."""
    x, code = fp.view(_u), codes(fp.view(_u))
    ends = np.searchsorted(cell, cell, "right")
    i = np.flatnonzero(ends - np.arange(len(cell)) > 1)
    a, b, held = [], [], 0
    lag = 1
    while len(i):
        near = i[np.bitwise_count(code[i] ^ code[i + lag]) <= bits]
        near = near[np.bitwise_count(x[near] ^ x[near + lag]) <= bits]
        a.append(fp[near + lag])
        b.append(fp[near])
        held += len(near)
        if held > 400_000:
            p, q = forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [p], [q], len(p)
        lag += 1
        i = i[i + lag < ends[i]]
    if not held:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return forest(np.concatenate(a), np.concatenate(b))


def _links(bits: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell. Links (a, b); (a, a) marks a fingerprint of a crowded cell."""
        cell, fp, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None

        def out(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        def settle(c, f):
            size = np.searchsorted(c, c, "right") - np.searchsorted(c, c, "left")
            over = size > limit
            if over.any():
                yield out(f[over], f[over])
            if (some := ~over & (size > 1)).any():
                a, b = links_in_runs(c[some], f[some], bits)
                if len(a):
                    yield out(a, b)

        for batch in batches:
            c, f = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cell, fp = np.concatenate((cell, c)), np.concatenate((fp, f))
            if crowded is not None and len(same := fp[cell == crowded]):
                yield out(same, same)
                fp, cell = fp[cell != crowded], cell[cell != crowded]
            if len(cell) < limit and len(cell) < 50_000:
                continue
            cut = np.searchsorted(cell, cell[-1], "left")
            yield from settle(cell[:cut], fp[:cut])
            cell, fp = cell[cut:], fp[cut:]
            if len(cell) > limit:
                crowded = cell[-1]
                yield out(fp, fp)
                cell, fp = cell[:0], fp[:0]
        yield from settle(cell, fp)

    return run


def _midpoints(half: int):
    flips = np.array([sum(1 << k for k in c) for n in range(half + 1) for c in combinations(range(64), n)], _u)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for fp in b.column(0).to_numpy(zero_copy_only=False).view(_u):
                yield pa.RecordBatch.from_arrays([pa.array((flips ^ fp).view(np.int64)), pa.array(np.full(len(flips), fp, _u).view(np.int64))], ["cell", "fp"])

    return run


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell: neighbours of equal cell are linked, which joins all of the cell."""
    cell = fp = None
    for b in batches:
        c, f = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        if cell is not None:
            c, f = np.concatenate(([cell], c)), np.concatenate(([fp], f))
        if not len(c):
            continue
        same = (c[1:] == c[:-1]) & (f[1:] != f[:-1])
        if same.any():
            pairs = np.unique(np.stack((np.maximum(f[1:], f[:-1])[same], np.minimum(f[1:], f[:-1])[same])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])
        cell, fp = c[-1], f[-1]


def link_forest(fps: DataFrame, bits: int = MAX_BITS, limit: int = CELL_LIMIT) -> DataFrame:
    """Links (a, b) between the different fingerprints in fps(fp) that join all within `bits` of each other."""
    if bits > MAX_BITS:
        raise ValueError(f"the grid is laid out for distances up to {MAX_BITS}")
    spark = fps.sparkSession
    bounded_batches(spark)
    cells = fps.select("fp").mapInArrow(_cells, "cell long, fp long").repartition("cell").sortWithinPartitions("cell")
    found = materialize(cells.mapInArrow(_links(bits, limit), "a long, b long").distinct(), "simhash-links")
    links = found.where("a <> b")
    crowded = found.where("a = b").select(F.col("a").alias("fp"))
    if not crowded.isEmpty():
        points = crowded.repartition(max(8, spark.sparkContext.defaultParallelism)).mapInArrow(_midpoints((bits + 1) // 2), "cell long, fp long")
        chained = points.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_chains, "a long, b long").distinct()
        if bits < 2 * ((bits + 1) // 2):
            chained = chained.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        links = links.unionByName(chained)
    return links


def _print(links: DataFrame) -> tuple:
    """Equal for equal sets of links: their number and sums of both halves of their hashes."""
    h = F.xxhash64("v", "u")
    return tuple(links.agg(F.count("*"), F.sum(F.shiftrightunsigned(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links(a, b) the smallest node that it reaches.

    Each round ties every neighbour of a node to the smallest of its neighbourhood (larger ones first, then
    smaller), which halves paths; tables of two longs are written between rounds.
    """
    now = materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(), "links")
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select("v", F.col("m").alias("u"))
        large = materialize(large.distinct(), "links")
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x")).select("x.v", "x.u")
        new = materialize(small.where("u <> v").distinct(), "links")
        discard(large)
        if _print(now) == _print(new):
            break
        discard(now)
        now = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """(id, text_hash, fp, component_id) for each row of df."""
    docs = materialize(add_fingerprint(df, text_col, id_col), "simhash-fingerprints")
    fps = materialize(docs.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = components(link_forest(fps, bits))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    tied = fps.join(roots, fps.fp == roots.node)
    least = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    tied = tied.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    named = materialize(fps.join(tied, "fp", "left").select("fp", F.coalesce("component_id", "low").alias("component_id")), "simhash-components")
    return docs.join(named, "fp", "left").select("id", "text_hash", "fp", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = MAX_BITS) -> DataFrame:
    """The rows of df whose id is the smallest of their component; of repeated rows with that id, all stay.

    Rows without an id stay only where no row of their component has one.
    """
    out = near_duplicates(df, id_col, text_col, bits)
    key, text = free_name(df.columns, "dropped_id"), free_name(df.columns, "dropped_text")
    dropped = out.where("id <> component_id or (id is null and component_id is not null)").select(F.col("id").alias(key), F.col("text_hash").alias(text))
    dropped = materialize(dropped.distinct(), "simhash-dropped")
    return df.join(dropped, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (_text_hash(text_col) == F.col(text)), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
