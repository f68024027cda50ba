"""Sketches of sequences: minimizers, homopolymer-compressed minimizers, open syncmers and randstrobes.

Each is a narrow transformation of (id, seq) to rows (id, ord, pos, hash, span, strand): no shuffle, one pass, vectorised within
a sequence. For syncmers and randstrobes sequences are cut into runs of known bases; each run is sketched by itself. Minimizers see an
unknown base as a place without a seed that starts the count of bases anew, while the minimum so far stays; sequences with
such bases are walked from minimum to minimum.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nucleotide import CODE, HALVES, hash_kmers, kmers, runs_of
from ..session import bounded_batches

SEEDS = "ord int, pos int, hash long, span int, strand int"
Sketch = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def sliding(op: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """op over each window of w elements, by windows of 1, 2, 4 and more."""
    out, have = x, 1
    while 2 * have <= w:
        out, have = op(out[: len(out) - have], out[have:]), 2 * have
    return op(out[: len(x) - w + 1], out[w - have : len(x) - have + 1]) if have < w else out


def window_minima(x: np.ndarray, w: int) -> np.ndarray:
    """Which of x are the minimum of a window of w.

    All ties of a window count, but for the first: its last element replaces the last minimum before it if it is not larger.
    With fewer than w elements the last minimum is taken.
    """
    return windows_minima(x, np.array([0, len(x)]), w)


def windows_minima(x: np.ndarray, bounds: np.ndarray, w: int) -> np.ndarray:
    """window_minima of the parts of x between bounds, each by itself; x is not negative."""
    n = len(x)
    out = np.zeros(n, bool)
    starts, sizes = bounds[:-1], np.diff(bounds)
    if n >= w:
        low = sliding(np.minimum, x, w)
        for j in range(1, w):  # windows of several parts take no place
            across = bounds[1:-1] - j
            low[across[(across >= 0) & (across < len(low))]] = 0
        edge = np.zeros(w - 1, x.dtype)
        np.equal(x, sliding(np.maximum, np.concatenate((edge, low, edge)), w), out=out)
    for few in (False, True):  # parts of w elements and more, then of less
        at = starts[(sizes > 0) & ((sizes < w) == few)]
        if not len(at) or w == 1:
            continue
        place = at[:, None] + np.arange(w - 1)
        size = sizes[(sizes > 0) & ((sizes < w) == few)]
        inside = np.arange(w - 1) < size[:, None]
        head = np.where(inside, x[np.minimum(place, n - 1)], np.array(np.iinfo(x.dtype).max, x.dtype))
        least = head.min(1)
        tie = inside & (head == least[:, None])
        last = place[np.arange(len(at)), w - 2 - tie[:, ::-1].argmax(1)]
        if few:
            out[place[inside]] = False
            out[last] = True
        else:
            fresh = x[at + w - 1] <= least
            out[place[fresh][tie[fresh]]] = True
            out[last[fresh]] = False
    return out


NO_SEED = np.uint64(2**64 - 1)


def walk_minima(x: np.ndarray, run: np.ndarray, w: int, k: int) -> np.ndarray:
    """Places of the minima of x, by jumps from one to the next.

    run: how many k-mers (or beginnings of one) there are up to a place since the last unknown base. A minimum counts when a place at most as large comes up
    in a run of w + k at least, or when it has left the window in one of w + k - 1; so do all ties in the window where a minimum is
    looked for anew, and those in the window of the run's place w + k - 1. The last minimum counts in any case.
    """
    n, out = len(x), []
    firsts = np.flatnonzero(run == w + k - 1)
    nth, m = 0, 0
    while n:
        beside = np.flatnonzero(x[m + 1 : m + w] <= x[m])
        t = m + 1 + int(beside[0]) if len(beside) else m + w
        seed = x[m] != NO_SEED
        while nth < len(firsts) and firsts[nth] <= t:
            s = int(firsts[nth])
            nth += 1
            if seed:
                lo = max(0, s - w + 1)
                out += [i for i in (lo + np.flatnonzero(x[lo:s] == x[m])).tolist() if i != m]
        if t >= n:
            if seed:
                out.append(m)
            break
        if x[t] <= x[m]:
            if seed and run[t] >= w + k:
                out.append(m)
            m = t
            continue
        full = run[t] >= w + k - 1
        if seed and full:
            out.append(m)
        lo = t - w + 1
        window = x[lo : t + 1]
        ties = lo + np.flatnonzero(window == window.min())
        m = int(ties[-1])
        if full and x[m] != NO_SEED:
            out += ties[:-1].tolist()
    return np.sort(np.array(out, np.int64))


def minimizers(raw: np.ndarray, w: int, k: int, hpc: bool = False) -> Sketch:
    """(position of the last base, hash, span, strand) of a sequence's bytes.

    hpc: of the sequence of runs of equal bytes; spans and positions count all bases, seeds of equal hash are told apart by span, and spans over 255 give no seed.
    """
    none = (np.zeros(0, np.int64),) * 4
    if not len(raw):
        return none
    codes = CODE[raw]
    known = codes < 4
    ends = np.flatnonzero(np.concatenate((raw[1:] != raw[:-1], [True])) | ~known) if hpc else np.arange(len(raw))
    length = np.diff(np.concatenate(([-1], ends)))
    units, unknown = known[ends], np.flatnonzero(~known[ends])
    of = np.flatnonzero(units)  # the k-mer at a unit is of the last k known ones, over unknown bases too
    forward, backward, _ = kmers(codes[ends[of]], k)
    short = min(k - 1, len(of))
    twin = np.zeros(len(ends), bool)
    twin[of[short:]] = forward == backward  # such k-mers have no place
    start = np.cumsum(units & ~twin)
    before = np.zeros(len(ends), np.int64)
    before[unknown] = start[unknown]
    run = np.where(units, start - np.maximum.accumulate(before), 0)
    total = np.cumsum(np.where(units, length, 0))[of]
    span = np.full(len(ends), 256)
    span[of[short:]] = total[short:] - np.concatenate(([0], total))[: len(total) - short] if hpc else k
    x = np.full(len(ends), NO_SEED)
    h = np.zeros(len(ends), np.uint64)
    h[of[short:]] = hash_kmers(np.minimum(forward, backward), k)
    strand = np.zeros(len(ends), np.int32)
    strand[of[short:]] = forward > backward
    good = units & (run >= k) & (span < 256)
    x[good] = h[good] << np.uint64(8) | span[good].astype(np.uint64)
    places = np.flatnonzero(~twin)
    if len(unknown):
        at = places[walk_minima(x[places], run[places], w, k)]
    else:
        places = places[run[places] >= k]
        at = places[window_minima(x[places], w)]
        at = at[x[at] != NO_SEED]
    return ends[at], h[at], span[at], strand[at]


#: Bases of reads that are sketched at once: their arrays stay in a processor's cache.
CHUNK = 1 << 16


def plain_minimizers(codes: np.ndarray, bounds: np.ndarray, w: int, k: int) -> tuple[np.ndarray, Sketch]:
    """(each seed's part, its sketch) of the parts of codes between bounds: minimizers() of many sequences of known bases at once, for odd k."""
    forward, backward = runs_of(codes, k) if len(codes) >= k else (np.zeros(0, np.uint64),) * 2
    h = hash_kmers(np.minimum(forward, backward), k)
    size = np.maximum(np.diff(bounds) - k + 1, 0)
    to = np.concatenate(([0], np.cumsum(size)))
    if to[-1] < len(h):  # without k-mers that lie across a bound
        inside = np.ones(len(h), bool)
        gaps = bounds[1:-1, None] - np.arange(1, k)
        low = bounds[:-2, None]
        gaps = gaps[gaps >= low]
        inside[gaps[gaps < len(h)]] = False
        inside[bounds[-1] - k + 1 :] = False
        forward, backward, h = forward[inside], backward[inside], h[inside]
    at = np.flatnonzero(windows_minima(h, to, w))
    part = np.searchsorted(to, at, "right") - 1
    return part, (at - to[part] + (k - 1), h[at], np.full(len(at), k), (forward[at] > backward[at]).astype(np.int32))


def syncmers(codes: np.ndarray, k: int, s: int) -> Sketch:
    """Open syncmers: the first least s-mer is at an end of the k-mer. Positions are of the first base; strand by the lesser hash."""
    u = np.uint64
    forward, backward, _ = kmers(codes, k)
    f, b = hash_kmers(forward, k), hash_kmers(backward, k)
    bits, mask = np.where(f <= b, forward, backward), u((1 << 2 * s) - 1)

    def mixed(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            for _ in range(2):
                x = ((x ^ (x >> u(16))) * u(0x45D9F3B)) & mask
        return x ^ (x >> u(16))

    inner = np.stack([mixed((bits >> u(2 * j)) & mask) for j in range(k - s + 1)]) if len(bits) else np.zeros((1, 0), u)
    first = inner.argmin(0)
    at = np.flatnonzero((first == 0) | (first == k - s))
    return at, np.minimum(f, b)[at], np.full(len(at), k), (f > b)[at].astype(np.int32)


def randstrobes(codes: np.ndarray, k: int, w_min: int, w_max: int) -> Sketch:
    """Order-2 randstrobes: each k-mer with the k-mer w_min to w_max further on that has the least coupled hash."""
    u = np.uint64
    if len(codes) < k + w_max:
        return (np.zeros(0, np.int64),) * 4
    forward, backward, _ = kmers(codes, k)
    f, b = hash_kmers(forward, k), hash_kmers(backward, k)
    h = np.minimum(f, b)
    n = len(codes) - k - w_max + 1
    least, gap = np.full(n, ~u(0)), np.full(n, w_min)
    with np.errstate(over="ignore"):
        for d in range(w_min, w_max + 1):
            inside = min(n, len(h) - d)
            x = h[:inside] ^ (h[d : d + inside] * u(0x9E3779B97F4A7C15))
            x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
            x ^= x >> u(31)
            better = x < least[:inside]
            least[:inside][better] = x[better]
            gap[:inside][better] = d
    return np.arange(n), least.view(np.int64), np.minimum(gap + k, 255), (f > b)[:n].astype(np.int32)


METHODS: dict[str, Callable[..., Sketch]] = {"minimizer": minimizers, "hpc": partial(minimizers, hpc=True), "syncmer": syncmers, "randstrobe": randstrobes}


class SeedFilter:
    """A bitmap that tells most hashes that a table does not have; it lets all through that the table has."""

    #: Bits at most, 16 MB; beyond some millions of hashes it lets more of the others through.
    MOST_BITS = 1 << 27

    def __init__(self, hashes: DataFrame, number: int) -> None:
        """Of the column hash of a table of so many rows, by one job; 256 bits a row, so that of other hashes one in some hundreds comes through."""
        self.mask = min(self.MOST_BITS, 1 << max(16, (256 * number - 1).bit_length())) - 1
        low = F.col("hash").bitwiseAND(self.mask)
        found = hashes.groupBy(F.bitmap_bucket_number(low + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(low + 1)).alias("bits")).collect()
        bits = bytearray(self.mask + 1 >> 3)
        for r in found:
            at = (r["bucket"] - 1) * len(r["bits"])
            bits[at : at + len(r["bits"])] = r["bits"]
        self.bits = hashes.sparkSession.sparkContext.broadcast(bytes(bits))

    def passes(self, h: np.ndarray) -> np.ndarray:
        low = h.view(np.uint64) & np.uint64(self.mask)
        bits = np.frombuffer(self.bits.value, np.uint8)[(low >> np.uint64(3)).astype(np.int64)]
        return np.flatnonzero(bits >> (low & np.uint64(7)).astype(np.uint8) & 1)


def sketch(df: DataFrame, method: str = "minimizer", id_col: str = "id", seq_col: str = "seq", carry: Sequence[str] = (), only: SeedFilter | None = None, **parameters: int) -> DataFrame:
    """Rows of the sketch of each sequence; ord numbers them by position. Null sequences have none.

    A binary seq_col has two bases a byte, in the low two bits of its halves. carry: columns of df that each row repeats. only: seeds that this
    filter lets through; rows then have len, the sequence's bases, and seeds, the number of all its seeds.
    """
    kind = METHODS[method]
    kept = df.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"), *carry).where("seq is not null")
    fast = method == "minimizer" and parameters["k"] % 2

    def of(raw: np.ndarray) -> Sketch:
        if method in ("minimizer", "hpc"):
            return kind(raw, **parameters)
        codes = CODE[raw]
        bad = np.flatnonzero(codes > 3)
        if not len(bad):
            return kind(codes, **parameters)
        cuts = [-1, *bad.tolist(), len(codes)]
        parts = [(a + 1, kind(codes[a + 1 : z], **parameters)) for a, z in zip(cuts, cuts[1:], strict=False) if z > a + 1]
        if not parts:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate([p[i] + (a if i == 0 else 0) for a, p in parts]) for i in range(4))

    def together(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, Sketch]:
        """(each seed's sequence, its sketch) of the sequences between bounds."""
        if fast and (codes := CODE[raw]).max(initial=0) < 4:
            return plain_minimizers(codes, bounds, **parameters)
        found = [of(raw[a:z]) for a, z in zip(bounds, bounds[1:], strict=False)]
        part = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
        return part, tuple(np.concatenate([x[i] for x in found]) for i in range(4))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.empty(1 << 24, np.uint8)  # once such a block is freed, glibc keeps memory for smaller ones instead of asking for pages anew for each array
        for batch in batches:
            data, bounds = _bases(batch.column(1))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + CHUNK, "right")) - 1)
                part, (pos, h, span, strand) = together(data(bounds[first], bounds[last]), bounds[first : last + 1] - bounds[first])
                counts = np.bincount(part, minlength=last - first)
                nth = np.arange(len(part)) - (np.cumsum(counts) - counts)[part]
                more = {}
                if only is not None:
                    through = only.passes(h)
                    part, nth, pos, h, span, strand = (x[through] for x in (part, nth, pos, h, span, strand))
                    more = {"len": np.diff(bounds[first : last + 1])[part], "seeds": counts[part]}
                if len(part):
                    rows = pa.array(part + first, pa.int64())
                    cols = {"ord": pa.array(nth, pa.int32()), "pos": pa.array(pos, pa.int32()), "hash": pa.array(h.view(np.int64) if h.dtype == np.uint64 else h, pa.int64()), "span": pa.array(span, pa.int32()), "strand": pa.array(strand, pa.int32())}
                    cols = {"id": batch.column(0).take(rows)} | cols | {c: pa.array(x, pa.int32()) for c, x in more.items()} | {c: batch.column(2 + i).take(rows) for i, c in enumerate(carry)}
                    yield pa.RecordBatch.from_pydict(cols)
                first = last

    bounded_batches(df.sparkSession)
    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, ", ".join([f"id {kinds['id']}", SEEDS, *(["len int, seeds int"] if only is not None else []), *[f"`{c}` {kinds[c]}" for c in carry]]))


def _bases(column: pa.Array) -> tuple[Callable[[int, int], np.ndarray], np.ndarray]:
    """(bytes of the bases from one to another, bounds of the sequences) of a column of texts or of two bases a byte."""
    packed = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    if not packed:
        sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
        if pa.compute.sum(pa.compute.utf8_length(column)).as_py() != sizes.sum():  # one byte for each character
            column = pa.array([x.encode("latin-1", "replace") for x in column.to_pylist()], pa.binary())
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    bounds = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    content = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if packed:
        return lambda a, z: HALVES[content[a // 2 : z // 2]].view(np.uint8), 2 * bounds
    return lambda a, z: content[a:z], bounds
