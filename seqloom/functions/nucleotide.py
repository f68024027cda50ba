"""Scalar functions on sequences: as Column expressions, and as numpy kernels for the operators that need them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def dna_of_text(text: Column) -> Column:
    """Two bases for each byte of a text: equal substrings give equal bases."""
    return F.translate(F.hex(F.encode(text, "UTF-8")), "0123456789ABCDEF", BASES * 4)


def encode_nt4(seq: Column) -> Column:
    """Bases as digits 0 to 3 in either case; any other character is 4."""
    return F.translate(F.regexp_replace(seq, "[^ACGTacgt]", "4"), "ACGTacgt", "01230123")


def revcomp(seq: Column) -> Column:
    """Reverse complement in upper case: U pairs as T, other characters become N."""
    return F.reverse(F.translate(F.regexp_replace(F.translate(seq, "acgtu", "ACGTU"), "[^ACGTU]", "N"), "ACGTU", "TGCAA"))


def kmer_hash(bits: Column, k: int) -> Column:
    """Invertible hash of a k-mer's 2k bits. Each addend is masked before it is added, so no sum overflows a long for k up to 28."""
    m = (1 << 2 * k) - 1

    def times(x: Column, *shifts: int) -> Column:
        out = x
        for s in shifts:
            out = out + F.shiftleft(x, s).bitwiseAND(m)
        return out.bitwiseAND(m)

    def fold(x: Column, s: int) -> Column:
        return x.bitwiseXOR(F.shiftrightunsigned(x, s))

    x = (F.bitwise_not(bits).bitwiseAND(m) + F.shiftleft(bits, 21).bitwiseAND(m)).bitwiseAND(m)
    x = times(fold(x, 24), 3, 8)
    x = times(fold(x, 14), 2, 4)
    return times(fold(x, 28), 31)


CODE = np.full(256, 4, np.uint8)
for _i, _c in enumerate(BASES):
    CODE[[ord(_c), ord(_c.lower())]] = _i


#: The two bases of a byte, by the low two bits of its halves, as two bytes side by side.
HALVES = np.array([[ord(BASES[b >> 4 & 3]), ord(BASES[b & 3])] for b in range(256)], np.uint8).view(np.uint16).ravel()


def hash_kmers(bits: np.ndarray, k: int) -> np.ndarray:
    """kmer_hash over an array of unsigned 64-bit k-mers. Its sums of shifts are products modulo 2**64."""
    u, m = np.uint64, np.uint64((1 << 2 * k) - 1)
    x = bits * u((1 << 21) - 1)
    x -= u(1)
    x &= m
    part = np.empty_like(x)
    for fold, factor in ((24, 1 + (1 << 3) + (1 << 8)), (14, 1 + (1 << 2) + (1 << 4)), (28, 1 + (1 << 31))):
        np.right_shift(x, u(fold), out=part)
        x ^= part
        x *= u(factor)
        x &= m
    return x


def runs_of(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(forward, reverse-complement) for each k-mer of known bases, by its first base.

    Runs of bases are put together from runs of 1, 2, 4 and more, in the narrowest integers that hold them.
    """

    def joined(f: np.ndarray, b: np.ndarray, a: int, g: np.ndarray, c: np.ndarray, z: int) -> tuple[np.ndarray, np.ndarray]:
        """Of runs f of a bases and g of z bases behind them; b and c are their reverse complements."""
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if 8 * t().itemsize >= 2 * (a + z))
        m = len(codes) - a - z + 1
        left, right = f[:m].astype(kind), c[a : a + m].astype(kind)
        left <<= kind(2 * z)
        right <<= kind(2 * a)
        left |= g[a : a + m].astype(kind, copy=False)
        right |= b[:m].astype(kind, copy=False)
        return left, right

    run, length = (codes, 3 - codes), 1
    whole, done = None, 0
    while True:
        if k & length:
            whole = joined(*run, length, *whole, done) if done else run
            done += length
        if done == k:
            return whole[0].astype(np.uint64, copy=False), whole[1].astype(np.uint64, copy=False)
        run, length = joined(*run, length, *run, length), 2 * length


def kmers(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forward, reverse-complement, valid) for each k-mer, by its first base; not valid where a base is unknown."""
    n = len(codes) - k + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool)
    bad = np.concatenate(([0], np.cumsum(codes > 3)))
    return *runs_of(codes & 3, k), bad[k:] == bad[:n]


def hash64(x: np.ndarray) -> np.ndarray:
    """Thomas Wang's 64-bit integer hash, modulo 2**64."""
    u = np.uint64
    with np.errstate(over="ignore"):
        x = ~x + (x << u(21))
        x = x ^ (x >> u(24))
        x = x * u(265)
        x = x ^ (x >> u(14))
        x = x * u(21)
        x = x ^ (x >> u(28))
        return x + (x << u(31))


def log2_fast(x: np.ndarray) -> np.ndarray:
    """Quadratic approximation of log2 in single precision, by exponent and mantissa."""
    f = np.float32
    bits = x.astype(f).view(np.int32)
    mantissa = ((bits & 0x007FFFFF) | 0x3F800000).astype(np.int32).view(f)
    return ((bits >> 23) - 128).astype(f) + (f(-0.34484843) * mantissa + f(2.02466578)) * mantissa - f(0.67487759)


def name_suffix_trimmed(name: Column) -> Column:
    """A read's name without a mate's suffix."""
    return F.when(F.length(name) >= 3, F.regexp_replace(name, "/[0-9]$", "")).otherwise(name)
