"""Measures of a CIGAR as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"


def _runs(cigar: Column) -> tuple[Column, Column]:
    """(lengths, operations) of a CIGAR's runs."""
    part = lambda group: F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(group))
    return F.transform(part(1), lambda n: n.cast("long")), part(2)


def run_count(cigar: Column) -> Column:
    return F.size(_runs(cigar)[0])


def packed_runs(cigar: Column) -> Column:
    """Each run as one number: its length times 16 and its operation's place in MIDNSHP=X."""
    return F.zip_with(*_runs(cigar), lambda n, op: F.shiftleft(n, 4) + F.position(op, F.lit(OPS)) - 1)


def bases_of(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the runs with one of these operations."""
    return F.aggregate(F.zip_with(*_runs(cigar), lambda n, op: F.when(op.isin(*ops), n).otherwise(0)), F.lit(0).cast("long"), lambda a, n: a + n)


def gap_opens(cigar: Column) -> Column:
    return F.size(F.filter(_runs(cigar)[1], lambda op: op.isin("I", "D")))
