"""Base-level alignment of two sequences, and what is derived from a CIGAR.

The matrices are filled along anti-diagonals, vectorised; gaps of length n cost the lesser of q + n e and q2 + n e2. Pairs are rows:
Arrow batches go through a narrow transformation, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.nucleotide import CODE, log2_fast
from ..session import bounded_batches

FAR = -(1 << 29)


@dataclass(frozen=True)
class Scoring:
    match: int = 2
    mismatch: int = 4
    ambiguous: int = 1
    q: int = 4
    e: int = 2
    q2: int = 24
    e2: int = 1


def align(query: str, target: str, sc: Scoring = Scoring(), mode: str = "global") -> tuple[int, int, int, int, int, str]:
    """(score, qs, qe, ts, te, CIGAR). mode: global; local (best segment pair, empty if none scores above 0); extension (from both starts to the best end).

    Of equal scores a match or mismatch goes before a deletion, a deletion before an insertion, and the shorter gap form first.
    """
    a, b = (CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)].astype(np.int8) for s in (query, target))
    m, n = len(a), len(b)
    local = mode == "local"
    opens = ((sc.q + sc.e, sc.e), (sc.q2 + sc.e2, sc.e2))
    
    # column j of row i lies on diagonal d = i + j; place i + 1 of an array is row i, for d and the two before it. A diagonal reads what
    # the last two wrote and, beyond these, places that none has written yet
    low = np.int32(FAR)
    h1, h2, h = (np.full(m + 2, low) for _ in range(3))
    dels, inss = ([np.full(m + 2, low) for _ in opens] for _ in range(2))
    back = np.zeros((m + n + 1, m + 1), np.uint8)  # 0-2: source 0 match, 1/2 deletion, 3/4 insertion; bits 3-6: that gap goes on; bit 7: starts
    best, at = (0 if local or mode == "extension" else FAR), (0, 0)
    rows, cols = np.concatenate(([4], a)).astype(np.int8), np.concatenate(([4], b))[::-1].astype(np.int8)
    clear = not ((a > 3).any() or (b > 3).any())
    swing, miss = np.int32(sc.match + sc.mismatch), np.int32(sc.mismatch)
    for d in range(m + n + 1):
        lo, hi = max(0, d - n), min(m, d)
        here, above = slice(lo + 1, hi + 2), slice(lo, hi + 1)
        x, y = rows[lo : hi + 1], cols[n - d + lo : n - d + hi + 1]
        top = (x == y) * swing
        top -= miss
        if not clear:
            top[(x > 3) | (y > 3)] = -sc.ambiguous
        top += h2[above]
        if lo == 0:
            top[0] = low
        if hi == d:
            top[-1] = low
        flags, choice = back[d, lo : hi + 1], np.zeros(hi + 1 - lo, np.uint8)
        for g, (first, more) in enumerate(opens):
            opened, going = h1[here] - np.int32(first), dels[g][here] - np.int32(more)
            on = going > opened
            new = np.maximum(opened, going, out=dels[g][here])
            if hi == d:
                on[-1], new[-1] = False, low
            flags |= on.view(np.uint8) << np.uint8(3 + g)
        for g, (first, more) in enumerate(opens):
            opened, going = h1[above] - np.int32(first), inss[g][above] - np.int32(more)
            on = going > opened
            new = inss[g][here]
            np.maximum(opened, going, out=new)
            if lo == 0:
                on[0], new[0] = False, low
            flags |= on.view(np.uint8) << np.uint8(5 + g)
        for code, arr in ((1, dels[0]), (2, dels[1]), (3, inss[0]), (4, inss[1])):
            np.copyto(choice, np.uint8(code), where=arr[here] > top)
            np.maximum(top, arr[here], out=top)
        if d == 0:
            top[:], choice[:] = 0, 7
        if local:
            choice[top <= 0] = 7
            np.maximum(top, 0, out=top)
        h[here] = top
        flags |= choice
        if mode != "global":
            k = int(top.argmax())
            if top[k] > best:
                best, at = int(top[k]), (lo + k, d - lo - k)
        h1, h2, h = h, h1, h2
    if mode == "global":
        best, at = int(h1[m + 1]) if m + n else 0, (m, n)
    i, j = at
    ops: list[list] = []
    state = 0
    while i > 0 or j > 0:
        f = int(back[i + j, i])
        if state == 0:
            state = f & 7
            if state == 7:
                break
        if state == 0:
            op, i, j = "M", i - 1, j - 1
        elif state <= 2:
            going = f >> (2 + state) & 1
            op, j, state = "D", j - 1, state if going else 0
        else:
            going = f >> (2 + state) & 1
            op, i, state = "I", i - 1, state if going else 0
        if ops and ops[-1][1] == op:
            ops[-1][0] += 1
        else:
            ops.append([1, op])
    return best, i, at[0], j, at[1], "".join(f"{k}{op}" for k, op in reversed(ops))


RESULT = "score int, qs int, qe int, ts int, te int, cigar string"


def align_pairs(df: DataFrame, query_col: str, target_col: str, scoring: Scoring = Scoring(), mode: str = "global") -> DataFrame:
    """df with score, qs, qe, ts, te and cigar; null sequences count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [align(q or "", t or "", scoring, mode) for q, t in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            cols = [pa.array([r[k] for r in rows], pa.string() if k == 5 else pa.int32()) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], [*b.schema.names[:-2], "score", "qs", "qe", "ts", "te", "cigar"])

    result = [StructField(f.split()[0], StringType() if f.endswith("string") else IntegerType()) for f in RESULT.split(", ")]
    schema = StructType([*df.schema.fields, *result])
    bounded_batches(df.sparkSession)
    return df.select("*", F.col(query_col).alias("__q"), F.col(target_col).alias("__t")).mapInArrow(run, schema)


def cigar_ops(cigar: str) -> list[tuple[int, str]]:
    return [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHX=])", cigar)]


def columns(cigar: str, query: str, target: str, qs: int = 0, ts: int = 0) -> Iterator[tuple[str, str, str]]:
    """(op, query part, target part) of each run."""
    q, t = qs, ts
    for n, op in cigar_ops(cigar):
        dq, dt = n if op in "MIS=X" else 0, n if op in "MDN=X" else 0
        yield op, query[q : q + dq], target[t : t + dt]
        q, t = q + dq, t + dt


def eqx(cigar: str, query: str, target: str, qs: int = 0, ts: int = 0) -> str:
    """The CIGAR with matches as = and mismatches as X."""
    out: list[list] = []
    for op, q, t in columns(cigar, query, target, qs, ts):
        steps = ["=" if x == y else "X" for x, y in zip(q, t, strict=True)] if op in "M=X" else [op] * max(len(q), len(t))
        for s in steps:
            if out and out[-1][1] == s:
                out[-1][0] += 1
            else:
                out.append([1, s])
    return "".join(f"{n}{s}" for n, s in out)


def md_tag(cigar: str, query: str, target: str, qs: int = 0, ts: int = 0) -> str:
    """Matches as numbers, mismatched and deleted target bases as letters; introns and insertions leave no trace."""
    out, run = [], 0
    for op, q, t in columns(cigar, query, target, qs, ts):
        if op in "M=X":
            for x, y in zip(q, t, strict=True):
                if x == y:
                    run += 1
                else:
                    out.append(f"{run}{y}")
                    run = 0
        elif op == "D":
            out.append(f"{run}^{t}")
            run = 0
    return "".join(out) + (str(run) if run else "")


def cs_tag(cigar: str, query: str, target: str, qs: int = 0, ts: int = 0, long: bool = False) -> str:
    """Differences: :n or =SEQ, *rq, +ins, -del, ~ intron with its ends."""
    out, same = [], []

    def flush() -> None:
        if same:
            out.append("=" + "".join(same) if long else f":{len(same)}")
            same.clear()

    for op, q, t in columns(cigar, query, target, qs, ts):
        if op in "M=X":
            for x, y in zip(q, t, strict=True):
                if x == y:
                    same.append(x)
                else:
                    flush()
                    out.append(f"*{y.lower()}{x.lower()}")
        elif op in "IDN":
            flush()
            out.append("+" + q.lower() if op == "I" else "-" + t.lower() if op == "D" else f"~{t[:2].lower()}{len(t)}{t[-2:].lower()}")
    flush()
    return "".join(out)


def cigar_stats(cigar: str, query: str, target: str, qs: int = 0, ts: int = 0) -> dict[str, float]:
    """matches, edit distance, block length, ambiguous bases and gap-compressed divergence."""
    matches = ambiguous = block = gap_bases = gaps = mismatches = 0
    for op, q, t in columns(cigar, query, target, qs, ts):
        if op in "M=X":
            pairs = list(zip(q, t, strict=True))
            unknown = sum(x not in "ACGTacgt" or y not in "ACGTacgt" for x, y in pairs)
            equal = sum(x == y and x in "ACGTacgt" for x, y in pairs)
            matches, ambiguous, block = matches + equal, ambiguous + unknown, block + len(pairs) - unknown
            mismatches += len(pairs) - unknown - equal
        elif op in "ID":
            unknown = sum(x not in "ACGTacgt" for x in q + t)
            ambiguous += unknown
            block += len(q + t) - unknown
            gap_bases += len(q + t)
            gaps += 1
    events = block + ambiguous - gap_bases + gaps
    return {"matches": matches, "nm": mismatches + ambiguous + gap_bases, "block_len": block, "nn": ambiguous, "de": 1 - matches / events if events else 0.0}


def score_of_cigar(cigar: str, query: str, target: str, sc: Scoring = Scoring(), qs: int = 0, ts: int = 0) -> int:
    """The score that align() gives to this alignment."""
    total = 0
    for op, q, t in columns(cigar, query, target, qs, ts):
        if op in "M=X":
            total += sum(-sc.ambiguous if x not in "ACGT" or y not in "ACGT" else sc.match if x == y else -sc.mismatch for x, y in zip(q.upper(), t.upper(), strict=True))
        elif op in "ID":
            n = len(q + t)
            total -= min(sc.q + n * sc.e, sc.q2 + n * sc.e2)
    return total


def segment_max(cigar: str, query: str, target: str, sc: Scoring = Scoring(), qs: int = 0, ts: int = 0, log_gaps: bool = True) -> int:
    """Best score of a stretch of the alignment; a gap of n costs q + e log2(1 + n), or q + e. Introns are free."""
    now = best = 0.0
    for op, q, t in columns(cigar, query, target, qs, ts):
        if op in "M=X":
            for x, y in zip(q.upper(), t.upper(), strict=True):
                now = max(0.0, now + (-sc.ambiguous if x not in "ACGT" or y not in "ACGT" else sc.match if x == y else -sc.mismatch))
                best = max(best, now)
        elif op in "ID":
            now = max(0.0, now - sc.q - sc.e * (float(log2_fast(np.array([1 + len(q + t)]))[0]) if log_gaps else 1))
    return int(best + 0.499)


def homology(indel: str, before: str, after: str) -> tuple[int, int]:
    """(left, right): bases by which an indel could move to the left and to the right without changing the alignment."""
    n = len(indel)
    right = next((i for i, c in enumerate(after) if c != indel[i % n]), len(after))
    left = next((i for i, c in enumerate(reversed(before)) if c != indel[-1 - i % n]), len(before))
    return min(left, n), min(right, n)


def ds_tag(cigar: str, query: str, target: str, qs: int = 0, ts: int = 0) -> str:
    """cs with brackets around the bases of an indel that could as well stand on its other side."""
    out, q, t, run = [], qs, ts, 0

    def flush() -> None:
        nonlocal run
        if run:
            out.append(f":{run}")
        run = 0

    for n, op in cigar_ops(cigar):
        if op in "M=X":
            for x, y in zip(query[q : q + n], target[t : t + n], strict=True):
                if x == y:
                    run += 1
                else:
                    flush()
                    out.append(f"*{y.lower()}{x.lower()}")
            q, t = q + n, t + n
        elif op in "ID":
            flush()
            seq, at, other = (query, q, "+") if op == "I" else (target, t, "-")
            indel = seq[at : at + n]
            left, right = homology(indel, seq[qs if op == "I" else ts : at], seq[at + n :])
            low = indel.lower()
            body = f"[{low}]" if left + right >= n else (f"[{low[:right]}]" if right else "") + low[right : n - left] + (f"[{low[n - left:]}]" if left else "")
            out.append(other + body)
            q, t = (q + n, t) if op == "I" else (q, t + n)
        elif op == "N":
            flush()
            out.append(f"~{target[t:t + 2].lower()}{n}{target[t + n - 2:t + n].lower()}")
            t += n
    flush()
    return "".join(out)
