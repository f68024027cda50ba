"""Numpy kernels against plain definitions, and golden values."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.functions.nucleotide import CODE, hash_kmers
from seqloom.operators import chain, pairwise, select, sketch
from seqloom.operators.pairwise import Scoring, align
from seqloom.plans.config import PRESETS, parse_size, preset


def raw(s):
    return np.frombuffer(s.encode(), np.uint8)


def codes(s):
    return CODE[np.frombuffer(s.encode(), np.uint8)]


def plain_hash(x, k):
    m = (1 << 2 * k) - 1
    x = (~x + (x << 21)) & m
    x ^= x >> 24
    x = x * 265 & m
    x ^= x >> 14
    x = x * 21 & m
    x ^= x >> 28
    return x * ((1 << 31) + 1) & m


@pytest.mark.parametrize("k", [5, 15, 19, 28])
def test_hash_of_kmers(k):
    r = random.Random(k)
    x = [r.getrandbits(2 * k) for _ in range(500)]
    assert [int(v) for v in hash_kmers(np.array(x, np.uint64), k)] == [plain_hash(v, k) for v in x]
    assert len({plain_hash(v, k) for v in x}) == len(set(x))


def plain_minimizers(s, w, k):
    """A walk over k-mers that keeps the last w, by the rules of window_minima."""
    comp = {"A": "T", "C": "G", "G": "C", "T": "A"}
    num = lambda t: int("".join(str("ACGT".index(c)) for c in t), 4)
    x = []
    for i in range(len(s) - k + 1):
        f, b = num(s[i : i + k]), num("".join(comp[c] for c in reversed(s[i : i + k])))
        x.append((plain_hash(min(f, b), k), i + k - 1, int(f > b)))
    if not x:
        return []
    if len(x) < w:
        return [min(reversed(x), key=lambda v: v[0])]
    out = {v for j in range(len(x) - w + 1) for v in x[j : j + w] if v[0] == min(u[0] for u in x[j : j + w])}
    if w > 1:
        low = min(v[0] for v in x[: w - 1])
        ties = [v for v in x[: w - 1] if v[0] == low]
        if x[w - 1][0] <= low:
            out = (out | set(ties[:-1])) - {ties[-1]}
    return sorted(out, key=lambda v: v[1])


@settings(max_examples=150, deadline=None)
@given(st.text("ACGT", max_size=80), st.sampled_from([1, 2, 3, 5, 10]), st.sampled_from([3, 5, 7]))
def test_minimizers(s, w, k):
    pos, h, span, strand = sketch.minimizers(raw(s), w, k)
    assert [(int(a), int(b), int(c)) for a, b, c in zip(h, pos, strand)] == plain_minimizers(s, w, k)
    assert (span == k).all()


def plain_walk(seq, w, k, hpc):
    """Minimizers by a walk base by base that keeps the last w places; unknown bases are places without a seed."""
    none, out, last, spans, at, f, b, run, place = 2**64 - 1, [], [], [], 0, 0, 0, 0, -1
    low, low_place = (none, None), 0
    while at < len(seq):
        c, item = int(CODE[ord(seq[at])]), (none, None)
        if c > 3:
            run, spans = 0, []
        else:
            begin = at
            while hpc and at + 1 < len(seq) and seq[at + 1] == seq[at]:
                at += 1
            spans = [*spans, at - begin + 1][-k:]
            f, b = (f << 2 | c) % 4**k, b >> 2 | (3 - c) << 2 * (k - 1)
            if f == b:
                at += 1
                continue
            run += 1
            if run >= k and sum(spans) < 256:
                item = (plain_hash(min(f, b), k) << 8 | sum(spans), (at, int(f > b)))
        place += 1
        if run == w + k - 1 and low[0] != none:
            out += [p for p in last[len(last) - w + 1 :] if p[0] == low[0] and p != low]
        last = [*last, item][-w:]
        if item[0] <= low[0]:
            out += [low] if run >= w + k and low[0] != none else []
            low, low_place = item, place
        elif place - low_place == w:
            full = run >= w + k - 1
            out += [low] if full and low[0] != none else []
            ties = [j for j, p in enumerate(last) if p[0] == min(q[0] for q in last)]
            low, low_place = last[ties[-1]], place - len(last) + 1 + ties[-1]
            out += [last[j] for j in ties[:-1]] if full and low[0] != none else []
        at += 1
    return sorted((p[1][0], p[0] >> 8, p[0] & 255, p[1][1]) for p in [*out, low] if p[1])


def test_minimizers_with_unknown_bases_runs_and_palindromes():
    r = random.Random(21)
    for n in range(1500):
        hpc, k, w = n % 2 == 1, r.choice([3, 4, 5, 7]), r.choice([1, 2, 5, 10])
        letters = r.choice(["ACGT", "AT", "ACGTN", "AACCGGTTN", "AN", "AC"])
        s = "".join(r.choice(letters) * (r.choice([1, 1, 1, 2, 90, 200]) if n % 5 == 0 else 1) for _ in range(r.randint(0, 60)))
        got = sorted(zip(*[x.tolist() for x in sketch.minimizers(raw(s), w, k, hpc)], strict=True))
        assert got == plain_walk(s, w, k, hpc), (s, w, k, hpc)
    assert sketch.minimizers(raw("TCGAA"), 10, 3, hpc=True)[0].tolist() == [2]


def test_homopolymer_compression_is_that_of_the_runs():
    s = "ACGGTTTACCCGATTTTGACCCA" * 4
    runs = "".join(c for c, p in zip(s, " " + s) if c != p)
    _, h, span, _ = sketch.minimizers(raw(s), 4, 7, hpc=True)
    assert sorted(h.tolist()) == sorted(sketch.minimizers(raw(runs), 4, 7)[1].tolist())
    assert (span >= 7).all()
    assert len(sketch.minimizers(raw("A" * 400), 1, 3, hpc=True)[0]) == 0


def test_short_and_empty_sequences():
    for s in ("", "A", "ACG", "NN"):
        assert len(sketch.minimizers(raw(s), 5, 7)[0]) == len(sketch.minimizers(raw(s), 5, 7, hpc=True)[0]) == 0
    for f in (lambda c: sketch.syncmers(c, 7, 3), lambda c: sketch.randstrobes(c, 5, 6, 9)):
        for s in ("", "A", "ACG"):
            assert len(f(codes(s))[0]) == 0


def test_syncmers_and_randstrobes_are_in_range():
    r = random.Random(2)
    s = "".join(r.choice("ACGT") for _ in range(600))
    pos, _, span, _ = sketch.syncmers(codes(s), 15, 5)
    assert 0 < len(pos) < 300 and (pos + span <= len(s)).all()
    pos, _, span, _ = sketch.randstrobes(codes(s), 15, 16, 30)
    assert len(pos) == len(s) - 15 - 30 + 1 and (span >= 31).all() and (span <= 45).all()


def test_golden_scores():
    assert align("ACGT", "ACGT")[0] == 8
    assert align("ACGT", "ACAT")[0] == 2
    assert align("A" * 50, "A" * 20, Scoring(2, 4, 1, 4, 2, 4, 2))[0] == -24
    assert align("A" * 50, "A" * 20)[0] == -14
    assert align("ACGT" * 3, "ACGT" * 3)[5] == "12M"


def plain_score(q, t, sc, mode):
    gap = lambda k: -min(sc.q + k * sc.e, sc.q2 + k * sc.e2)
    h, best = {}, 0
    for i in range(len(q) + 1):
        for j in range(len(t) + 1):
            options = [0] if i == j == 0 or mode == "local" else []
            if i and j:
                x, y = q[i - 1], t[j - 1]
                options.append(h[i - 1, j - 1] + (-sc.ambiguous if "N" in x + y else sc.match if x == y else -sc.mismatch))
            options += [h[i - k, j] + gap(k) for k in range(1, i + 1)] + [h[i, j - k] + gap(k) for k in range(1, j + 1)]
            h[i, j] = max(options)
            best = max(best, h[i, j])
    return h[len(q), len(t)] if mode == "global" else best


@settings(max_examples=150, deadline=None)
@given(st.text("ACN", max_size=12), st.text("ACN", max_size=12), st.sampled_from(["global", "local", "extension"]), st.sampled_from([Scoring(), Scoring(2, 4, 1, 4, 2, 6, 1), Scoring(1, 1, 1, 2, 1, 3, 1)]))
def test_alignment(q, t, mode, sc):
    score, qs, qe, ts, te, cigar = align(q, t, sc, mode)
    assert score == plain_score(q, t, sc, mode)
    assert pairwise.score_of_cigar(cigar, q, t, sc, qs, ts) == score
    assert sum(n for n, op in pairwise.cigar_ops(cigar) if op in "MI") == qe - qs
    assert sum(n for n, op in pairwise.cigar_ops(cigar) if op in "MD") == te - ts


def test_cigar_tags():
    q, t, c = "ACGTACGT", "ACCTAGT", "5M1I2M"
    assert pairwise.eqx(c, q, t) == "2=1X2=1I2="
    assert pairwise.md_tag(c, q, t) == "2C4"
    assert pairwise.cs_tag(c, q, t) == ":2*cg:2+c:2"
    assert pairwise.cs_tag("2M3N2M", "ACGT", "ACGTAGT") == ":2~gt3ta:2"
    stats = pairwise.cigar_stats(c, q, t)
    assert (stats["matches"], stats["nm"], stats["block_len"]) == (6, 2, 8)
    assert pairwise.md_tag("2M2D2M", "ACGT", "ACTTGT") == "2^TT2"


def test_ds_and_segment_maximum():
    assert pairwise.ds_tag("4M2D4M", "ACGTTTGA", "ACGTGTTTGA") == ":4-[gt]:4"
    assert pairwise.ds_tag("3M1I3M", "ACGATTT", "ACGTTT") == ":3+a:3"
    assert pairwise.ds_tag("3M1I3M", "ACGGTTT", "ACGTTT") == ":3+[g]:3"
    assert pairwise.segment_max("4M", "ACGT", "ACGT") == 8
    assert pairwise.segment_max("4M1X8M", "ACGTAACGTACGT", "ACGTCACGTACGT") == 20
    assert pairwise.segment_max("4M", "ACGT", "TTTT") == 2 and pairwise.segment_max("", "", "") == 0
    assert pairwise.segment_max("4M3I4M", "ACGTGGGACGT", "ACGTACGT", log_gaps=False) == 10


def test_parents():
    qs, qe = np.array([0, 10, 200, 0]), np.array([100, 90, 300, 0])
    assert select.parents_of(qs, qe, 0.5, 2**31 - 1).tolist() == [0, 0, 2, 3]


def plain_chain(ref, query, span, max_dist, bw, gap):
    best = []
    for i in range(len(ref)):
        s = span[i]
        for j in range(i):
            dr, dq = ref[i] - ref[j], query[i] - query[j]
            if 0 < dq <= max_dist and 0 < dr <= max_dist and abs(dr - dq) <= bw:
                s = max(s, best[j] + int(chain.link_scores(np.array([dr]), np.array([dq]), np.array([span[j]]), gap, 0.0)[0]))
        best.append(s)
    return best


def test_chain_score_is_the_best():
    r = random.Random(5)
    for _ in range(60):
        n = r.randint(1, 25)
        a = sorted({(r.randint(0, 300), r.randint(0, 300)) for _ in range(n)})
        ref, query = (np.array([x[k] for x in a]) for k in (0, 1))
        span = np.full(len(a), 15)
        top = max(plain_chain(ref, query, span, 200, 50, 0.12))
        found = chain.chain_group(ref, query, span, 200, 50, 1, 1, 0.12, 0.0)
        assert max(s for s, _ in found) == top
        places = [p for _, path in found for p in path]
        assert len(places) == len(set(places))


def test_range_minimum_predecessors_give_sound_scores():
    r = random.Random(6)
    for _ in range(40):
        a = sorted({(r.randint(0, 400), r.randint(0, 400)) for _ in range(r.randint(1, 30))})
        ref, query = (np.array([x[k] for x in a]) for k in (0, 1))
        span = np.full(len(a), 15)
        best, before = chain.rmq_scores(ref, query, span, 200, 0.12)
        assert (best >= span).all() and (best <= np.array(plain_chain(ref, query, span, 200, 10**9, 0.12)) + 1e-6).all()
        for i, j in enumerate(before):
            assert j < 0 or (ref[j] < ref[i] and query[j] < query[i] and ref[i] - ref[j] <= 200 and query[i] - query[j] <= 200)


def test_presets():
    assert preset("lr") is PRESETS["map-ont"] and preset("sr").k == 21 and preset("asm5").scoring.mismatch == 19
    assert abs(preset("map-ont").gap_penalty - 0.12) < 1e-9
    with pytest.raises(ValueError):
        preset("nothing")
    assert (parse_size("8G"), parse_size("500k"), parse_size("7")) == (8 * 10**9, 500_000, 7)


def test_minimizers_of_many_sequences_at_once():
    r = random.Random(21)
    for w, k in ((1, 1), (3, 5), (10, 7), (10, 19)):
        for alphabet in ("ACGT", "AC", "A"):
            parts = ["".join(r.choice(alphabet) for _ in range(r.choice((0, 3, k, k + w - 2, k + w, 60)))) for _ in range(12)]
            bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
            part, found = sketch.plain_minimizers(codes("".join(parts)), bounds, w, k)
            alone = [sketch.minimizers(raw(p), w, k) for p in parts]
            assert part.tolist() == [i for i, x in enumerate(alone) for _ in x[0]]
            for column in range(4):
                assert found[column].tolist() == np.concatenate([x[column] for x in alone]).tolist()


def test_links_of_all_pairs_at_once(monkeypatch):
    r = np.random.default_rng(17)
    for _ in range(200):
        n, length = int(r.integers(1, 60)), int(r.choice([30, 300, 20_000]))
        ref, query, span = np.sort(r.integers(0, length, n)), r.integers(0, length, n), r.integers(15, 25, n)
        costs = (ref, query, span, int(r.choice([100, 5000])), int(r.choice([20, 500])), 0.152, float(r.choice([0, 0.05])))
        monkeypatch.setattr(chain, "AT_ONCE", 256)
        best, before = chain.best_links(*costs)
        monkeypatch.setattr(chain, "AT_ONCE", 0)
        assert [x.tolist() for x in chain.best_links(*costs)] == [best.tolist(), before.tolist()]


def test_long_alignments_take_no_array_of_the_query_for_each_diagonal(monkeypatch):
    made = []
    full = np.full
    monkeypatch.setattr(np, "full", lambda *a, **b: made.append(1) or full(*a, **b))
    assert align("ACGT" * 20, "ACGT" * 20)[5] == "80M"
    assert len(made) < 20
