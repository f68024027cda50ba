"""Each query against its SQL in DuckDB; the others against what they must keep."""

import math
import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from seqloom.operators import pairwise, select
from seqloom.plans import queries as q
from seqloom.sources import annotations, fastx, records


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, sf_dir, db, name):
    want = db.sql(q.SQL[name]).df()
    got = q.QUERIES[name](spark, sf_dir).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_chains_by_dynamic_programming_cover_true_passages(spark, sf_dir):
    chains = {(r.id, r.rid) for r in q.dp_chain(spark, sf_dir).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    inside = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert inside <= chains


def test_global_alignments_score_as_their_cigars(spark, sf_dir):
    seqs = {r.rid: r.seq for r in q.targets(spark, sf_dir).collect()}
    rows = q.dp_global(spark, sf_dir).collect()
    assert len(rows) == len(seqs) - 1
    for r in rows:
        assert pairwise.score_of_cigar(r.cigar, seqs[r.rid], seqs[r.rid + 1]) == r.score


def test_paf_has_one_primary_first(spark, sf_dir):
    rows = q.paf_records(spark, sf_dir).collect()
    assert rows and all(len(r.line.split("\t")) == (17 if "tp:A:P" in r.line else 16) for r in rows)
    assert all(("tp:A:P" in r.line) or r["rank"] > 0 for r in rows)


def test_alignments_of_hits(spark, sf_dir):
    seqs = {r.tname: r.seq for r in q.targets(spark, sf_dir).collect()}
    read = {r.qname: r.seq for r in q.reads(spark, sf_dir).collect()}
    rows = q.aligned_hits(spark, sf_dir).collect()
    assert rows
    for r in rows:
        part, target = read[r.qname][r.qs : r.qe], seqs[r.tname][r.rs : r.re]
        assert not r.rev and pairwise.score_of_cigar(r.cigar, part, target) == r.as_
        stats = pairwise.cigar_stats(r.cigar, part, target)
        assert (stats["nm"], stats["matches"]) == (r.nm, r.mlen)
        best = pairwise.align(part, target)[0]
        assert r.as_ <= best and r.as_ >= 0.98 * best
    full = [r for r in rows if target_inside(read[r.qname], seqs[r.tname])]
    assert full and all(r.cigar == f"{r.tlen}M" for r in full)
    lines = q.sam_records(spark, sf_dir).collect()
    assert len(lines) == len(rows)
    for x in lines:
        f = x.line.split("\t")
        used = sum(n for n, op in pairwise.cigar_ops(f[5]) if op in "MIS=X")
        assert f[9] == "*" or used == len(f[9])


def target_inside(read, target):
    return target in read


def test_reverse_strand_is_the_mirror(spark):
    from seqloom.plans.config import preset
    from seqloom.plans.mapping import Mapping

    import random

    r = random.Random(11)
    t = "".join(r.choice("ACGT") for _ in range(900))
    read = t[100:400] + "ACGTTGCA" + t[410:700]
    back = read[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([(1, "f", read), (2, "r", back)], "id long, qname string, seq string")
    targets = spark.createDataFrame([(0, "t", t)], "rid long, tname string, seq string")
    m = {x.qname: x for x in Mapping(reads, targets, preset("map-ont")).aligned().collect()}
    assert m["f"].rev is False and m["r"].rev is True
    assert (m["f"].rs, m["f"].re, m["f"].as_) == (m["r"].rs, m["r"].re, m["r"].as_) == (100, 700, m["f"].as_)
    assert (m["r"].qs, m["r"].qe) == (len(read) - m["f"].qe, len(read) - m["f"].qs)


def test_passages_that_many_targets_share(spark, tmp_path):
    import random
    import string
    from dataclasses import replace

    from seqloom.plans.mapping import Mapping
    from seqloom.streaming import reads as streams

    r = random.Random(4)
    text = lambda n: "".join(r.choice(string.printable[:94]) for _ in range(n))
    shared = text(1500)
    spark.createDataFrame([(1, shared)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, text(30) + shared) for i in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {x.rid for x in q.dp_chain(spark, str(tmp_path)).collect()} == set(range(12))
    assert q.paf_records(spark, str(tmp_path)).count() and q.aligned_hits(spark, str(tmp_path)).count()

    # all of the read's seeds are above the cut-off here: the rarest few are used
    options = replace(q.OPTIONS, mid_occ_fraction=0.9)
    m = Mapping(q.reads(spark, str(tmp_path)), q.targets(spark, str(tmp_path)), options)
    assert m.most == 10 and m.anchors.count() == 12 * 6
    assert {x.rid for x in m.chains("greedy").collect()} == set(range(12))
    assert 0 < m.repetitive.first()["rep_len"] < 3000
    assert Mapping(m.reads, m.targets, replace(options, occ_distance=0)).anchors.count() == 0
    assert Mapping(m.reads, m.targets, replace(options, max_occ=11)).anchors.count() == 0
    out = str(tmp_path / "out")
    fastx.write_fasta(m.reads.select(F.col("id").cast("string").alias("name"), "seq"), str(tmp_path / "in"))
    arriving = fastx.stream_fastx(spark, str(tmp_path / "in")).select(F.col("name").cast("long").alias("id"), "seq")
    streams.map_stream(arriving, m.targets, options, None, out, out + "-checkpoint").awaitTermination()
    assert [x.id for x in spark.read.parquet(out).collect()] == [1]


def test_ends_are_extended_as_far_as_gaps_are_allowed():
    import random

    from seqloom.operators import basealign

    r, sc = random.Random(12), pairwise.Scoring()
    target = "".join(r.choice("ACGT") for _ in range(1600))
    turn = str.maketrans("ACGT", "CGTA")
    end = "".join(c.translate(turn) if i % 15 == 7 else c for i, c in enumerate(target[100:]))
    query = target[:100] + end
    assert basealign.align_chain(query, target, [(99, 99, 19)], sc)[:4] == (0, 1600, 0, 1600)
    assert basealign.align_chain(query[::-1], target[::-1], [(1599, 1599, 19)], sc)[:4] == (0, 1600, 0, 1600)
    assert basealign.align_chain(query, target, [(99, 99, 19)], sc, 200)[1] <= 300
    for _ in range(60):  # what reach() leaves out can not be part of the best extension
        a, b = ("".join(r.choice("AC") for _ in range(r.randint(0, n))) for n in (9, 90))
        a, b = (a, b) if r.random() < 0.5 else (b, a)
        got = pairwise.align(a, b, sc, "extension")
        assert basealign.extend(a, b, sc, 5000) == (got[2], got[4], got[5])


def test_options_of_the_plan(spark):
    """Range-minimum presets map; long gaps join by the wider bandwidth; strands, read lengths and all-vs-all follow the options; splice presets are refused."""
    import random
    from dataclasses import replace

    from seqloom.plans.config import preset
    from seqloom.plans.mapping import Mapping

    r = random.Random(21)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    t = dna(6000)
    back = t[1000:3000][::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([(1, "a", t[:2500] + t[3700:]), (2, "b", back), (3, "c", t[100:1100])], "id long, qname string, seq string")
    targets = spark.createDataFrame([(0, "t", t)], "rid long, tname string, seq string")
    on = lambda o: sorted((x.id, x.rev, x.rs, x.re) for x in Mapping(reads, targets, o).chains().collect())
    near = lambda got, want: len(got) == len(want) and all(g[:2] == w[:2] and abs(g[2] - w[2]) < 60 and abs(g[3] - w[3]) < 60 for g, w in zip(got, want, strict=True))
    joined = [(1, False, 0, 6000), (2, True, 1000, 3000), (3, False, 100, 1100)]
    split = [(1, False, 0, 2500), (1, False, 3700, 6000), *joined[1:]]
    base = preset("map-ont")
    assert near(on(replace(base, bandwidth_long=500)), split) and near(on(base), joined)
    assert near(on(replace(base, rmq=True, bandwidth_long=500)), split)
    for name in ("asm5", "asm10", "asm20"):
        assert near(on(preset(name)), joined)
    assert near(on(replace(base, strand="reverse")), joined[1:2]) and near(on(replace(base, strand="forward")), [joined[0], joined[2]])
    assert {x[0] for x in on(replace(base, max_query_length=2000))} == {2, 3}
    with pytest.raises(NotImplementedError, match="splice"):
        on(preset("splice"))
    with pytest.raises(ValueError):
        on(replace(base, strand="up"))
    own = reads.select(F.col("id").alias("rid"), F.col("qname").alias("tname"), "seq")
    pairs = {(x.id, x.rid) for x in Mapping(reads, own, preset("ava-ont")).hits().collect()}
    assert pairs == {(1, 2), (1, 3)}


def test_aligned_records(spark):
    """A read of two distant pieces: two primary hits, each named in the other's SA; PAF's CIGAR and tags agree with the alignment."""
    import random

    from seqloom.plans.config import preset
    from seqloom.plans.mapping import Mapping

    r = random.Random(31)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    a, b = dna(2000), dna(2000)
    read = a[300:1300] + b[500:1100]
    reads = spark.createDataFrame([(1, "x", read)], "id long, qname string, seq string")
    targets = spark.createDataFrame([(0, "a", a), (1, "b", b)], "rid long, tname string, seq string")
    m = Mapping(reads, targets, preset("map-ont"))
    lines = {x["rank"]: x.line.split("\t") for x in m.paf_aligned().collect()}
    assert [lines[k][5] for k in (0, 1)] == ["a", "b"] and all(int(f[11]) == 60 for f in lines.values())
    for f in lines.values():
        tags = {t[:2]: t[5:] for t in f[12:]}
        assert tags["tp"] == "P" and tags["s2"] == "0" and int(tags["ms"]) >= int(tags["AS"]) > 0
        ops = pairwise.cigar_ops(tags["cg"])
        assert sum(n for n, op in ops if op in "MI") == int(f[3]) - int(f[2]) and sum(n for n, op in ops if op in "MD") == int(f[8]) - int(f[7])
    sam = {x["rank"]: x for x in m.sam().collect()}
    assert [sam[k].flag for k in (0, 1)] == [0, 2048]
    assert "SA:Z:b,501,+," in sam[0].line and "SA:Z:a,301,+," in sam[1].line


def test_hits_that_are_too_short_or_clipped_go(spark):
    hits = spark.createDataFrame([(1, 5, 90, 200, 0, 100, 100), (2, 2, 90, 200, 0, 100, 100), (3, 5, 30, 200, 0, 100, 100), (4, 5, 90, 70, 0, 100, 100), (5, 5, 90, 200, 30, 60, 100)], "id long, cnt int, mlen int, dp_max int, qs int, qe int, qlen int")
    assert [x.id for x in select.long_enough(hits, 3, 40, 80).collect()] == [1, 5]
    assert [x.id for x in select.long_enough(hits, 3, 40, 80, 0.2).collect()] == [1]
    assert select.long_enough(hits.where("false"), 3, 40, 80).count() == 0


def test_cigar_of_nothing(spark):
    from seqloom.functions import cigar

    x = F.col("c")
    rows = spark.createDataFrame([("",), (None,), ("3M1I2N",)], "c string").select(cigar.run_count(x).alias("n"), cigar.packed_runs(x).alias("p"), cigar.bases_of(x, "MN").alias("b"), cigar.gap_opens(x).alias("g")).collect()
    assert tuple(rows[0]) == (0, [], 0, 0) and rows[1].p is None and tuple(rows[2]) == (3, [48, 17, 35], 5, 1)


def test_fastx_parser():
    parse = lambda t, **k: list(fastx.parse_records(iter(t.splitlines(True)), **k))
    assert parse(">a b c\r\nAC GU\r\n\r\nTT\n>x\n") == [("a", "b c", "ACGTTT", None), ("x", None, "", None)]
    assert parse("@r 1\nACGU\n+\nIIII\n@s\nAC\n+\nI\n", strict=True) == [("r", "1", "ACGT", "IIII")]
    assert parse("") == []
    with pytest.raises(ValueError):
        parse("nonsense\n")


def test_bed_forms(spark, tmp_path):
    p = tmp_path / "x.bed"
    p.write_text("#c\ntrack x\nc1\t5\t25\t.\t0\t+\nc1\t9\t3\nc1\tx\t3\nc2\t100\t200\tn\t7\t-\t0\t0\t0\t3\t10,10,10\t0,40,90\nc1\t5\t25\t.\t1\t-\n")
    got = {(r.contig, r.start, r.end) for r in annotations.read_junctions(spark, str(p)).collect()}
    assert got == {("c1", 5, 25), ("c2", 110, 140), ("c2", 150, 190)}
    assert annotations.jump_junctions(annotations.read_junctions(spark, str(p)), 5).count() == 4


def test_splice_scores(spark, tmp_path):
    p = tmp_path / "s.txt"
    p.write_text("c1\t10\t+\tD\t50\nc1\t20\t-\tA\t-9\nc1\t0\t+\tD\t3\nc1\t99\t+\tQ\t3\nc9\t1\t+\tD\t1\n")
    n = spark.createDataFrame([("c1", 100)], "contig string, len int")
    got = {(r["at"], r.kind, r.score) for r in annotations.read_splice_scores(spark, str(p), n, 20, 0.5).collect()}
    assert got == {(10, "D", 20), (20, "A", -4)}


def test_sam_and_junctions(spark):
    hit = spark.createDataFrame([(1, 0, 0, "r", 6, 1, 5, True, "t", 10, 60, "4M", "ACGTTT", "abcdef", 0, 8)], "id long, rank int, parent int, qname string, qlen int, qs int, qe int, rev boolean, tname string, rs int, mapq int, cigar string, seq string, qual string, nm int, as_ int")
    line = records.sam(hit).first()
    assert line.flag == 16 and line.line.split("\t")[:11] == ["r", "16", "t", "11", "60", "1S4M1S", "*", "0", "0", "AAACGT", "fedcba"]
    t = spark.createDataFrame([("t", "AAGTCCCAGTT")], "tname string, seq string")
    j = spark.createDataFrame([("r", "t", 0, "2M7N2M", 1)], "qname string, tname string, rs int, cigar string, trans_strand int")
    assert [tuple(r) for r in records.junctions_of(j, t).collect()] == [("t", 2, 9, "r", 6, "+")]


def test_pairs_of_interleaved_reads(spark):
    r = spark.createDataFrame([("a/1", "AC", 0, "f"), ("a/2", "GT", 1, "f"), ("b/1", "T", 2, "f")], "name string, seq string, ordinal long, file string")
    assert [(x.name, x.seq1, x.seq2) for x in fastx.pair_interleaved(r).collect()] == [("a", "AC", "GT")]


def test_gzip_is_told_by_its_first_bytes(spark, tmp_path):
    import gzip

    (tmp_path / "reads.fa").write_bytes(gzip.compress(b">a\nAC\n>b\nGG\n"))
    assert sorted((r.name, r.seq) for r in fastx.read_fastx(spark, str(tmp_path)).collect()) == [("a", "AC"), ("b", "GG")]


def test_sketch_of_unknown_bases_and_nulls(spark):
    from seqloom.operators.sketch import sketch

    df = spark.createDataFrame([(1, "ACGTACGTTGCA" + "N" + "ACGTACGTTGCA"), (2, None), (3, "")], "id long, seq string")
    rows = sketch(df, w=2, k=5).collect()
    assert {r.id for r in rows} == {1} and all(not (r.pos - 4 <= 12 <= r.pos) for r in rows)
    assert sketch(df.where(F.lit(False)), w=2, k=5).count() == 0


def test_shards_map_as_the_whole_and_resume(spark, sf_dir):
    from seqloom.operators import select
    from seqloom.plans.stages import map_sharded
    from seqloom.session import shared_path

    t, r, folder = q.targets(spark, sf_dir), q.reads(spark, sf_dir), shared_path(spark, "stages")
    shards = {"a": t.where("rid % 2 = 0"), "b": t.where("rid % 2 = 1")}
    got, run = map_sharded(r, shards, q.OPTIONS, folder, q.OCC)
    whole = q.mapping(spark, sf_dir)
    from seqloom.operators import chain

    want = select.rank_hits(chain.greedy_chains(whole.anchors, whole.lengths, q.OPTIONS.max_gap, q.OPTIONS.bandwidth))
    cols = want.columns
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want.collect())) and "ranked" in run.made
    again, second = map_sharded(r, shards, q.OPTIONS, folder, q.OCC)
    assert second.made == [] and again.count() == got.count()
    with pytest.raises(ValueError):
        map_sharded(r, shards, q.OPTIONS, folder, q.OCC + 1)


def test_divergence_and_qualities(spark):
    from seqloom.operators import measures, select

    chains = spark.createDataFrame([(1, 0, 20, 80, 20, 80, 4), (1, 1, 0, 60, 0, 60, 2)], "id long, rid long, qs int, qe int, rs int, re int, cnt int")
    seeds_ = spark.createDataFrame([(1, p) for p in (10, 39, 50, 60, 79, 95)], "id long, pos int")
    n = spark.createDataFrame([(1, 100)], "id long, len int")
    t = spark.createDataFrame([(0, 100), (1, 60)], "rid long, tlen int")
    got = {x.rid: x.div for x in measures.divergence(chains, seeds_, n, t, 15).collect()}
    assert got[0] == pytest.approx(1 - (4 / 6) ** (1 / 15)) and got[1] == pytest.approx(1 - (2 / 2) ** (1 / 15))
    cols = "id long, rank int, parent int, score int, cnt int, mlen int, blen int, dp_max int, qs int, qe int, qlen int, nn int, gap_bases int, gaps int, log_gaps double"
    hits = spark.createDataFrame([(1, 0, 0, 900, 60, 950, 1000, 1800, 0, 1000, 1000, 0, 0, 0, 0.0), (1, 1, 0, 880, 59, 930, 1000, 1750, 0, 1000, 1000, 0, 0, 0, 0.0), (2, 0, 0, 500, 40, 500, 500, 1000, 0, 500, 500, 0, 0, 0, 0.0)], cols)
    rep = spark.createDataFrame([(1, 10)], "id long, rep_len long")
    fit = {(x.id, x["rank"]): x.dp_max for x in select.rescale_scores(hits, 2, 4).collect()}
    assert fit == {(1, 0): int(2 * (950 - 10 * 50) + 0.499), (1, 1): int(2 * (930 - 10 * 70) + 0.499), (2, 0): 1000}
    mapq = {(x.id, x["rank"]): x.mapq for x in select.mapping_quality_aligned(hits, rep, 2).collect()}
    assert mapq[2, 0] == 60 and mapq[1, 1] == 0 and mapq[1, 0] == 24


def test_read_hash_is_of_name_and_length():
    import numpy as np

    from seqloom.operators.measures import read_hash

    def wang(x):
        m = 0xFFFFFFFF
        x = (x + (~(x << 15) & m)) & m
        x ^= x >> 10
        x = (x + (x << 3)) & m
        x ^= x >> 6
        x = (x + (~(x << 11) & m)) & m
        return x ^ (x >> 16)

    name, n = "read/1", 1234
    h = ord(name[0])
    for c in name[1:]:
        h = (31 * h + ord(c)) & 0xFFFFFFFF
    assert read_hash([name, None], np.array([n, n])).tolist() == [wang(h ^ ((wang(n) + wang(11)) & 0xFFFFFFFF)), wang((wang(n) + wang(11)) & 0xFFFFFFFF)]


def test_second_best_and_quality_come_before_hits_are_dropped(spark):
    """By plain arithmetic; read 1's second hit is too weak to stay, yet counts for the first one's quality."""
    rows = [(1, 0, 0, 200, 12), (1, 1, 0, 90, 12), (1, 2, 2, 60, 4), (2, 0, 0, 80, 6), (3, 0, 0, 150, 20), (3, 1, 0, 149, 25), (3, 2, 0, 148, 20)]
    hits = spark.createDataFrame([(*r, 0, False, 7 * r[1], 7 * r[1] + 5, 0, 5) for r in rows], "id long, rank int, parent int, score int, cnt int, rid long, rev boolean, rs int, re int, qs int, qe int")
    rep = spark.createDataFrame([(2, 50)], "id long, rep_len long")
    full = select.second_best(hits)
    out = {(x.id, x["rank"]): x for x in select.mapping_quality(select.select_secondary(full, 0.8, 38, 5), rep).collect()}
    assert sorted(out) == [(1, 0), (1, 2), (2, 0), (3, 0), (3, 1), (3, 2)]
    family = {(1, 0): (90, 1), (1, 2): (0, 0), (2, 0): (0, 0), (3, 0): (149, 2)}
    total = {1: 260, 2: 80, 3: 150}
    for i, rank, parent, score, cnt in rows:
        if (i, rank) in out:
            x, (second, subs) = out[i, rank], family.get((i, rank), (0, 0))
            assert (x.second, x.n_sub) == (second, subs)
            unique = total[i] / (total[i] + (50 if i == 2 else 0))
            sure = min((1 if score > 100 else 0.01 * score) * unique, 1 if cnt > 10 else 0.1 * cnt)
            q = int(sure * 40 * (1 - max(second, 40) / score) * math.log(score)) - int(4.343 * math.log(subs + 1) + 0.499)
            assert x.mapq == (min(60, max(0, q)) if rank == parent else 0)


def test_sketch_of_packed_bases(spark, sf_dir):
    from seqloom.operators import seeds
    from seqloom.operators.sketch import SeedFilter, sketch

    reads = q.reads(spark, sf_dir).withColumn("mark", F.col("id") % 7)
    columns = ["id", "ord", "pos", "hash", "span", "strand", "mark"]
    for method, options in (("minimizer", {"w": 10, "k": 19}), ("hpc", {"w": 10, "k": 19}), ("syncmer", {"k": 19, "s": 7})):
        rows = [set(map(tuple, sketch(reads, method, seq_col=c, carry=["mark"], **options).select(columns).collect())) for c in ("seq", "packed")]
        assert rows[0] and rows[0] == rows[1]
    known = sketch(q.targets(spark, sf_dir), id_col="rid", w=10, k=19)
    through = sketch(reads, seq_col="packed", only=SeedFilter(known, known.count()), w=10, k=19)
    all_ = sketch(reads, seq_col="packed", w=10, k=19)
    want = {tuple(r) for r in all_.join(known.select("hash").distinct(), "hash").select("id", "ord", "pos", "hash").collect()}
    got = through.join(known.select("hash").distinct(), "hash").select("id", "ord", "pos", "hash").collect()
    assert want == set(map(tuple, got)) and through.count() < all_.count() / 5
    counts = {r.id: r.n for r in all_.groupBy("id").agg(F.count("*").alias("n")).collect()}
    lengths = {r.id: len(r.seq) for r in reads.collect()}
    assert all(r.seeds == counts[r.id] and r.len == lengths[r.id] for r in through.collect())
    kept = seeds.drop_repeats_in_query(through, 2, 0.01).select("id", "pos").collect()
    assert set(kept) == set(seeds.drop_repeats_in_query(all_, 2, 0.01).join(through, ["id", "pos"], "left_semi").select("id", "pos").collect())


def test_reads_seeds_are_sketched_once_and_dealt_out_by_their_number(spark, sf_dir, monkeypatch):
    from seqloom.plans import mapping

    m = q.mapping(spark, sf_dir, None)
    plan = m.chains("greedy")._jdf.queryExecution().toString() + m.repetitive._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # neither sketch is in the plan any more
    assert m.matched.count() < m.read_seeds.count() / 5
    monkeypatch.setattr(mapping, "ROWS_A_TASK", 100)
    few = q.mapping(spark, sf_dir)
    n = few.anchors.count()
    assert few.grouped_anchors.rdd.getNumPartitions() >= n // 100 > 4
    assert few.grouped_anchors.count() == n


def test_selection_of_seeds_walks_a_read_once(spark):
    from seqloom.operators import seeds

    n = 40_000
    matched = spark.range(n).select(F.lit(1).alias("id"), F.col("id").cast("int").alias("ord"), (F.col("id") * 10).cast("int").alias("pos"), F.when(F.col("id") % 1000 == 0, 1).otherwise(20).alias("occ"))
    lengths = spark.createDataFrame([(1, 10 * n)], "id int, len int")
    out = seeds.select_seeds(matched, lengths, 10, 4095, 500)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    # 40 rare seeds; of the 999 between two of them, one for each 500 bases
    assert out.where("kept").count() == 40 + 40 * 20


@pytest.mark.parametrize("strict", [False, True])
def test_fastq_is_split_within_records(spark, tmp_path, strict):
    import gzip
    import random

    r = random.Random(5)

    def text(n):
        out = []
        for i in range(n):
            size = r.choice((0, 1, 7, 40, 400))
            qual = "".join(r.choice("@+I>") for _ in range(size if r.random() < 0.8 else size + 1))
            out += [f"@r{i} c{i}", "".join(r.choice("ACGTU") for _ in range(size)), r.choice(("+", "+", "x")), qual]
            out += r.choice(([], [], ["", "junk", "+"]))
        return "\n".join(out[: len(out) - r.randrange(4)]) + "\n"

    files = {f"f{k}.fq": text(60) for k in range(5)} | {"x.fa": ">a\nAC\nGU\n>b c\nGG\n", "empty.fq": "", "odd{1}[2].fq": text(9)}
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    (tmp_path / "y.fq.gz").write_bytes(gzip.compress(files["f0.fq"].encode()))
    (tmp_path / "z.fq").write_bytes(gzip.compress(files["f1.fq"].encode()))
    files |= {"y.fq.gz": files["f0.fq"], "z.fq": files["f1.fq"]}
    want = sorted((name, n, *rec) for name, t in files.items() for n, rec in enumerate(fastx.parse_records(iter(t.splitlines()), strict)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most, batch in (("700b", "10000"), ("90b", "3"), ("128m", "5")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            got = fastx.read_fastx(spark, str(tmp_path), strict).collect()
            assert sorted((x.file.rsplit("/", 1)[1], x.ordinal, x.name, x.comment, x.seq, x.qual) for x in got) == want
            assert all(x.file.startswith("file:/") and not x.file.startswith("file:///") for x in got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def test_stream_of_fasta_is_split_at_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.fa").write_text("".join(f">r{k}_{i} note\nAC\nGU{'T' * i}\n" for i in range(50)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500b")
    try:
        stream = fastx.stream_fasta(spark, str(tmp_path / "in")).withColumn("part", F.spark_partition_id())
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((x.name, x.comment, x.seq) for x in out) == sorted((f"r{k}_{i}", "note", "ACGT" + "T" * i) for k in range(3) for i in range(50))
    assert len({x.part for x in out}) > 3
