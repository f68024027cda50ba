"""Plans: from reads and targets to chains, hits and records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import basealign, chain, seeds, select, sketch
from ..session import materialize
from ..sources import records
from .config import MapOptions

#: Rows of a few numbers that are sent to every executor at most, some tens of MB.
FEW = 1 << 18
ROWS_A_TASK = 1 << 18


def bases_of(df: DataFrame) -> Column:
    """Number of a sequence's bases, from packed where df has it."""
    return 2 * F.octet_length("packed") if "packed" in df.columns else F.length("seq")


@dataclass
class Mapping:
    """Reads (id long, qname, seq) mapped to targets (rid long, tname, seq). Each stage is a DataFrame; nothing runs until one is asked for.

    Tables may have packed, the sequence as two bases a byte (see sketch), which is then read for sketches and lengths.

    occ_limit: occurrences above which a seed is not used. Without it a cut-off follows from the targets' seeds, by one small job, and of each
    run of seeds above it the rarest are used, one for each occ_distance bases, none of over max_occ occurrences.

    Whatever asks for matches sketches all targets and then all reads once: the targets' seeds, and the reads' seeds that targets may have by a
    filter of their hashes, are written to the shared folder.
    """

    reads: DataFrame
    targets: DataFrame
    options: MapOptions
    occ_limit: int | None = None

    def _sketch(self, df: DataFrame, id_col: str, **more) -> DataFrame:
        o = self.options
        return sketch.sketch(df, "hpc" if o.hpc else "minimizer", id_col=id_col, seq_col="packed" if "packed" in df.columns else "seq", w=o.w, k=o.k, **more)

    @cached_property
    def read_seeds(self) -> DataFrame:
        return self._sketch(self._reads_in_length, "id")

    @property
    def _reads_in_length(self) -> DataFrame:
        """The reads that are not longer than max_query_length, if that is set."""
        most = self.options.max_query_length
        return self.reads.where(bases_of(self.reads) <= most) if most else self.reads

    @cached_property
    def target_seeds(self) -> DataFrame:
        return self._sketch(self.targets, "rid")

    @cached_property
    def known(self) -> DataFrame:
        """The targets' seeds, written."""
        return materialize(self.target_seeds, "target-seeds")

    @cached_property
    def known_number(self) -> int:
        return self.known.count()

    @cached_property
    def matched(self) -> DataFrame:
        """The reads' seeds that targets may have, with len and seeds, written: what no target has goes no further than the sketch."""
        return materialize(self._sketch(self._reads_in_length, "id", only=sketch.SeedFilter(self.known, self.known_number)), "read-seeds")

    def _beside_reads(self, df: DataFrame) -> DataFrame:
        """A table of the targets' seeds for a join, sent to every executor if it is small, so that the reads' seeds stay where they are."""
        return F.broadcast(df) if self.known_number <= FEW else df

    @cached_property
    def index(self) -> DataFrame:
        return self._beside_reads(seeds.build_index(self.known))

    @cached_property
    def counts(self) -> DataFrame:
        return self._beside_reads(seeds.occurrences(self.known))

    @cached_property
    def lengths(self) -> DataFrame:
        return self.reads.select("id", bases_of(self.reads).alias("len"))

    @cached_property
    def matched_lengths(self) -> DataFrame:
        return self.matched.groupBy("id").agg(F.first("len").alias("len"))

    @cached_property
    def most(self) -> int:
        o = self.options
        if self.occ_limit is not None:
            return self.occ_limit
        return seeds.mid_occ(seeds.occurrences(self.known), o.mid_occ_fraction, o.min_mid_occ, o.max_mid_occ).first()["mid_occ"]

    @cached_property
    def chosen(self) -> DataFrame:
        """The reads' seeds that targets have, with occ and kept; without those that repeat within a read."""
        o = self.options
        own = seeds.drop_repeats_in_query(self.matched, self.most, o.query_occ_fraction) if self.occ_limit is None and o.query_occ_fraction > 0 else self.matched
        distance = o.occ_distance if self.occ_limit is None else 0
        return seeds.choose_seeds(own, self.counts, self.matched_lengths, self.most, o.max_occ, distance)

    @property
    def anchors(self) -> DataFrame:
        """(id, rid, rev, ref_pos, query_pos, span): matches of seeds; with no_dual only where the read's name is not after the target's, with no_diagonal without a read's match with itself in place."""
        return self._anchors.drop("len")

    @cached_property
    def _anchors(self) -> DataFrame:
        o = self.options
        if self.occ_limit is not None:
            found = seeds.anchors(self.matched, self.index, None, self.most, keep_len=True)
        else:
            found = seeds.anchors(self.chosen.where("kept").drop("occ", "kept"), self.index, None, max(self.most, o.max_occ), keep_len=True)
        if not (o.no_dual or o.no_diagonal):
            return found
        columns = found.columns
        found = found.join(self.reads.select("id", F.col("qname").alias("__q"), bases_of(self.reads).alias("__n")), "id").join(self.targets.select("rid", F.col("tname").alias("__t"), bases_of(self.targets).alias("__m")), "rid")
        if o.no_dual:
            found = found.where("__q <= __t")
        if o.no_diagonal:
            found = found.where("not (__q = __t and __n = __m and not rev and ref_pos = query_pos)")
        return found.select(columns)

    @cached_property
    def grouped_anchors(self) -> DataFrame:
        """Anchors with len, dealt out by read, target and strand to as many tasks as keep each to some ROWS_A_TASK rows.

        Their bytes in a shuffle say little, as anchors take some thirty times as much where they are sorted.
        """
        spark = self.reads.sparkSession
        rows = self.matched.select("hash").join(self.counts, "hash").where(F.col("occ") <= (self.most if self.occ_limit is not None else max(self.most, self.options.max_occ))).agg(F.sum("occ").alias("n")).first()["n"] or 0
        return self._anchors.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), "id", "rid", "rev")

    def chains(self, method: str = "dp") -> DataFrame:
        """method greedy; or dp: dynamic programming or, as the options say, range minima, and again within bandwidth_long for reads of several chains."""
        o = self.options
        if o.strand not in ("both", "forward", "reverse"):
            raise ValueError("strand is both, forward or reverse")
        if method == "greedy":
            c = chain.greedy_chains(self.grouped_anchors, None, o.max_gap, o.bandwidth)
            c = c.where((F.col("score") >= o.min_chain_score) & (F.col("cnt") >= o.min_cnt))
        else:
            if o.splice:
                raise NotImplementedError("these options ask for splice-aware chaining and alignment, which the mapping plan does not have")
            costs = (o.min_cnt, o.min_chain_score, o.gap_penalty, o.skip_penalty)
            c = chain.dp_chains(self.grouped_anchors, None, o.max_gap, o.bandwidth, *costs, inner=o.inner_distance if o.rmq else None)
            if o.bandwidth_long > o.bandwidth and not o.short_reads:
                c = chain.rescue_chains(c, self.matched_lengths, o.max_gap, o.bandwidth_long, *costs, inner=o.inner_distance)
        return c if o.strand == "both" else c.where(F.col("rev") == F.lit(o.strand == "reverse"))

    @cached_property
    def repetitive(self) -> DataFrame:
        return seeds.repetitive_length(self.chosen.where(~F.col("kept")))

    def hits(self, method: str = "dp") -> DataFrame:
        """Primary and secondary hits with parents and mapping quality."""
        o = self.options
        if o.all_chains:  # each hit is primary
            found = select.rank_hits(self.chains(method))
            return select.mapping_quality(select.second_best(found.withColumn("parent", F.col("rank"))), self.repetitive, o.min_chain_score)
        found = select.second_best(select.assign_parents(self.chains(method), o.mask_level))
        return select.mapping_quality(select.select_secondary(found, o.secondary_ratio, 2 * o.k, o.best_n), self.repetitive, o.min_chain_score)

    @cached_property
    def found(self) -> DataFrame:
        """hits("dp"), written."""
        return materialize(self.hits("dp"), "hits")

    @cached_property
    def found_reads(self) -> DataFrame:
        """The reads that have hits, or all reads if more of them have hits than fit a broadcast."""
        ids = self.found.select("id").distinct()
        return self.reads.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= FEW else self.reads

    def paf(self, method: str = "dp") -> DataFrame:
        """(id, rank, line): PAF without base alignment; matches and block length follow from the chain's seeds, or are bounds from its interval if it is greedy."""
        q = self.reads.select("id", "qname", bases_of(self.reads).alias("qlen"))
        t = self.targets.select(F.col("rid").cast("long").alias("rid"), "tname", bases_of(self.targets).alias("tlen"))
        rows = self.hits(method).join(q, "id").join(t, "rid")
        if method == "greedy":
            rows = rows.withColumn("blen", F.greatest(F.col("qe") - F.col("qs"), F.col("re") - F.col("rs"))).withColumn("mlen", F.least("score", "blen"))
        return records.paf(rows)

    def aligned(self) -> DataFrame:
        """Hits with base-level alignments, ranked by their score, less those whose anchors, score or matches are too few; quality follows from chains and alignments.

        Scores of reads of 500 bases and more are fitted to the best hit's divergence, and hits are sifted again.
        """
        o = self.options
        enough = (o.min_cnt, o.min_chain_score, o.min_dp_score, o.max_clip)
        found = select.long_enough(basealign.align_hits(self.found, self.found_reads, self.targets, o.scoring, o.max_gap), *enough)
        if not (o.short_reads or o.all_chains):
            fitted = select.rescale_scores(select.rank_hits(found.withColumn("__old", F.col("dp_max")), "dp_max"), o.scoring.match, o.scoring.mismatch).drop("rank")
            found = select.long_enough(fitted.withColumn("dp_max", F.when(F.col("qlen") >= 500, F.col("dp_max")).otherwise(F.col("__old"))).drop("__old"), *enough)
        if o.all_chains:
            found = select.rank_hits(found, "dp_max").withColumn("parent", F.col("rank"))
        else:
            found = select.assign_parents(found, o.mask_level, by="dp_max")
        found = select.mapping_quality_aligned(select.second_best(found), self.repetitive, o.scoring.match, o.min_chain_score)
        found = found.join(self.repetitive, "id", "left").withColumn("rep_len", F.coalesce("rep_len", F.lit(0).cast("long")))
        return found if o.all_chains else select.select_secondary(found, o.secondary_ratio, 2 * o.k, o.best_n)

    def paf_aligned(self) -> DataFrame:
        """(id, rank, line): PAF with base alignment."""
        return records.paf_aligned(self.aligned())

    def sam(self) -> DataFrame:
        """(id, rank, flag, line): SAM lines of aligned hits."""
        qual = F.col("qual") if "qual" in self.reads.columns else F.lit(None).cast("string")
        return records.sam(records.with_others(self.aligned()).join(self.found_reads.select("id", "seq", qual.alias("qual")), "id"))
