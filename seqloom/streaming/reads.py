"""Reads that arrive as a stream, mapped against a static index.

Each record stands by itself, so there is no state and no watermark: a micro-batch is joined to the index and written under its number;
a batch that runs again overwrites itself, so each read's hits are written once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chain, seeds, select, sketch
from ..plans.config import MapOptions
from ..session import materialize


def map_stream(reads: DataFrame, targets: DataFrame, options: MapOptions, occ_limit: int | None, out: str, checkpoint: str) -> StreamingQuery:
    """Start a query that writes the best hit of each read of the stream reads(id, seq) under out, as Parquet by batch.

    occ_limit is Mapping's: without it the targets' seeds give the cut-off, and of frequent seeds the rarest are used.
    """
    kind = "hpc" if options.hpc else "minimizer"
    o = options
    index = materialize(seeds.build_index(sketch.sketch(targets, kind, id_col="rid", w=o.w, k=o.k), occ_limit), "stream-index")
    counts = index.select("hash", "occ").distinct()
    most = occ_limit if occ_limit is not None else seeds.mid_occ(counts, o.mid_occ_fraction, o.min_mid_occ, o.max_mid_occ).first()["mid_occ"]

    through = sketch.SeedFilter(index, index.count())

    def batch(rows: DataFrame, number: int) -> None:
        found = sketch.sketch(rows, kind, w=o.w, k=o.k, only=through)
        if occ_limit is None:
            found = seeds.choose_seeds(found, counts, None, most, o.max_occ, o.occ_distance).where("kept").drop("occ", "kept")
        found = seeds.anchors(found, index, None, most if occ_limit is not None else max(most, o.max_occ), keep_len=True)
        # few bytes in a shuffle that take far more where they are sorted: dealt out by number, adaptive execution does not merge them
        found = found.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id", "rid", "rev")
        chains = chain.greedy_chains(found, None, options.max_gap, options.bandwidth)
        chains = chains.where((F.col("score") >= options.min_chain_score) & (F.col("cnt") >= options.min_cnt))
        select.best_hit(chains).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
