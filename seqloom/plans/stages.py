"""Runs in stages that can be resumed: each stage's table is written once, with a manifest that says what it was made from."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, seeds, select, sketch
from ..session import delete
from .config import MapOptions


class StageRun:
    """Stages under one folder. A stage that is complete and was made from the same inputs is read, not made again."""

    def __init__(self, spark: SparkSession, folder: str, identity: dict) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.identity = hashlib.sha256(json.dumps(identity, sort_keys=True, default=str).encode()).hexdigest()
        self.made: list[str] = []

    def _manifest(self, name: str) -> list[str]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.manifest")
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return []
        return [r.value for r in self.spark.read.text(f"{self.folder}/{name}.manifest").collect()]

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.folder}/{name}"
        said = self._manifest(name)
        if said and said != [f"{name} {self.identity}"]:
            raise ValueError(f"{path} was made from other inputs, or its manifest is damaged")
        if not said:
            delete(self.spark, path)  # what a broken run has left
            make().write.parquet(path)
            self.spark.createDataFrame([(f"{name} {self.identity}",)], "value string").coalesce(1).write.text(f"{path}.manifest")
            self.made.append(name)
        return self.spark.read.parquet(path)


def map_sharded(reads: DataFrame, shards: dict[str, DataFrame], options: MapOptions, folder: str, occ_limit: int) -> tuple[DataFrame, StageRun]:
    """Reads(id, seq) mapped to the targets(rid, seq) of each shard apart, ranked as if the targets were one set.

    Occurrences are counted by shard and added up, so each shard prunes by the whole's counts; chains of all shards are then ranked together.
    """
    run = StageRun(reads.sparkSession, folder, {"options": asdict(options), "shards": sorted(shards), "occ": occ_limit})
    seeds_of = lambda df, key: sketch.sketch(df, "hpc" if options.hpc else "minimizer", id_col=key, w=options.w, k=options.k)
    own = {s: run.stage(f"seeds-{s}", lambda t=t: seeds_of(t, "rid")) for s, t in shards.items()}
    counts = [seeds.occurrences(x) for x in own.values()]
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    whole = run.stage("occurrences", lambda: total.groupBy("hash").agg(F.sum("occ").alias("occ")))
    read_seeds = run.stage("read-seeds", lambda: seeds_of(reads, "id"))
    lengths = reads.select("id", F.length("seq").alias("len"))
    chains = None
    for s, x in own.items():
        index = x.select("hash", F.col("id").alias("rid"), F.col("pos").alias("tpos"), F.col("strand").alias("tstrand")).join(whole, "hash")
        part = run.stage(f"chains-{s}", lambda index=index: chain.greedy_chains(seeds.anchors(read_seeds, index, lengths, occ_limit), lengths, options.max_gap, options.bandwidth))
        chains = part if chains is None else chains.unionByName(part)
    return run.stage("ranked", lambda: select.rank_hits(chains)), run
