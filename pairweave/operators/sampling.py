"""Sampling of independent edge errors, and random numbers.

Streams of numbers are those of numpy and Spark, seeded explicitly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_rng = np.random.default_rng()


def set_seed(seed: int) -> None:
    global _rng
    _rng = np.random.default_rng(seed)


def randomize() -> None:
    global _rng
    _rng = np.random.default_rng()


def rand_float(low: float, high: float) -> float:
    return float(_rng.uniform(low, high))


def sample(graph, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(fault parities, syndrome) of one sample, boundary nodes being zero."""
    rng = rng or _rng
    faults, syndrome = np.zeros(graph.num_fault_ids, np.uint8), np.zeros(graph.num_nodes, np.uint8)
    for u, v, own, _, p in graph._edges:
        if rng.random() < p:
            for f in own:
                faults[f] ^= 1
            for x in (u, v):
                if x is not None:
                    syndrome[x] ^= 1
    syndrome[list(graph.boundary)] = 0
    return faults, syndrome


def sample_shots(spark: SparkSession, edges: DataFrame, n: int, seed: int = 0, flip=None, boundary: DataFrame | None = None) -> DataFrame:
    """(shot, hits, faults) of ``n`` samples of the edges (seq, node1, node2, fault_ids, error_probability).

    Edges are collected into one array column (a graph's size), so samples are
    made by array functions without a shuffle.  ``flip(shot, seq, p)`` says
    which edges fail: by default a hash of (seed, shot, seq) below p, so that a
    sample doesn't depend on partitions.
    """
    rows = edges.select("seq", "node1", "node2", "fault_ids", "error_probability").agg(F.array_sort(F.collect_list(F.struct("seq", "node1", "node2", "fault_ids", "error_probability"))).alias("edges"))
    if flip is None:
        flip = lambda shot, seq, p: F.pmod(F.xxhash64(F.lit(seed), shot, seq), F.lit(1 << 52)) / float(1 << 52) < p
    outer = F.lit(None).cast("array<long>") if boundary is None else None
    shots = spark.range(n).withColumnRenamed("id", "shot").crossJoin(F.broadcast(rows))
    if boundary is not None:
        shots = shots.crossJoin(F.broadcast(boundary.agg(F.collect_list("node").alias("outer"))))
    else:
        shots = shots.withColumn("outer", outer)
    failed = F.filter("edges", lambda e: flip(F.col("shot"), e["seq"], e["error_probability"]))
    ends = F.filter(F.flatten(F.transform(failed, lambda e: F.array(e["node1"], e["node2"]))), lambda x: x.isNotNull())
    odd = lambda all_: F.filter(F.array_sort(F.array_distinct(all_)), lambda x: F.size(F.filter(all_, lambda y: y == x)) % 2 == 1)
    hits = F.when(F.col("outer").isNull(), odd(F.col("ends"))).otherwise(F.array_except(odd(F.col("ends")), F.col("outer")))
    return shots.withColumn("failed", failed).withColumns({"ends": ends, "all_faults": F.flatten(F.transform(failed, lambda e: e["fault_ids"]))}).select("shot", hits.alias("hits"), odd(F.col("all_faults")).alias("faults"))


def flip_probabilities(errors: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """p of a random share of the errors (err, p) becomes 1 - p."""
    return errors.withColumn("p", F.when(F.pmod(F.xxhash64(F.lit(seed), F.col("err")), F.lit(1 << 52)) / float(1 << 52) < share, 1 - F.col("p")).otherwise(F.col("p")))
