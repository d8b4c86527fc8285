"""Splitting a graph by time, and decoding part by part.

The answer is that of the whole graph: rounds are only a way to deal nodes and
edges out.  ``split_shots`` cuts a shot where it can be cut without changing its
optimum - hits of different connected components of near pairs never meet - so
the parts of one long shot can be decoded by different tasks and added up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.graph import Matching


def rounds(nodes: DataFrame) -> DataFrame:
    """Nodes (node, coords) with their round, the last coordinate."""
    return nodes.withColumn("round", F.element_at("coords", -1).cast("long"))


def partitions(nodes: DataFrame, rounds_per_partition: int) -> DataFrame:
    """Adds partition, a tumbling window of rounds."""
    return nodes.withColumn("partition", F.floor(F.col("round") / rounds_per_partition).cast("long"))


def mark_crossing(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds is_cross_partition: the node of the later partition of an edge between two partitions."""
    a = nodes.select(F.col("node").alias("node1"), F.col("partition").alias("p1"))
    b = nodes.select(F.col("node").alias("node2"), F.col("partition").alias("p2"))
    both = edges.filter("node2 IS NOT NULL").select("node1", "node2").join(a, "node1").join(b, "node2").filter("p1 <> p2")
    upper = both.select(F.when(F.col("p1") > F.col("p2"), F.col("node1")).otherwise(F.col("node2")).alias("node")).distinct().withColumn("crosses", F.lit(True))
    return nodes.join(upper, "node", "left").withColumn("is_cross_partition", F.coalesce("crosses", F.lit(False))).drop("crosses")


def active_edges(edges: DataFrame, nodes: DataFrame, first: int, last: int) -> DataFrame:
    """Edges of the partitions from ``first`` to ``last``; one that leaves them becomes an edge to a virtual boundary."""
    own = nodes.filter(F.col("partition").between(first, last)).select("node")
    a = own.select(F.col("node").alias("node1"), F.lit(True).alias("in1"))
    b = own.select(F.col("node").alias("node2"), F.lit(True).alias("in2"))
    both = edges.join(a, "node1", "left").join(b, "node2", "left").filter("in1 OR in2")
    u = F.when(F.col("in1"), F.col("node1")).otherwise(F.col("node2"))
    v = F.when(F.col("in1") & F.col("in2"), F.col("node2"))
    return both.withColumns({"u": u, "v": v, "virtual": F.col("node2").isNotNull() & ~(F.coalesce("in1", F.lit(False)) & F.coalesce("in2", F.lit(False)))}).drop("node1", "node2", "in1", "in2").withColumnsRenamed({"u": "node1", "v": "node2"})


def split_shots(shots: DataFrame, graph: Matching, key: str = "shot") -> DataFrame:
    """(key, part, hits): each shot cut into the groups of hits that may be matched with each other."""
    own = graph.compiled()
    shared = shots.sparkSession.sparkContext.broadcast(own)
    kind = shots.schema[key].dataType.simpleString()

    def run(batches):
        own = shared.value
        for batch in batches:
            keys, parts, hits = [], [], []
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = own.hits(raw or [])
                group = {u: u for u in nodes}

                def find(x):
                    while group[x] != x:  # noqa: B023
                        x = group[x]  # noqa: B023
                    return x

                for u in nodes:
                    for v in own.ball(u).keys() & group.keys():
                        group[find(v)] = find(u)
                by: dict[int, list[int]] = {}
                for u in nodes:
                    by.setdefault(find(u), []).append(u)
                for i, own_hits in enumerate(sorted(by.values())):
                    keys.append(k), parts.append(i), hits.append(own_hits)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(np.array(parts, np.int32)), pa.array(hits, pa.list_(pa.int64()))], names=[key, "part", "hits"])

    return shots.select(key, F.col("hits").cast("array<long>")).mapInArrow(run, f"`{key}` {kind}, part int, hits array<long>")


def decode_in_parts(shots: DataFrame, graph: Matching, key: str = "shot") -> DataFrame:
    """(key, mask, weight_int): parts are dealt out, solved on their own and added up; equal to decoding whole shots."""
    own = graph.compiled()
    shared = shots.sparkSession.sparkContext.broadcast(own)
    kind = shots.schema[key].dataType.simpleString()
    parts = split_shots(shots, graph, key).repartition(key, "part")

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.match(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for _, m, _ in found], pa.int64()), pa.array([w for w, _, _ in found], pa.int64())], names=[key, "mask", "weight_int"])

    solved = parts.mapInArrow(run, f"`{key}` {kind}, mask long, weight_int long").groupBy(key).agg(F.bit_xor("mask").alias("mask"), F.sum("weight_int").alias("weight_int"))
    both = shots.select(key).join(solved, key, "left")
    return both.select(key, F.coalesce("mask", F.lit(0).cast("long")).bitwiseXOR(F.lit(own.negative_mask)).alias("mask"), (F.coalesce("weight_int", F.lit(0).cast("long")) + own.negative_sum).alias("weight_int"))


def decode_windows(shots: DataFrame, graph: Matching, nodes: DataFrame, key: str = "shot") -> DataFrame:
    """(key, first, last, mask, weight_int): what each window of time gives to each shot, exactly.

    ``nodes`` (node, partition) deal the graph to windows.  A group of hits within
    one window is solved there (first = last); a group that reaches over a border is
    solved by the windows that it joins, fused (first to last).  Masks XORed and
    weights added up over a shot's windows are those of the whole shot; negative edges are on no window.
    """
    own = graph.compiled()
    shared = shots.sparkSession.sparkContext.broadcast(own)
    kind = shots.schema[key].dataType.simpleString()
    parts = split_shots(shots, graph, key)
    place = nodes.select("node", "partition")
    each = parts.select(key, "part", F.explode("hits").alias("node")).join(place, "node")
    dealt = each.groupBy(key, "part").agg(F.min("partition").alias("first"), F.max("partition").alias("last"), F.sort_array(F.collect_list("node")).alias("hits")).repartition("first", "last", key)

    def run(batches):
        own = shared.value
        for batch in batches:
            found = [own.match(h) for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([m for _, m, _ in found], pa.int64()), pa.array([w for w, _, _ in found], pa.int64())], names=[key, "first", "last", "mask", "weight_int"])

    solved = dealt.select(key, "first", "last", "hits").mapInArrow(run, f"`{key}` {kind}, first long, last long, mask long, weight_int long")
    return solved.groupBy(key, "first", "last").agg(F.bit_xor("mask").alias("mask"), F.sum("weight_int").alias("weight_int"))
