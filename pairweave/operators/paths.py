"""Cheapest paths: on the compiled graph for single ones, as joins for whole tables."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.compiled import INFINITE, Compiled
from ..storage import checkpointed


def shortest_path(own: Compiled, u: int | None, v: int | None) -> list[int | None]:
    """Nodes from ``u`` to ``v``; None is the boundary, and only an end of the path."""
    flip = u is None
    if flip:
        u, v = v, u
    goal = -1 if v is None else v
    dist, before, heap = {u: 0}, {u: None}, [(0, u)]
    while heap:
        d, x = heapq.heappop(heap)
        if x == goal:
            break
        if d > dist[x]:
            continue
        ways = [(y, w) for y, w, _ in own.near[x]]
        if goal == -1 and own.out[x] is not None:
            ways.append((-1, own.out[x][0]))
        for y, w in ways:
            if d + w < dist.get(y, INFINITE):
                dist[y], before[y] = d + w, x
                heapq.heappush(heap, (d + w, y))
    if goal not in dist:
        raise ValueError("there is no path between these nodes")
    path, x = [], goal
    while x is not None:
        path.append(None if x == -1 else x)
        x = before[x]
    return path if flip else path[::-1]


def distances(edges: DataFrame, sources: DataFrame | None = None, cut=None, most_rounds: int = 10_000) -> DataFrame:
    """(src, dst, d): cheapest distances over edges (node1, node2, weight >= 0), by min-plus joins until nothing changes.

    ``cut`` (a function from DataFrame to DataFrame that ends its lineage, by
    default ``DataFrame.checkpoint``) runs once a round.  Each round doubles
    the number of steps, so there are about log2 of the longest path's steps.
    """
    cut = cut or checkpointed
    both = edges.filter("node2 IS NOT NULL AND node1 <> node2").select("node1", "node2", "weight")
    both = both.unionByName(both.select(F.col("node2").alias("node1"), F.col("node1").alias("node2"), "weight"))
    step = both.groupBy(F.col("node1").alias("src"), F.col("node2").alias("dst")).agg(F.min("weight").alias("d"))
    nodes = step.select("src").distinct()
    start = nodes.select("src", F.col("src").alias("dst"), F.lit(0).cast(step.schema["d"].dataType).alias("d"))
    table = cut(start.unionByName(step))
    if sources is not None:
        table = cut(table.join(sources.select("src"), "src", "left_semi"))
        right = cut(start.unionByName(step))
    for _ in range(most_rounds):
        other = table if sources is None else right
        far = table.join(other.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("d").alias("more")), "dst").select("src", F.col("to").alias("dst"), (F.col("d") + F.col("more")).alias("d"))
        new = cut(table.unionByName(far).groupBy("src", "dst").agg(F.min("d").alias("d")))
        changed = new.join(table.withColumnRenamed("d", "old"), ["src", "dst"], "left").filter("old IS NULL OR d < old")
        done = changed.isEmpty()
        table = new
        if done:
            return table
    return table


def boundary_distances(table: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, b): the cheapest way to the boundary, from ``distances`` and the edges without a second node."""
    out = edges.filter("node2 IS NULL").groupBy(F.col("node1").alias("dst")).agg(F.min("weight").alias("w"))
    return table.join(out, "dst").groupBy(F.col("src").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("b"))


def connected(edges: DataFrame, cut=None, most_rounds: int = 10_000) -> DataFrame:
    """(node, comp): the least node of each node's connected component, by least labels of neighbours with pointer jumping."""
    cut = cut or checkpointed
    ends = edges.select("node1", F.coalesce("node2", "node1").alias("node2"))
    both = cut(ends.unionByName(ends.select(F.col("node2").alias("node1"), F.col("node1").alias("node2"))).distinct())
    labels = cut(both.groupBy(F.col("node1").alias("node")).agg(F.min(F.least("node1", "node2")).alias("comp")))
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("node2"), "comp"), "node2").groupBy(F.col("node1").alias("node")).agg(F.min("comp").alias("via"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "via").alias("via"))
        new = cut(step.join(labels.select(F.col("node").alias("via"), F.col("comp").alias("far")), "via", "left").select("node", "old", F.least("via", F.coalesce("far", "via")).alias("comp")))
        labels = new.select("node", "comp")
        if new.filter("old <> comp").isEmpty():
            break
    return labels
