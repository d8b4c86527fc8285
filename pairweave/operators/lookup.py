"""Point lookups and counts on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edge(edges: DataFrame, u: int, v: int | None) -> DataFrame:
    """The edge of two nodes in either direction, or with None the boundary edge; no row if there is none."""
    if v is None:
        return edges.filter((F.col("node1") == u) & F.col("node2").isNull())
    return edges.filter(((F.col("node1") == u) & (F.col("node2") == v)) | ((F.col("node1") == v) & (F.col("node2") == u)))


def has_edges(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node1, node2 or null) with a column there."""
    key = lambda: (F.least("node1", F.coalesce("node2", "node1")), F.when(F.col("node2").isNull(), F.lit(-1)).otherwise(F.greatest("node1", "node2")))
    a, b = key()
    own = edges.select(a.alias("k1"), b.alias("k2"), F.lit(True).alias("there")).distinct()
    asked = wanted.withColumns({"k1": a, "k2": b})
    return asked.join(own, ["k1", "k2"], "left").select("node1", "node2", F.coalesce("there", F.lit(False)).alias("there"))


def counts(edges: DataFrame, nodes: DataFrame | None = None, least_faults: int = 0) -> DataFrame:
    """One row: num_nodes, num_edges, num_detectors, num_fault_ids, max_abs_weight, all_probabilities."""
    of = edges.agg(
        F.coalesce(F.max(F.greatest("node1", F.coalesce("node2", F.lit(-1)))) + 1, F.lit(0)).cast("long").alias("n1"),
        F.count(F.lit(1)).alias("num_edges"),
        F.greatest(F.coalesce(F.max(F.array_max("fault_ids")) + 1, F.lit(0)), F.lit(least_faults)).cast("long").alias("num_fault_ids"),
        F.max(F.abs("weight")).cast("double").alias("max_abs_weight"),
        F.coalesce(F.min(F.coalesce(F.col("error_probability").between(0, 1), F.lit(False))), F.lit(True)).alias("all_probabilities"),
    )
    if nodes is None:
        return of.select(F.col("n1").alias("num_nodes"), "num_edges", F.col("n1").alias("num_detectors"), "num_fault_ids", "max_abs_weight", "all_probabilities")
    out = nodes.agg(F.coalesce(F.max("node") + 1, F.lit(0)).cast("long").alias("n2"), F.sum(F.col("is_boundary").cast("long")).alias("outer"))
    n = F.greatest("n1", "n2")
    return of.crossJoin(out).select(n.alias("num_nodes"), "num_edges", (n - F.coalesce("outer", F.lit(0))).alias("num_detectors"), "num_fault_ids", "max_abs_weight", "all_probabilities")
