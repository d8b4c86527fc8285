"""From the user's edges to the integer graph, as DataFrame plans.

Edges are (seq, node1, node2 or null, weight, fault_ids), nodes (node,
is_boundary).  Constants of the graph (its normaliser, the sum of negative
weights) are one-row frames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import mask_of
from ..functions.weights import MAX_WEIGHT


def normaliser(edges: DataFrame, implied: DataFrame | None = None) -> DataFrame:
    """One row: norm, 1 if all weights are whole, else (2^24 - 1) / largest; and scale, twice that."""
    all_ = edges.select("weight") if implied is None else edges.select("weight").unionByName(implied.select("weight"))
    whole, top = F.min(F.col("weight") == F.floor("weight")), F.max(F.abs("weight"))
    norm = F.when(F.coalesce(whole, F.lit(True)), F.lit(1.0)).otherwise(F.lit(float(MAX_WEIGHT)) / top)
    checked = F.when(top > MAX_WEIGHT, F.raise_error(F.lit("maximum absolute edge weight exceeded")).cast("double")).otherwise(norm)
    return all_.agg(checked.alias("norm")).withColumn("scale", F.col("norm") * 2)


def half_away(x: Column) -> Column:
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def integer_weights(edges: DataFrame, norm: DataFrame) -> DataFrame:
    """Adds weight_int = 2 * round(weight * norm), halves away from zero.  ``norm`` is one row."""
    return edges.crossJoin(F.broadcast(norm.select("norm"))).withColumn("weight_int", 2 * half_away(F.col("weight") * F.col("norm"))).drop("norm")


def collapse_boundary(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges to boundary nodes become edges of one node; the least signed weight of a node's stays, the first of equal ones; edges between boundary nodes go."""
    out = nodes.filter("is_boundary").select("node")
    first = edges.join(out.withColumnsRenamed({"node": "node1"}).withColumn("out1", F.lit(True)), "node1", "left")
    both = first.join(out.withColumnsRenamed({"node": "node2"}).withColumn("out2", F.lit(True)), "node2", "left")
    at1, at2 = F.coalesce("out1", F.lit(False)), F.coalesce("out2", F.lit(False)) | F.col("node2").isNull()
    kept = both.filter(~(at1 & at2)).withColumn("at_boundary", at1 | at2).withColumn("u", F.when(at1, F.col("node2")).otherwise(F.col("node1")))
    inner = kept.filter("NOT at_boundary").select("seq", "node1", "node2", "weight", "fault_ids")
    best = kept.filter("at_boundary").groupBy("u").agg(F.min_by(F.struct("seq", "weight", "fault_ids"), F.struct("weight", "seq")).alias("x"))
    edge = best.select("x.seq", F.col("u").alias("node1"), F.lit(None).cast("long").alias("node2"), "x.weight", "x.fault_ids")
    return inner.unionByName(edge)


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, other or null, weight, mask, negative): both directions, absolute weights, labels as bits; loops left out."""
    value = [F.abs("weight").alias("weight"), mask_of(F.col("fault_ids")).alias("mask"), (F.col("weight") < 0).alias("negative")]
    real = edges.filter("node2 IS NULL OR node1 <> node2")
    there = real.select(F.col("node1").alias("node"), F.col("node2").alias("other"), *value)
    back = real.filter("node2 IS NOT NULL").select(F.col("node2").alias("node"), F.col("node1").alias("other"), *value)
    return there.unionByName(back)


def negative_part(edges: DataFrame) -> DataFrame:
    """One row: the sum of negative weights and the labels they toggle."""
    own = edges.filter("weight < 0")
    return own.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("negative_sum"), F.coalesce(F.bit_xor(mask_of(F.col("fault_ids"))), F.lit(0).cast("long")).alias("negative_mask"))


def toggled_nodes(edges: DataFrame) -> DataFrame:
    """Nodes at an odd number of ends of negative edges."""
    ends = edges.filter("weight < 0").select(F.explode(F.array("node1", "node2")).alias("node")).filter("node IS NOT NULL")
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").select("node")
