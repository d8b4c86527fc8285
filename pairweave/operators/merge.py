"""Parallel edges folded into one, as grouped aggregations.

Rows are (seq, node1, node2 or null, weight, error_probability or null,
fault_ids); an edge is the unordered pair of its nodes.  The result keeps the
place (seq) and the direction of an edge's first row.  Aggregates that pick a
row are partial: each task sends one row an edge.  The independent merge sums
logarithms, which is partial too; ``fold="ordered"`` gathers an edge's rows and
folds them in order instead, for results equal to the last bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.weights import MAX_WEIGHT, merge_probabilities_column, merge_weights_column

STRATEGIES = ("disallow", "independent", "smallest-weight", "keep-original", "replace")


def edge_key() -> list[Column]:
    return [F.least("node1", F.coalesce("node2", "node1")).alias("k1"), F.when(F.col("node2").isNull(), F.lit(-1)).otherwise(F.greatest("node1", "node2")).cast("long").alias("k2")]


def within_limit(edges: DataFrame) -> DataFrame:
    """Edges that aren't too heavy to be added."""
    return edges.filter(F.abs("weight") <= MAX_WEIGHT)


def merge(edges: DataFrame, strategy: str, fold: str = "closed") -> DataFrame:
    if strategy not in STRATEGIES:
        raise ValueError(f"merge strategy {strategy!r} isn't one of {', '.join(STRATEGIES)}")
    rows = edges.select(*edge_key(), "*")
    first = [F.min("seq").alias("seq"), F.min_by("node1", "seq").alias("node1"), F.min_by("node2", "seq").alias("node2")]
    value = F.struct("weight", "error_probability", "fault_ids")
    out = ["seq", "node1", "node2"]
    if strategy == "disallow":
        n = F.count(F.lit(1))
        checked = F.when(n > 1, F.raise_error(F.lit("parallel edges need another merge strategy than disallow"))).otherwise(F.min_by(value, "seq"))
        return rows.groupBy("k1", "k2").agg(*first, checked.alias("x")).select(*out, "x.*")
    if strategy == "keep-original":
        return rows.groupBy("k1", "k2").agg(*first, F.min_by(value, "seq").alias("x")).select(*out, "x.*")
    if strategy == "replace":
        return rows.groupBy("k1", "k2").agg(*first, F.max_by(value, "seq").alias("x")).select(*out, "x.*")
    if strategy == "smallest-weight":
        return rows.groupBy("k1", "k2").agg(*first, F.min_by(value, F.struct("weight", "seq")).alias("x")).select(*out, "x.*")
    keep = F.min_by("fault_ids", "seq").alias("fault_ids")
    if fold == "closed":
        return _closed(rows).select(*out, "weight", "error_probability", "fault_ids")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "weight", F.coalesce("error_probability", F.lit(-1.0)).alias("p"))))
    start = F.col("all")[0]
    folded = F.aggregate(
        F.slice("all", F.lit(2), F.size("all")),
        F.struct(start["weight"].alias("weight"), start["p"].alias("p")),
        lambda acc, x: F.struct(merge_weights_column(acc["weight"], x["weight"]).alias("weight"), merge_probabilities_column(acc["p"], x["p"]).alias("p")),
    )
    grouped = rows.groupBy("k1", "k2").agg(*first, ordered.alias("all"), keep)
    return grouped.withColumn("x", folded).select(*out, F.col("x.weight").alias("weight"), F.when(F.col("x.p").between(0, 1), F.col("x.p")).alias("error_probability"), "fault_ids")


#: Weights are summed apart by spans of this size, in each of which e^-w is far from the least float.
_SPAN = 512


def _closed(rows: DataFrame) -> DataFrame:
    """The independent merge: tanh(w / 2) = 1 - 2p, and both multiply, so signs are counted and ln tanh(w / 2) = log1p(-2 / (e^w + 1)) is summed.

    The merged weight ln((1 + x) / (1 - x)) of x = e^sum is log1p(e^sum) - ln(-expm1(sum)).  From a
    weight of ``_SPAN`` on that is -ln of the sum of e^-w, taken relative to the lightest span.  An
    edge has one row a task and span after the first step.
    """
    size, p = F.abs("weight"), F.col("error_probability")
    span = F.floor(size / _SPAN)
    term = F.when(size < _SPAN, F.log1p(-2 / (F.exp(F.least(size, F.lit(float(_SPAN)))) + 1))).otherwise(F.exp(span * _SPAN - size))
    flips = lambda x: F.sum(F.when(x, 1).otherwise(0))
    place = F.struct("seq", "node1", "node2", "fault_ids")
    some = rows.groupBy("k1", "k2", span.alias("span")).agg(
        F.min_by(place, "seq").alias("place"), F.count(F.lit(1)).alias("n"), F.sum(term).alias("term"), F.min(size).alias("least"), flips(F.col("weight") < 0).alias("negative"),
        F.min(F.coalesce(p.between(0, 1), F.lit(False))).alias("ok"), F.sum(F.when(p != 0.5, F.ln(F.abs(1 - 2 * p)))).alias("p_log"), flips(p > 0.5).alias("p_negative"), F.max(F.coalesce(p == 0.5, F.lit(False))).alias("p_half"),
    )
    least, low, total = F.min("least"), F.min("span"), F.sum(F.when(F.col("span") == 0, F.col("term")))
    heavy = F.aggregate(F.filter("spans", lambda x: x["span"] > 0), F.lit(0.0), lambda acc, x: acc + x["term"] * F.exp(-_SPAN * (x["span"] - F.col("low")).cast("double")))
    one = some.groupBy("k1", "k2").agg(
        F.min_by("place", "place.seq").alias("place"), F.sum("n").alias("n"), least.alias("least"), low.alias("low"), total.alias("total"), F.sum("negative").alias("negative"), F.collect_list(F.struct("span", "term")).alias("spans"),
        F.min("ok").alias("ok"), F.sum("p_log").alias("p_log"), F.sum("p_negative").alias("p_negative"), F.max("p_half").alias("p_half"),
    )
    light = F.col("total") - 2 * heavy
    merged = F.when((F.col("n") == 1) | (F.col("least") == 0), F.col("least")).when(F.col("low") == 0, F.log1p(F.exp(light)) - F.ln(-F.expm1(light))).otherwise(F.col("low") * _SPAN - F.ln(heavy))
    sign = lambda c: F.when(F.col(c) % 2 == 1, -1.0).otherwise(1.0)
    chance = F.when(F.col("ok"), (1 - F.when(F.col("p_half"), F.lit(0.0)).otherwise(F.exp(F.coalesce("p_log", F.lit(0.0))) * sign("p_negative"))) / 2)
    return one.select("place.*", (merged * sign("negative")).alias("weight"), chance.alias("error_probability"))
