"""Correlated errors: joint probabilities, implied weights, and reweighting after a first pass."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.weights import log_odds, log_odds_column


def _xor(p: float, q: float) -> float:
    return p * (1 - q) + q * (1 - p)


def implied_rules(errors: Iterable) -> dict[tuple, list]:
    """{(u, v): [((a, b), weight)]} of decomposed errors (p, [(detectors, observables)]), -1 being the boundary."""
    joint: dict[tuple, dict[tuple, float]] = {}
    for p, parts in errors:
        keys = [(d[0], d[1]) if len(d) == 2 else (d[0], -1) for d, _ in parts]
        for i, a in enumerate(keys):
            for b in keys[i + 1 :]:
                for x, y in ((a, b), (b, a)):
                    row = joint.setdefault(x, {})
                    row[y] = _xor(row.get(y, 0.0), p)
        for a in keys:
            row = joint.setdefault(a, {})
            row[a] = _xor(row.get(a, 0.0), p)
    rules = {}
    for a, row in joint.items():
        if row[a]:
            own = [(b, log_odds(min(0.5, p / row[a]))) for b, p in sorted(row.items()) if b != a and p > 0]
            if own:
                rules[a] = own
    return rules


def joint_probabilities(components: DataFrame) -> DataFrame:
    """(a, b, p) of rows (err, p, edge): the probability that an odd number of errors has both edges, a = b for one alone.

    The self-join is on the error, whose components are few by construction.
    """
    one = components.select("err", "p", "edge").distinct()
    other = one.select("err", F.col("edge").alias("b"))
    both = one.withColumnRenamed("edge", "a").join(other, "err")
    sign = F.when(F.col("p") > 0.5, -1).otherwise(1)
    size = F.sum(F.when(F.col("p") != 0.5, F.ln(F.abs(1 - 2 * F.col("p")))))
    half = F.max(F.col("p") == 0.5)
    negative = F.sum(F.when(sign < 0, 1).otherwise(0)) % 2 == 1
    p = (1 - F.when(half, F.lit(0.0)).otherwise(F.exp(size) * F.when(negative, -1).otherwise(1))) / 2
    return both.groupBy("a", "b").agg(p.alias("p"))


def implied_weights(joint: DataFrame) -> DataFrame:
    """(a, b, weight): what edge b weighs at most once a is known to have happened."""
    alone = joint.filter("a = b").select("a", F.col("p").alias("own"))
    p = F.least(F.lit(0.5), F.col("p") / F.col("own"))
    return joint.filter("a <> b").join(alone, "a").filter("own <> 0").select("a", "b", log_odds_column(p).alias("weight"))


def checked_rules(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """``rules`` with the target's weight, stopping if a target doesn't exist or would change its sign."""
    own = edges.select(F.col("edge").alias("b"), F.col("weight").alias("now"))
    missing = F.when(F.col("now").isNull(), F.raise_error(F.lit("a rule's target isn't an edge")).cast("double")).when((F.col("now") < 0) & (F.col("weight") >= 0), F.raise_error(F.lit("a rule would change the sign of a weight")).cast("double")).otherwise(F.col("now"))
    return rules.join(own, "b", "left").select("a", "b", "weight", missing.alias("now"))


def reweight(first_pass: DataFrame, rules: DataFrame, key: str = "shot") -> DataFrame:
    """(key, edge, weight): the least weight implied by the edges (key, edge) of a first pass, where it is below the edge's own (``now``)."""
    hit = first_pass.join(rules.withColumnRenamed("a", "edge"), "edge")
    return hit.groupBy(key, F.col("b").alias("edge")).agg(F.least(F.min("weight"), F.min("now")).alias("weight"), F.min("now").alias("now")).filter("weight < now").select(key, "edge", "weight")
