"""Weights and probabilities, for single values and as DataFrame columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WEIGHT = (1 << 24) - 1


def merge_weights(a: float, b: float) -> float:
    """The log-odds weight of exactly one of two independent faults."""
    return math.copysign(1, a) * math.copysign(1, b) * min(abs(a), abs(b)) + math.log1p(math.exp(-abs(a + b))) - math.log1p(math.exp(-abs(a - b)))


def merge_probabilities(p: float, q: float) -> float:
    """The probability of exactly one of two independent faults; -1 if either isn't a probability."""
    return p * (1 - q) + q * (1 - p) if 0 <= p <= 1 and 0 <= q <= 1 else -1.0


def log_odds(p: float) -> float:
    """ln((1 - p) / p), infinite at 0 and 1."""
    return math.inf if p == 0 else -math.inf if p == 1 else math.log((1 - p) / p)


def merge_weights_column(a: Column, b: Column) -> Column:
    return F.signum(a) * F.signum(b) * F.least(F.abs(a), F.abs(b)) + F.log1p(F.exp(-F.abs(a + b))) - F.log1p(F.exp(-F.abs(a - b)))


def merge_probabilities_column(p: Column, q: Column) -> Column:
    both = p.between(0, 1) & q.between(0, 1)
    return F.when(both, p * (1 - q) + q * (1 - p)).otherwise(F.lit(-1.0))


def log_odds_column(p: Column) -> Column:
    """As ``log_odds``; Spark's ln(0) would be null."""
    inf = F.lit(float("inf"))
    return F.when(p == 0, inf).when(p == 1, -inf).otherwise(F.ln((1 - p) / p))
