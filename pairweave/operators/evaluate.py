"""Mistakes and error rates of predictions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_mistakes(predicted: DataFrame, actual: DataFrame, key: str = "shot", column: str = "mask", by: tuple[str, ...] = ()) -> DataFrame:
    """mistakes and shots, by group if asked; a predicted shot without an actual one stops the query."""
    both = predicted.join(actual.select(key, F.col(column).alias("actual_")), key, "left")
    wrong = F.when(F.col("actual_").isNull(), F.raise_error(F.lit("the observables end before the shots")).cast("boolean")).otherwise(F.col(column) != F.col("actual_"))
    return both.groupBy(*by).agg(F.sum(wrong.cast("long")).alias("mistakes"), F.count(F.lit(1)).alias("shots"))


def summary(counted: DataFrame) -> DataFrame:
    return counted.select(F.format_string("%d / %d", "mistakes", "shots").alias("summary"))


def _beta_quantile(q: float, a: float, b: float) -> float:
    low, high = 0.0, 1.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _beta_cdf(mid, a, b) < q else (low, mid)
    return (low + high) / 2


def _beta_cdf(x: float, a: float, b: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(1000):
        m = i // 2
        n = 1.0 if i == 0 else (m * (b - m) * x) / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -((a + m) * (a + b + m) * x) / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or tiny)
        c = (1 + n / c) or tiny
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1)


def binomial_interval(mistakes: int, shots: int, confidence: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson."""
    rest = (1 - confidence) / 2
    low = 0.0 if mistakes == 0 else _beta_quantile(rest, mistakes, shots - mistakes + 1)
    high = 1.0 if mistakes == shots else _beta_quantile(1 - rest, mistakes + 1, shots - mistakes)
    return low, high


def error_rates(counted: DataFrame, confidence: float = 0.95) -> DataFrame:
    """Adds rate, low and high, the Clopper-Pearson interval, to rows of mistakes and shots; null where there are no shots."""
    ends = "struct<low:double,high:double>"

    @F.pandas_udf(ends)
    def interval(mistakes: pd.Series, shots: pd.Series) -> pd.DataFrame:
        found = [binomial_interval(int(m), int(n), confidence) if n else (None, None) for m, n in zip(mistakes, shots)]
        return pd.DataFrame(found, columns=["low", "high"]).astype(float)

    both = counted.withColumn("rate", F.when(F.col("shots") > 0, F.col("mistakes") / F.col("shots"))).withColumn("interval", interval("mistakes", "shots"))
    return both.select(*counted.columns, "rate", "interval.low", "interval.high")
