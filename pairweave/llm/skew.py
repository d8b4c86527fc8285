"""Joins of many rows with one row a key, where a few keys may hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many keys are dealt out, to parts of about how many rows, and to how many parts at least and at most.
HOT, ROWS, PARTS, MOST = 1000, 100_000, 64, 10_000


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, spread: Column, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right`` (unique ``keys``; ``n`` rows of ``left`` each), the ``HOT`` most frequent keys dealt to parts by ``spread``.

    A key that isn't among them has less than a thousandth of all rows.  The
    list of hot keys is broadcast: HOT rows at most.  ``n`` is dropped.  It may
    come in ``counts`` (``keys`` and ``n``) instead of ``right``, where that is less to read.
    """
    parts = F.least(F.greatest(F.lit(PARTS), F.ceil(F.col(n) / ROWS)), F.lit(MOST)).cast("int")
    hot = F.broadcast((right if counts is None else counts).orderBy(F.desc(n), *keys).limit(HOT).select(*keys, parts.alias("parts_")))
    part = F.when(F.col("parts_").isNotNull(), F.pmod(F.xxhash64(spread), F.col("parts_")).cast("int")).otherwise(F.lit(0))
    every = F.explode(F.when(F.col("parts_").isNotNull(), F.sequence(F.lit(0), F.col("parts_") - 1)).otherwise(F.array(F.lit(0))))
    dealt = left.join(hot, keys, "left").withColumn("part_", part).drop("parts_")
    copied = right.join(hot, keys, "left").withColumn("part_", every).drop("parts_", n)
    return dealt.join(copied, [*keys, "part_"], how).drop("part_")
