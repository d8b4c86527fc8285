"""Structured Streaming: shots decoded as they come, and hits gathered into shots by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core.graph import Matching
from ..operators.decode import decode


def decode_stream(shots: DataFrame, graph: Matching, outputs: tuple[str, ...] = ("mask", "weight"), **options) -> DataFrame:
    """A stream of shots with the outputs of ``operators.decode``: stateless, so any trigger and append mode do."""
    return decode(shots, graph, outputs, **options)


def shots_of_events(events: DataFrame, node: str = "node", at: str = "ts", keys: tuple[str, ...] = ("user_id",), window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(keys, window, hits) of a stream of single hits: those of a tumbling window, an even number of equal ones cancelling.

    Events later than the watermark are dropped, as a closed shot may have been
    decoded already.
    """
    gathered = events.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), *keys).agg(F.array_sort(F.collect_list(F.col(node).cast("long"))).alias("all"))
    odd = F.filter(F.array_distinct("all"), lambda x: F.size(F.filter("all", lambda y: y == x)) % 2 == 1)
    return gathered.select(*keys, "window", odd.alias("hits"))
