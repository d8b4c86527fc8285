"""Shared plumbing of the Arrow-batched operators.

Texts reach Python as the raw UTF-8 buffers of Arrow batches and are cut into
row groups of about ``CHUNK`` bytes, so temporary arrays are bounded by a few
times ``CHUNK`` or by the longest single text, whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes, or of one larger row; nothing is copied."""
    n = batch.num_rows
    if n > 1 and (n > BATCH_ROWS or batch.nbytes > BATCH_BYTES):
        yield from slices(batch.slice(0, n // 2))
        yield from slices(batch.slice(n // 2))
    elif n:
        yield batch


def batched(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` over bounded parts of the batches, however large the session lets those be."""
    return df.mapInArrow(lambda batches: run(part for batch in batches for part in slices(batch)), schema)


def smaller_batches(spark: SparkSession) -> None:
    """For queries, not operators: smaller Arrow batches, less memory; a limit that the session has been given stays."""
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not spark._jsparkSession.conf().contains(key):
            spark.conf.set(key, value)


def views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; null counts as empty."""
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], body[at[0] : at[-1]]


def row_groups(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes, or of one longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def texts(column: pa.Array) -> list[bytes]:
    """The values as bytes, null as empty."""
    at, body = views(column)
    raw = body.tobytes()
    ends = at.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``mapInArrow`` by a function from a batch to a dict of columns, in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(each(batch))

    return batched(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), run, schema)


def ids_and_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text's bytes, whatever other columns there are."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
