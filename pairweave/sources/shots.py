"""Shot files: 01, b8, r8, ptb64, hits and dets.

``parse`` and ``parse_stream`` decode bytes on the driver, for the command line.
``read`` gives a DataFrame (shot, hits, observables) for large files, on any
file system that Spark reads: text formats go through the text reader, b8 and
ptb64 through fixed-length records, both split, with dense shot numbers from the
order of splits.  r8 shots have no fixed length: each file is one task's.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bits import set_bits

FORMATS = ("01", "b8", "r8", "ptb64", "hits", "dets")


def parse(data: bytes, fmt: str, num_detectors: int, num_observables: int = 0) -> Iterator[tuple[list[int], list[int]]]:
    """(hits, observables) of each shot; observables are those appended to the detectors."""
    width = num_detectors + num_observables

    def split(ones) -> tuple[list[int], list[int]]:
        return [x for x in ones if x < num_detectors], [x - num_detectors for x in ones if x >= num_detectors]

    if fmt == "b8":
        size = (width + 7) // 8
        if size and len(data) % size:
            raise ValueError(f"{len(data)} bytes aren't whole shots of {size}")
        for at in range(0, len(data), size or 1):
            yield split(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[:width]).tolist())
    elif fmt == "r8":
        at, ones = 0, []
        for byte in data:
            at += byte
            if byte < 255:
                if at > width:
                    raise ValueError("an r8 shot is longer than the graph")
                if at == width:
                    yield split(ones)
                    at, ones = 0, []
                else:
                    ones.append(at)
                    at += 1
        if at or ones:
            raise ValueError("the last r8 shot isn't ended")
    elif fmt == "ptb64":
        if len(data) % (8 * width or 1):
            raise ValueError("ptb64 data must have whole groups of 64 shots")
        for at in range(0, len(data), 8 * width or 1):
            bits = np.unpackbits(np.frombuffer(data, np.uint8, 8 * width, at).reshape(width, 8), axis=1, bitorder="little")
            for shot in bits.T:
                yield split(np.flatnonzero(shot).tolist())
    elif fmt in FORMATS:
        for line in data.decode("ascii").splitlines():
            yield parse_line(line, fmt, num_detectors, num_observables)
    else:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")


def parse_line(line: str, fmt: str, num_detectors: int, num_observables: int = 0) -> tuple[list[int], list[int]]:
    line = line.strip()
    if fmt == "01":
        if len(line) != num_detectors + num_observables or set(line) - {"0", "1"}:
            raise ValueError(f"a shot needs {num_detectors + num_observables} digits 0 or 1: {line[:40]!r}")
        ones = [i for i, c in enumerate(line) if c == "1"]
        return [x for x in ones if x < num_detectors], [x - num_detectors for x in ones if x >= num_detectors]
    if fmt == "hits":
        ones = [int(x) for x in line.split(",") if x]
        return [x for x in ones if x < num_detectors], [x - num_detectors for x in ones if x >= num_detectors]
    if not line.startswith("shot"):
        raise ValueError(f"a dets line begins with shot: {line[:40]!r}")
    hits: set[int] = set()
    observables: set[int] = set()
    for word in line.split()[1:]:
        if word[0] not in "DL" or not word[1:].isdigit():
            raise ValueError(f"bad word in a dets line: {word!r}")
        (hits if word[0] == "D" else observables).symmetric_difference_update({int(word[1:])})
    return sorted(hits), sorted(observables)


def _records(spark: SparkSession, path: str, size: int) -> DataFrame:
    """value: the records of ``size`` bytes of a file, split like any; a rest stops the query."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    total = at.getFileSystem(sc._jsc.hadoopConfiguration()).getFileStatus(at).getLen()
    if total % size:
        raise ValueError(f"{total} bytes aren't whole shots of {size}")
    rows = sc._jsc.sc().binaryRecords(path, size, sc._jsc.hadoopConfiguration())
    return DataFrame(spark._jsparkSession.createDataset(rows, sc._jvm.org.apache.spark.sql.Encoders.BINARY()).toDF(), spark)


def _numbered(rows: DataFrame, *splits: str) -> DataFrame:
    """(shot, value): numbers from 0 in the order of the columns that tell splits apart, without bringing rows together."""
    placed = rows.select("*", F.monotonically_increasing_id().alias("at"))
    chunks = placed.groupBy(*splits).agg(F.min("at").alias("least"), F.count(F.lit(1)).alias("n")).orderBy(*splits).collect()  # a row a split
    offset, moved = 0, []
    for c in chunks:
        moved.append((*(c[x] for x in splits), offset - c.least))
        offset += c.n
    kind = ", ".join(f"{x} {rows.schema[x].dataType.simpleString()}" for x in splits)
    return placed.join(F.broadcast(rows.sparkSession.createDataFrame(moved, f"{kind}, by long")), list(splits)).select((F.col("at") + F.col("by")).alias("shot"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(shot, line) of a text file or folder, numbered from 0 in the order of files and lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    return _numbered(lines, "file", "start").withColumnRenamed("value", "line")


def read(spark: SparkSession, path: str, fmt: str, num_detectors: int, num_observables: int = 0) -> DataFrame:
    """(shot, hits, observables) of a file, or for text formats a folder of files."""
    width = num_detectors + num_observables
    split = lambda ones: [F.filter(ones, lambda x: x < num_detectors).alias("hits"), F.transform(F.filter(ones, lambda x: x >= num_detectors), lambda x: x - num_detectors).alias("observables")]
    if fmt == "b8":
        rows = _numbered(_records(spark, path, (width + 7) // 8).withColumn("split", F.spark_partition_id()), "split")
        return rows.select("shot", *split(F.transform(set_bits(F.col("value")), lambda x: x.cast("long"))))
    if fmt == "ptb64":
        rows = _numbered(_records(spark, path, 8 * width).withColumn("split", F.spark_partition_id()), "split")
        bits = rows.select("shot", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.substring("value", i * 8 + 1, F.lit(8)))).alias("bit", "word"))
        each = bits.select("shot", "bit", F.explode(set_bits(F.col("word"))).alias("of"))
        found = each.groupBy((F.col("shot") * 64 + F.col("of")).alias("shot")).agg(F.array_sort(F.collect_list(F.col("bit").cast("long"))).alias("ones"))
        shots = rows.select(F.explode(F.sequence(F.col("shot") * 64, F.col("shot") * 64 + 63)).alias("shot")).join(found, "shot", "left")
        return shots.select("shot", *split(F.coalesce("ones", F.expr("CAST(array() AS array<long>)"))))
    if fmt == "r8":
        kind = pa.list_(pa.int64())

        def shots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for data in batch.column(0):
                    found = parse(data.as_py(), "r8", num_detectors, num_observables)
                    while part := list(islice(found, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in part], kind), pa.array([o for _, o in part], kind)], names=["hits", "observables"])

        raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(shots, "hits array<long>, observables array<long>")
        rows = raw.select(F.struct("hits", "observables").alias("value"), F.spark_partition_id().alias("split"))
        return _numbered(rows, "split").select("shot", "value.hits", "value.observables")
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known are {', '.join(FORMATS)}")
    lines = numbered_lines(spark, path)
    text = F.trim("line")
    if fmt == "01":
        checked = F.when((F.length(text) == num_detectors + num_observables) & text.rlike("^[01]*$"), text).otherwise(F.raise_error(F.lit("a shot has the wrong length or other characters than 0 and 1")))
        digits = F.split(checked, "")
        ones = F.filter(F.transform(digits, lambda x, i: F.when(x == "1", i.cast("long"))), lambda x: x.isNotNull())
        return lines.select("shot", *split(ones))
    if fmt == "hits":
        ones = F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: x.cast("long"))
        return lines.select("shot", *split(ones))
    words = F.split(text, r"\s+")
    pick = lambda c: F.transform(F.filter(words, lambda w: w.startswith(c)), lambda w: F.substring(w, 2, 20).cast("long"))
    odd = lambda ids: F.filter(F.array_sort(F.array_distinct(ids)), lambda x: F.size(F.filter(ids, lambda y: y == x)) % 2 == 1)
    return lines.select("shot", odd(pick("D")).alias("hits"), odd(pick("L")).alias("observables"))


def zip_observables(shots: DataFrame, observables: DataFrame) -> DataFrame:
    """Shots with the observables of a second file, by number; a shot without any stops the query."""
    own = observables.select("shot", F.col("observables").alias("own"))
    there = F.when(F.col("own").isNull(), F.raise_error(F.lit("the observables end before the shots")).cast("array<long>")).otherwise(F.col("own"))
    return shots.drop("observables").join(own, "shot", "left").select("shot", "hits", there.alias("observables"))
