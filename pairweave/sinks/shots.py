"""Prediction files, in the formats of ``sources.shots``."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bits import pack_bits


def encode(masks: Iterable[int], fmt: str, width: int) -> bytes:
    """Predicted observables, one shot after another; masks are bit sets of any size."""
    masks = list(masks)
    bits = lambda m: [m >> i & 1 for i in range(width)]
    if fmt == "b8":
        return b"".join(m.to_bytes((width + 7) // 8, "little") for m in masks)
    if fmt == "r8":
        out = bytearray()
        for m in masks:
            gap = 0
            for b in [*bits(m), 1]:
                if b:
                    out += b"\xff" * (gap // 255) + bytes([gap % 255])
                    gap = 0
                else:
                    gap += 1
        return bytes(out)
    if fmt == "ptb64":
        if len(masks) % 64:
            raise ValueError("ptb64 needs a multiple of 64 shots")
        out = b""
        for at in range(0, len(masks), 64):
            table = np.array([bits(m) for m in masks[at : at + 64]], np.uint8).reshape(64, width)
            out += np.packbits(table.T, axis=1, bitorder="little").tobytes()
        return out
    lines = {"01": lambda m: "".join(map(str, bits(m))), "hits": lambda m: ",".join(str(i) for i in range(width) if m >> i & 1), "dets": lambda m: " ".join(["shot", *(f"L{i}" for i in range(width) if m >> i & 1)])}
    if fmt not in lines:
        raise ValueError(f"unknown format {fmt!r}")
    return "".join(lines[fmt](m) + "\n" for m in masks).encode()


def lines(prediction: Column, fmt: str) -> Column:
    """A text line of an array of 0 and 1."""
    ones = F.filter(F.transform(prediction, lambda x, i: F.when(x == 1, i)), lambda x: x.isNotNull())
    if fmt == "01":
        return F.array_join(prediction, "")
    if fmt == "hits":
        return F.array_join(ones, ",")
    if fmt == "dets":
        return F.concat_ws(" ", F.lit("shot"), F.transform(ones, lambda x: F.concat(F.lit("L"), x.cast("string"))))
    raise ValueError(f"format {fmt!r} isn't text")


def write(decoded: DataFrame, path: str, fmt: str = "01", column: str = "prediction", key: str = "shot") -> None:
    """A folder of text parts in the order of shots, or for b8 a Parquet table of packed shots."""
    if fmt == "b8":
        decoded.select(key, pack_bits(F.col(column)).alias("packed")).write.parquet(path)
        return
    decoded.select(key, lines(F.col(column), fmt).alias("value")).repartitionByRange(key).sortWithinPartitions(key).select("value").write.text(path)
