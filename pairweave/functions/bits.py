"""Bit masks, parity and packed bits, as DataFrame columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_of(ids: Column) -> Column:
    """The LONG with the bits of an array of ids (each below 64), equal ids cancelling."""
    return F.aggregate(ids, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.cast("int"))))


def bits_of(mask: Column, n: Column | int) -> Column:
    """The first ``n`` bits of a LONG as an array of 0 and 1."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(at, lambda i: F.call_function("shiftrightunsigned", mask, i).bitwiseAND(F.lit(1)).cast("int"))


#: The places of the set bits of each byte.
_PLACES = "array(" + ", ".join("CAST(array({}) AS array<int>)".format(", ".join(str(i) for i in range(8) if b >> i & 1)) for b in range(256)) + ")"


def _bytes(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("CAST(array() AS array<int>)"))


def set_bits(packed: Column) -> Column:
    """The places of the set bits of a binary, the lowest bit of the first byte being 0; a byte is looked up once."""
    digits = F.hex(packed)
    byte = lambda k: F.conv(F.substring(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("int")
    return F.flatten(F.transform(_bytes(F.length(packed)), lambda k: F.transform(F.element_at(F.expr(_PLACES), byte(k) + 1), lambda x: x + k * 8)))


def pack_bits(bits: Column) -> Column:
    """An array of 0 and 1 as a binary, eight bits a byte, the first in the lowest bit; the last byte is filled with 0."""
    byte = lambda k: F.lpad(F.conv(F.array_join(F.reverse(F.slice(bits, k * 8 + 1, F.lit(8))), ""), 2, 16), 2, F.lit("0"))
    return F.unhex(F.array_join(F.transform(_bytes(F.ceil(F.size(bits) / 8).cast("int")), byte), ""))


def packed_of(ids: Column, n: int) -> Column:
    """The binary of ``n`` bits, filled up to a byte, in which those at ``ids`` (each once) are set."""
    one = lambda x: F.call_function("shiftleft", F.lit(1), (x % 8).cast("int"))
    byte = lambda k: F.aggregate(F.filter(ids, lambda x: F.floor(x / 8) == k), F.lit(0), lambda acc, x: acc + one(x))
    return F.unhex(F.array_join(F.transform(_bytes(F.lit((n + 7) // 8)), lambda k: F.lpad(F.hex(byte(k)), 2, F.lit("0"))), ""))


def symmetric_difference(a: Column, b: Column) -> Column:
    """Elements in one of two arrays only, sorted."""
    return F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
