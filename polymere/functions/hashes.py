"""Hashes of bytes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LOW = (1 << 32) - 1


def fnv1a(c: Column) -> Column:
    """64-bit FNV-1a of a text's or a binary's bytes, as a signed number.

    The product with 2^40 + 0x1b3 is made in halves of 32 bits, as a whole one
    would overflow.
    """
    digits = F.hex(c.cast("binary"))
    spots = F.filter(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(2)), lambda i: i < F.length(digits))
    start = F.struct(F.lit(0xCBF29CE4).cast("bigint").alias("hi"), F.lit(0x84222325).cast("bigint").alias("lo"))

    def step(h: Column, i: Column) -> Column:
        low = h["lo"].bitwiseXOR(F.conv(F.substring(digits, i, F.lit(2)), 16, 10).cast("bigint"))
        product = low * 0x1B3
        high = h["hi"] * 0x1B3 + low * 0x100 + F.shiftrightunsigned(product, 32)
        return F.struct(high.bitwiseAND(F.lit(_LOW)).alias("hi"), product.bitwiseAND(F.lit(_LOW)).alias("lo"))

    return F.when(c.isNotNull(), F.aggregate(spots, start, step, lambda h: F.shiftleft(h["hi"], 32).bitwiseOR(h["lo"])))
