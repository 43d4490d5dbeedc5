"""Unsigned 64-bit arithmetic in signed longs (ANSI mode raises on overflow, so words are multiplied in parts), and Hamming functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW32 = (1 << 32) - 1
# fixed values: multipliers and masks of the edge hash
U1, V1 = 6364136223846793005, 1442695040888963407
UX, UM = 0x9E3779B97F4A7C15, 0xC6A4A7935BD1E995
VX, VM = 0x5555555555555555, 0x5BD1E9955BD1E995


def signed(x: int) -> int:
    """The signed long with the same bits."""
    return x - (1 << 64) if x >= 1 << 63 else x


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW32))


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def add(a: Column, b: Column) -> Column:
    """a + b modulo 2^64."""
    low = _low(a) + _low(b)
    high = _high(a) + _high(b) + _high(low)
    return F.shiftleft(_low(high), 32).bitwiseOR(_low(low))


def multiply(x: Column, constant: int) -> Column:
    """x * constant modulo 2^64, from 16-bit parts of x and 32-bit parts of the constant: no product passes 2^48."""
    c0, c1 = constant & LOW32, constant >> 32
    part = lambda k: F.shiftrightunsigned(x, 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long"))
    low = part(0) * c0
    low = add(low, F.shiftleft(part(1) * c0, 16))
    high = part(0) * c1  # of x's low half times the constant's high half, modulo 2^32
    high = _low(high) + _low(F.shiftleft(part(1) * c1, 16)) + _low(part(2) * c0) + _low(F.shiftleft(part(3) * c0, 16))
    return add(low, F.shiftleft(_low(high), 32))


def edge_words(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Adds h1 and h2, the two words of each edge."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    d = edges.withColumn("_a", multiply(a, U1)).withColumn("_b", multiply(b, V1)).withColumn("h1", add(F.col("_a"), F.col("_b")))
    d = d.withColumn("_a", multiply(a.bitwiseXOR(F.lit(signed(UX))), UM)).withColumn("_b", multiply(b.bitwiseXOR(F.lit(signed(VX))), VM))
    return d.withColumn("h2", add(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def hamming(lo1: Column, hi1: Column, lo2: Column, hi2: Column) -> Column:
    return F.bit_count(lo1.bitwiseXOR(lo2)) + F.bit_count(hi1.bitwiseXOR(hi2))


def affinity(h: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - h / 128.0))


def recalibrated(h: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (affinity(h) - 0.5) / 0.5))


#: Similarity strictly above 0.75 of 128 bits.
MATCH_DISTANCE = 31
