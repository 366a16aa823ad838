"""Bit-level column functions; everything is BIGINT, so that no shift or product overflows under ANSI rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits(x: Column, shift: int, mask: int) -> Column:
    """(x >> shift) & mask."""
    return F.shiftright(x, shift).bitwiseAND(F.lit(mask).cast("long"))


def gray2bin(x: Column) -> Column:
    """Binary value of a Gray code of up to 16 bits."""
    for k in (8, 4, 2, 1):
        x = x.bitwiseXOR(F.shiftright(x, k))
    return x


def sign_extend(x: Column, width: int = 5) -> Column:
    """Two's complement value of the low ``width`` bits."""
    return F.when(x < 1 << width - 1, x).otherwise(x - (1 << width))


def ip_to_int(ip: Column) -> Column:
    """Number of a dotted IPv4 address."""
    parts = F.split(ip, r"\.")
    return sum((parts[i].cast("long") * (1 << 8 * (3 - i)) for i in range(1, 4)), parts[0].cast("long") * (1 << 24))


def int_to_ip(x: Column) -> Column:
    """Dotted IPv4 address of a number."""
    return F.concat_ws(".", *(bits(x, s, 255).cast("string") for s in (24, 16, 8, 0)))


def offset_bits(offset: Column) -> Column:
    """The five raw bits of a signed offset, as text."""
    return F.lpad(F.bin(F.pmod(offset.cast("long"), F.lit(32).cast("long"))), 5, "0")


CHANNELS = 640


def pack_triplet(c1: Column, c2: Column, c3: Column) -> Column:
    """One key of three channel numbers."""
    return c1.cast("long") + c2.cast("long") * CHANNELS + c3.cast("long") * CHANNELS * CHANNELS


def unpack_triplet(key: Column) -> Column:
    """struct(c1, c2, c3) of a key."""
    return F.struct((key % CHANNELS).alias("c1"), (F.floor(key / CHANNELS) % CHANNELS).alias("c2"), F.floor(key / (CHANNELS * CHANNELS)).alias("c3"))
