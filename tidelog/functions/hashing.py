"""Hashes whose values other systems observe (partition numbers, checksums)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# FNV-1a parameters.
FNV32_OFFSET, FNV32_PRIME = 2166136261, 16777619
FNV64_OFFSET, FNV64_PRIME = 14695981039346656037, 1099511628211


def fnv32(text: Column) -> Column:
    """FNV-1a, 32 bits, over the UTF-8 bytes, as a bigint; null stays null.

    A fold over the byte values in the JVM: no Python runs.
    """
    pairs = F.hex(F.encode(text, "UTF-8"))
    size = F.length(pairs) / 2
    value = lambda i: F.conv(F.substring(pairs, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    step = lambda h, i: (h.bitwiseXOR(value(i)) * F.lit(FNV32_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    folded = F.aggregate(F.sequence(F.lit(1), size.cast("int")), F.lit(FNV32_OFFSET).cast("bigint"), step)
    return F.when(text == "", F.lit(FNV32_OFFSET).cast("bigint")).when(text.isNotNull(), folded)


def fnv32_of(data: bytes) -> int:
    """:func:`fnv32` of bytes on the driver."""
    h = FNV32_OFFSET
    for b in data:
        h = (h ^ b) * FNV32_PRIME & 0xFFFFFFFF
    return h


def fnv64(text: Column) -> Column:
    """FNV-1a, 64 bits, as a decimal text (the value exceeds a signed bigint).

    The product needs 128 bits, so it runs in decimals, digit by digit in two
    halves: h * prime mod 2**64 with prime = 2**40 + 435.
    """
    pairs = F.hex(F.encode(text, "UTF-8"))
    value = lambda i: F.conv(F.substring(pairs, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
    low, high = F.lit(FNV64_OFFSET & 0xFFFFFFFF).cast("bigint"), F.lit(FNV64_OFFSET >> 32).cast("bigint")

    def step(h: Column, i: Column) -> Column:
        # (high, low) are 32-bit halves; only the lowest byte takes the xor
        lo = h["low"].bitwiseXOR(value(i))
        product = lo * F.lit(435)
        carried = F.shiftright(product, 32) + h["high"] * F.lit(435) + F.shiftleft(lo.bitwiseAND(F.lit(0xFFFFFF)), 8)
        return F.struct(product.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"), carried.bitwiseAND(F.lit(0xFFFFFFFF)).alias("high"))

    start = F.struct(low.alias("low"), high.alias("high"))
    size = (F.length(pairs) / 2).cast("int")
    both = F.when(text == "", start).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), start, step))
    number = both["high"].cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(11,0)") + both["low"].cast("decimal(20,0)")
    return F.when(text.isNotNull(), number.cast("decimal(20,0)").cast("string"))


def record_crc32(payload: Column) -> Column:
    """CRC-32 of a spill record's payload."""
    return F.crc32(F.encode(payload, "UTF-8"))
