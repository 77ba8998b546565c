"""Fixed-width little-endian numbers in binary columns, as built-in column expressions.

Everything here stays inside whole-stage codegen. A double is rebuilt from its IEEE 754 fields: scaling by a
power of two is exact, so the result is bit-for-bit the stored value.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmframe.plans.once import computed_once

_MANTISSA = 1 << 52


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slice_bytes(b: Column | str, off: Column | int, n: Column | int) -> Column:
    """``n`` bytes from the 0-based offset ``off``; shorter where the value ends earlier."""
    start = F.lit(off) if isinstance(off, int) else off
    size = F.lit(n) if isinstance(n, int) else n
    return F.substring(_col(b), (start + 1).cast("int"), size.cast("int"))


def _little(digits: Column, off: int, n: int) -> Column:
    """Hex digits of ``n`` little-endian bytes at byte ``off`` of a hex text, most significant first."""
    return F.concat(*[F.substring(digits, 2 * (off + i) + 1, 2) for i in range(n - 1, -1, -1)])


def u8_in_hex(digits: Column | str, off: int) -> Column:
    return F.conv(F.substring(_col(digits), 2 * off + 1, 2), 16, 10).cast("int")


def u32_in_hex(digits: Column | str, off: int) -> Column:
    """Unsigned 32-bit number at byte ``off`` of bytes given as hex text; the text must reach that far."""
    return F.conv(_little(_col(digits), off, 4), 16, 10).cast("bigint")


def f64_bits_in_hex(digits: Column | str, off: int) -> Column:
    """The 64 bits of a double at byte ``off`` of bytes given as hex text; the text must reach that far."""
    return F.conv(_little(_col(digits), off, 8), 16, -10).cast("bigint")


def u8(b: Column | str, off: Column | int) -> Column:
    return u8_in_hex(F.hex(slice_bytes(b, off, 1)), 0)


def u32_le(b: Column | str, off: Column | int) -> Column:
    """Little-endian unsigned 32-bit integer at a byte offset; null where fewer than 4 bytes are left."""
    piece = slice_bytes(b, off, 4)
    return F.when(F.length(piece) == 4, u32_in_hex(F.hex(piece), 0))


def f64_bits(b: Column | str, off: Column | int) -> Column:
    """The 64 bits of a little-endian double as a bigint; null where fewer than 8 bytes are left."""
    piece = slice_bytes(b, off, 8)
    return F.when(F.length(piece) == 8, f64_bits_in_hex(F.hex(piece), 0))


def bits_to_f64(bits: Column | str) -> Column:
    """The double whose IEEE 754 bits are given. Pass a plain column: it is used several times."""
    bits = _col(bits)
    exponent = F.shiftrightunsigned(bits, 52).bitwiseAND(F.lit(0x7FF).cast("bigint"))
    fraction = bits.bitwiseAND(F.lit(_MANTISSA - 1).cast("bigint"))
    sign = F.when(bits < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    hidden = F.when(exponent > 0, F.lit(_MANTISSA).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    scale = F.pow(F.lit(2.0), (F.greatest(exponent, F.lit(1).cast("bigint")) - 1075).cast("double"))
    finite = (fraction + hidden).cast("double") * scale
    special = F.when(fraction == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    return sign * F.when(exponent == 0x7FF, special).otherwise(finite)


def f64_le(b: Column | str, off: Column | int = 0) -> Column:
    """Little-endian IEEE double at a byte offset."""
    return bits_to_f64(f64_bits(b, off))


def u32_bytes(x: Column | str) -> Column:
    """Unsigned 32-bit integer to 4 little-endian bytes."""
    digits = F.lpad(F.hex(_col(x).cast("bigint")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in (3, 2, 1, 0)]))


def with_f64_bytes(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add ``columns[source] -> name``: doubles as 8 little-endian bytes.

    One projection per step (exponent by logarithm, its correction, the bits), so that each step is computed once.
    """
    names = list(enumerate(columns.items()))
    tiny = F.pow(F.lit(2.0), F.lit(-1022.0))

    def finite(x: Column) -> Column:
        return (x != 0) & (F.abs(x) < float("inf"))

    def guess(x: Column) -> Column:
        size = F.when(finite(x), F.abs(x)).otherwise(F.lit(1.0))
        return F.greatest(F.floor(F.log2(size)).cast("double"), F.lit(-1022.0))

    def corrected(x: Column, power: Column) -> Column:
        # log2 may be off by one next to a power of two
        return (power + F.when(F.abs(x) >= F.pow(F.lit(2.0), power + 1), F.lit(1.0)).when(
            (F.abs(x) < F.pow(F.lit(2.0), power)) & (power > -1022), F.lit(-1.0)).otherwise(F.lit(0.0)))

    def bits(x: Column, power: Column) -> Column:
        size = F.abs(x)
        normal = (F.pow(F.lit(2.0), F.lit(52.0)) * (size * F.pow(F.lit(2.0), -power) - 1.0)).cast("bigint").bitwiseOR(
            F.shiftleft((power + 1023.0).cast("bigint"), 52))
        body = (F.when(F.isnan(x), F.lit(0x7FF8000000000000).cast("bigint"))
                .when(size == float("inf"), F.lit(0x7FF0000000000000).cast("bigint"))
                .when(size >= tiny, normal).otherwise((size * 2.0 ** 537 * 2.0 ** 537).cast("bigint")))
        sign = F.when(~F.isnan(x) & F.startswith(x.cast("string"), F.lit("-")), F.lit(-(1 << 63)).cast("bigint"))
        return F.when(x.isNotNull(), body.bitwiseOR(F.coalesce(sign, F.lit(0).cast("bigint"))))

    def swapped(digits: Column) -> Column:
        return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)]))

    step = df.select("*", *[guess(F.col(c)).alias(f"_e{i}") for i, (c, _) in names])
    step = step.select(*df.columns, *[corrected(F.col(c), F.col(f"_e{i}")).alias(f"_e{i}") for i, (c, _) in names])
    step = step.select(*df.columns, *[F.lpad(F.hex(bits(F.col(c), F.col(f"_e{i}"))), 16, "0").alias(f"_h{i}")
                                      for i, (c, _) in names])
    return computed_once(step, df.columns, [swapped(F.col(f"_h{i}")).alias(name) for i, (_, name) in names])
