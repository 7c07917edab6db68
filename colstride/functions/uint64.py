"""Unsigned 64-bit semantics on Spark columns.

Two carriers: ``DecimalType(20, 0)`` holds the value itself and wraps by a remainder; ``LongType`` holds
the 64-bit pattern, which is the value below 2 ** 63. Everything stays inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2 ** 64 and 2 ** 32 as decimal literals, and the sign bit of a long.
TWO64, TWO32, SIGN = "18446744073709551616", "4294967296", -(1 << 63)
UINT64 = "decimal(20,0)"


def _two64() -> Column:
    return F.lit(TWO64).cast("decimal(21,0)")


def wrap(value: Column) -> Column:
    """A whole decimal modulo 2 ** 64, also for negative ones."""
    return F.pmod(value, _two64()).cast(UINT64)


def u64(value: Column) -> Column:
    """A non-negative whole number as an exact unsigned value."""
    return value.cast(UINT64)


def add(a: Column, b: Column) -> Column:
    return wrap(u64(a) + u64(b))


def sub(a: Column, b: Column) -> Column:
    return wrap(u64(a) - u64(b))


def neg(a: Column) -> Column:
    """Two's complement: 2 ** 64 - a, and 0 for 0."""
    return wrap(F.lit(0).cast(UINT64) - u64(a))


def mul(a: Column, b: Column) -> Column:
    """Product modulo 2 ** 64. The product of full-range values passes 38 digits, so the upper half of
    ``a`` is multiplied apart and only its low 32 bits count."""
    x, y = u64(a), u64(b)
    two32 = F.lit(TWO32).cast("decimal(11,0)")
    low, high = F.pmod(x, two32), F.floor(x / two32)
    upper = F.pmod(high.cast("decimal(10,0)") * F.pmod(y, two32).cast("decimal(10,0)"), two32)
    lower = low.cast("decimal(10,0)") * y
    return wrap(upper.cast("decimal(10,0)") * two32 + F.pmod(lower, _two64()).cast(UINT64))


def div(a: Column, b: Column) -> Column:
    """Quotient rounded down; the divisor 0 raises."""
    return F.floor((u64(a) - F.pmod(u64(a), u64(b))) / u64(b)).cast(UINT64)


def mod(a: Column, b: Column) -> Column:
    return F.pmod(u64(a), u64(b)).cast(UINT64)


def to_bits(value: Column) -> Column:
    """Exact unsigned value -> 64-bit pattern."""
    v = value.cast(UINT64)
    return F.when(v >= F.lit("9223372036854775808").cast(UINT64), v - _two64()).otherwise(v).cast("long")


def from_bits(bits: Column) -> Column:
    """64-bit pattern -> exact unsigned value."""
    v = bits.cast("decimal(21,0)")
    return F.when(bits < 0, v + _two64()).otherwise(v).cast(UINT64)


def bits_less(a: Column, b: Column) -> Column:
    """Unsigned < on patterns: flip the sign bit and compare."""
    return a.bitwiseXOR(F.lit(SIGN)) < b.bitwiseXOR(F.lit(SIGN))


def bits_less_equal(a: Column, b: Column) -> Column:
    return ~bits_less(b, a)


def bitwidth(value: Column) -> Column:
    """Bits that a value needs, as a long; 0 needs 1. Takes longs as patterns."""
    return F.char_length(F.bin(value)).cast("long")


def bytewidth(value: Column) -> Column:
    """Bytes that a value needs; 0 needs 1."""
    return F.floor((bitwidth(value) + 7) / 8).cast("long")


def zero_bytes(value: Column) -> Column:
    """Leading zero bytes of the 8; 0 has 7, since one byte is always kept."""
    return 8 - bytewidth(value)


def bitwidth_min(width: int) -> int:
    """Smallest value that needs so many bits."""
    return 0 if width <= 1 else 1 << (width - 1)


def bitwidth_max(width: int) -> int:
    """Largest value of so many bits."""
    return (1 << width) - 1


def round_up_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up_to_multiple(a: int, b: int) -> int:
    return -(-a // b) * b


def round_down_to_multiple(a: int, b: int) -> int:
    return a // b * b


def shift_left(value: Column, distance: Column) -> Column:
    """Shift of a pattern; distances from 64 on leave nothing (Spark's own shift takes them modulo 64)."""
    return F.when(distance >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", value.cast("long"), distance.cast("int")))


def shift_right(value: Column, distance: Column) -> Column:
    return F.when(distance >= 64, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", value.cast("long"), distance.cast("int")))


def count_leading_zero(value: Column) -> Column:
    """Leading zero bits of a 64-bit pattern; 64 for 0."""
    return F.when(value == 0, F.lit(64).cast("long")).otherwise(64 - bitwidth(value))


def sum_wrapped(value: Column) -> Column:
    """Aggregate: sum modulo 2 ** 64; 0 over no rows."""
    return F.coalesce(wrap(F.sum(u64(value))), F.lit(0).cast(UINT64))


#: Bits of the parts in which patterns are summed: sums of up to 2 ** 40 rows fit a long.
LIMB, _LIMBS = 22, ("_low", "_middle", "_high")


def limb_sums(bits: Column) -> list[Column]:
    """Aggregates: the sums of the low, middle and high bits of patterns, each a plain sum of longs."""
    mask = F.lit((1 << LIMB) - 1)
    v = bits.cast("long")
    parts = (v.bitwiseAND(mask), F.shiftrightunsigned(v, LIMB).bitwiseAND(mask), F.shiftrightunsigned(v, 2 * LIMB))
    return [F.coalesce(F.sum(p), F.lit(0)).alias(name) for p, name in zip(parts, _LIMBS, strict=True)]


def of_limbs() -> Column:
    """The pattern of the sum whose parts ``limb_sums`` gave, modulo 2 ** 64."""
    total = sum((F.col(name).cast("decimal(19,0)") * F.lit(str(1 << k * LIMB)).cast("decimal(19,0)") for k, name in enumerate(_LIMBS[1:], 1)), F.col(_LIMBS[0]).cast("decimal(38,0)"))
    return to_bits(wrap(total))


def least(a: Column, b: Column) -> Column:
    """The smaller of two patterns as unsigned numbers."""
    return F.when(bits_less(b, a), b).otherwise(a)


def ordered(bits: Column) -> Column:
    """Patterns as longs that compare as the unsigned numbers do; its own inverse."""
    return bits.bitwiseXOR(F.lit(SIGN))
