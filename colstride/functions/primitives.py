"""Value semantics of lane-wise primitives: on columns for one lane per row, on arrays for registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import uint64 as U

#: Comparisons of values as they are: decimals, floating point, text.
PLAIN: dict[str, Callable[[Column, Column], Column]] = {
    "equal": lambda a, b: a == b,
    "not_equal": lambda a, b: a != b,
    "less": lambda a, b: a < b,
    "lessequal": lambda a, b: a <= b,
    "greater": lambda a, b: a > b,
    "greaterequal": lambda a, b: a >= b,
}
#: Comparisons of longs as the unsigned numbers whose patterns they are.
COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "equal": PLAIN["equal"],
    "not_equal": PLAIN["not_equal"],
    "less": U.bits_less,
    "lessequal": U.bits_less_equal,
    "greater": lambda a, b: U.bits_less(b, a),
    "greaterequal": lambda a, b: U.bits_less_equal(b, a),
}
#: The arithmetic of one lane: exact unsigned results, but for "min", which gives a pattern for patterns.
CALC: dict[str, Callable[[Column, Column], Column]] = {
    "add": U.add,
    "sub": U.sub,
    "mul": U.mul,
    "div": U.div,
    "mod": U.mod,
    "min": F.least,
}


def is_pattern(kind: T.DataType) -> bool:
    """Whether values of a type stand for 64-bit patterns."""
    return isinstance(kind, T.IntegralType)


def compare_bound(op: str, value: Column, bound: int) -> Column:
    """A column of patterns against an unsigned number, by plain comparisons that a scan can take over."""
    if not 0 <= bound < 1 << 64:
        raise ValueError(f"{bound} is no unsigned 64-bit number")
    top = bound >= 1 << 63  # then the bound's pattern is negative, like those of all larger numbers
    limit = F.lit(bound - (1 << 64) if top else bound)
    if op in ("equal", "not_equal"):
        return PLAIN[op](value, limit)
    inner = PLAIN[op](value, limit)
    if op in ("less", "lessequal"):
        return (value >= 0) | inner if top else (value >= 0) & inner
    return (value < 0) & inner if top else (value < 0) | inner


UNARY: dict[str, Callable[[Column], Column]] = {"inv": U.neg}
LOGIC: dict[str, Callable[[Column, Column], Column]] = {
    "bitwise_and": lambda a, b: a.bitwiseAND(b),
    "bitwise_or": lambda a, b: a.bitwiseOR(b),
}


def lanes(register: Column, other: Column, op: Callable[[Column, Column], Column]) -> Column:
    """An operation on each pair of lanes of two arrays of equal length."""
    return F.zip_with(register, other, op)


def hadd(register: Column) -> Column:
    """Sum of all lanes."""
    return F.aggregate(register, F.lit(0).cast("long"), lambda a, x: a + x)


def hor(register: Column) -> Column:
    """Bitwise or of all lanes."""
    return F.aggregate(register, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def count_matches(mask: Column) -> Column:
    """Set bits of a comparison mask."""
    return F.bit_count(mask).cast("long")


def mask_of(flags: Column) -> Column:
    """Comparison results of up to 64 lanes as one mask, lane 0 in the lowest bit."""
    bits = F.transform(flags, lambda f, i: F.when(f, U.shift_left(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return hor(bits)


def set1(value: Column, n: int) -> Column:
    return F.array_repeat(value, n)


def set_sequence(start: Column, step: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda i: start + i * step)


def extract_value(register: Column, lane: int) -> Column:
    return F.get(register, F.lit(lane))


def rotate(register: Column, by: int = 1) -> Column:
    """Every lane takes the value ``by`` lanes after it; the first ones come to the end."""
    n = F.size(register)
    return F.transform(register, lambda _, i: F.get(register, ((i + by) % n).cast("int")))


def compressstore(register: Column, mask: Column) -> Column:
    """The lanes whose bit is set in the mask, in order."""
    return F.filter(register, lambda _, i: U.shift_right(mask, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The scan that stands for vector loads."""
    return spark.read.parquet(path)
