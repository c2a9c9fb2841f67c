"""Small column helpers used by every module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``.

    Without this an expression that is used inside a lambda is evaluated once per array element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def r6(c: Column | str) -> Column:
    """Round to 6 digits and turn -0.0 into 0.0 (for comparable reports)."""
    return F.round(col(c).cast("double"), 6) + F.lit(0.0)


def r9(c: Column | str) -> Column:
    """As :func:`r6` with 9 digits, for inputs whose own digits would fall on a rounding edge."""
    return F.round(col(c).cast("double"), 9) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return col(c).cast("bigint")


def ratio(num: Column, den: Column) -> Column:
    """Division that gives null for a zero or missing denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def asum(a: Column) -> Column:
    """Sum of an array of doubles; 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def amean(a: Column) -> Column:
    return ratio(asum(a), F.size(a))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0), F.greatest(n, F.lit(0)).cast("int"))


def pick(a: Column, i: Column) -> Column:
    """Zero-based element, null outside the array."""
    return F.try_element_at(a, (i + 1).cast("int"))


def positions_of(a: Column) -> Column:
    """0 .. size-1; an empty array for an empty input (``sequence`` would count down)."""
    return F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))


def hash_order(key: Column | str, seed: int) -> Column:
    """Deterministic pseudo-random order value: the md5 text of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def hash_share(key: Column | str, seed: int, digits: int = 8) -> Column:
    """Uniform double in [0, 1) drawn from the hash of seed and key."""
    return hash_int(key, seed, digits) / F.lit(float(16**digits))


def hash_int(key: Column | str, seed: int, digits: int = 8) -> Column:
    return F.conv(F.substring(hash_order(key, seed), 1, digits), 16, 10).cast("bigint")


#: elements of an array that are folded at once
FOLDED = 64


def parted(a: Column, size: int = FOLDED) -> Column:
    """An array cut into arrays of ``size`` elements."""
    n = F.ceil(F.size(a) / size).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda k: F.slice(a, k * size + 1, F.lit(size)))


def scan(a: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """The states of a fold after each element. Every step copies the states so far: for short arrays, longer ones go
    through :func:`parted` first."""
    folded = F.aggregate(
        a,
        F.struct(start.alias("s"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda acc, x: let(step(acc["s"], x), lambda v: F.struct(v.alias("s"), F.concat(acc["out"], F.array(v)).alias("out"))),
    )
    return folded["out"]


def prefix_sums(counts: Column) -> Column:
    """Sums of whole numbers up to and with each element: within parts, and over the totals of the parts."""

    def add(s: Column, x: Column) -> Column:
        return s + x

    def join(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), add))
        before = F.concat(F.array(F.lit(0)), scan(totals, F.lit(0), add, "int"))
        return F.flatten(F.zip_with(parts, F.slice(before, 1, F.size(parts)), lambda p, b: scan(p, b, add, "int")))

    return let(let(counts, lambda a: parted(a)), join)
