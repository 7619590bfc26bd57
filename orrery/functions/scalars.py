"""Integer helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fibonacci(k: Column, n: Column | None = None, n_front: Column | None = None) -> Column:
    """The k-th Fibonacci number (1, 1, 2, ...; 1 below), or n + n_front if both are given and not zero."""
    steps = F.sequence(F.lit(1), F.greatest(k.cast("int") - 2, F.lit(1)))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    walked = F.aggregate(steps, start, lambda s, _: F.struct(s["b"].alias("a"), (s["a"] + s["b"]).alias("b")), lambda s: s["b"])
    kth = F.when(k <= 2, F.lit(1).cast("long")).otherwise(walked)
    if n is None or n_front is None:
        return kth
    return F.when((n != 0) & (n_front != 0), (n + n_front).cast("long")).otherwise(kth)


def fibonacci_sum(n: Column) -> Column:
    """The sum of the first n Fibonacci numbers, which is the one two further on less 1; 2 for n under 1."""
    return F.when(n < 1, F.lit(2).cast("long")).otherwise(fibonacci(n + 2) - 1)


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is at least n, as an unsigned 32-bit number: 1 for 0, 0 beyond 2^31."""
    power = F.expr("1L").bitwiseOR(F.lit(0).cast("long"))
    width = F.length(F.bin(n.cast("long") - 1))
    up = F.call_function("shiftleft", power, width)
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(up.bitwiseAND(F.lit(0xFFFFFFFF)))


def to_binary_string(n: Column, width: Column) -> Column:
    """Base 2 with zeros on the left to a width; longer numbers keep their digits."""
    digits = F.when(n == 0, F.lit("")).otherwise(F.bin(n.cast("long")))
    return F.concat(F.repeat(F.lit("0"), F.greatest(width.cast("int") - F.length(digits), F.lit(0))), digits)


def to_unsigned(s: Column) -> Column:
    """The number that the leftmost 32 binary digits write; anything but digits 0 and 1 is an error."""
    ok = s.rlike("^[01]*$")
    value = F.conv(F.concat(F.lit("0"), F.substring(s, 1, 32)), 2, 10).cast("long")
    return F.when(ok, value).when(s.isNull(), F.lit(None).cast("long")).otherwise(F.raise_error(F.lit("not a binary number")).cast("long"))
