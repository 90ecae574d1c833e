"""Running values over arrays, and binary search in them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def scan(values: Column, combine: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Running ``combine`` (associative, with neutral ``zero``) of an array, by doubling steps: log2(n) passes over it."""

    def steps(v: Column) -> Column:
        levels = F.sequence(F.lit(0), F.length(F.bin(F.size(v) - 1)) - 1)
        one = lambda a, k: F.transform(a, lambda x, i: combine(x, F.coalesce(F.get(a, i - F.pow(F.lit(2), k).cast("int")), zero)))
        return F.when(F.size(v) <= 1, v).otherwise(F.aggregate(levels, v, one))

    return let(values, steps)


def running_sum(values: Column) -> Column:
    return scan(values, lambda a, b: a + b, F.lit(0))


def count_until(ordered: Column, value: Column) -> Column:
    """How many entries of an ascending array are not greater than ``value``, by binary search."""
    bits = F.length(F.bin(F.size(ordered)))

    def step(n: Column, k: Column) -> Column:
        ahead = n + F.pow(F.lit(2), bits - k).cast("int")
        return F.when(F.get(ordered, ahead - 1) <= value, ahead).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), bits), F.lit(0), step)
