"""Places of pattern matches and scans over arrays, in column expressions whose work is (nearly) linear in a text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTEXT = 40  # characters on either side of a match


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


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches as (start, end, value, before, after), in code points from 0, the end exclusive.

    The text between matches gives the places (a running sum) and the context; ``value`` is the whole match or a group.
    Patterns must not match the empty text. Without a match the text is searched once.
    """
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

    def with_places(gaps: Column, m: Column, v: Column) -> Column:
        lengths = F.transform(m, lambda x, i: F.length(F.get(gaps, i)) + F.length(x))
        ends = scan(lengths, lambda a, b: a + b, F.lit(0))
        return let(
            ends,
            lambda e: F.transform(
                m,
                lambda x, i: F.struct(
                    (F.get(e, i) - F.length(x)).alias("start"), F.get(e, i).alias("end"), F.get(v, i).alias("value"),
                    F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after"),
                ),
            ),
        )

    inner = lambda gaps: let(found, lambda m: with_places(gaps, m, m) if values is None else let(values, lambda v: with_places(gaps, m, v)))
    return F.when(text.rlike(pattern), let(F.split(text, pattern, -1), inner)).otherwise(F.array()).cast(kind)
