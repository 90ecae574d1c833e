"""Places of matches in texts, in code points from 0, by JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions.scans import let, running_sum

FEW = 512
SPAN = "struct<start:int,end:int,value:string>"


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def match_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, value): the pieces between matches give the places."""
    found, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    steps = F.zip_with(F.transform(between, lambda x: F.length(x)), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
    begin = F.struct(F.lit(0).alias("at"), empty_spans().alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("value")).cast(SPAN)
        return F.when(x["m"].isNull(), a).otherwise(F.struct(end.alias("at"), F.array_append(a["out"], span).alias("out")))

    return F.when(text.rlike(pattern), F.aggregate(steps, begin, step, lambda a: a["out"])).otherwise(empty_spans())


def quoted(term: Column) -> Column:
    """A regular expression for exactly ``term``."""
    return F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _sums(values: Column) -> Column:
    """Running sums: appending copies the sums before it, so that of many values they are taken by doubling."""
    appended = F.aggregate(values, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n), lambda a: F.slice(a, 2, F.size(a)))
    return F.when(F.size(values) <= FEW, appended).otherwise(running_sum(values))


def occurrences(text: Column, term: Column, overlapping: bool = True) -> Column:
    """Starts of a term's occurrences, overlapping ones included or not. An empty or null term has none."""
    pattern = F.concat(F.lit("(?="), quoted(term), F.lit(")")) if overlapping else quoted(term)
    gap = F.lit(0) if overlapping else F.length(term)
    pieces = F.transform(F.split(text, pattern, -1), lambda x, i: F.length(x) + F.when(i > 0, gap).otherwise(0))
    starts = let(let(pieces, lambda p: F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0)))), _sums)
    if overlapping:  # a zero-width match at the very beginning makes no piece
        starts = F.when(text.startswith(term), F.concat(F.array(F.lit(0)), starts)).otherwise(starts)
    return F.when(text.contains(term) & (term != ""), starts).otherwise(F.array().cast("array<int>"))


def overlap(left: Column, right: Column) -> Column:
    """Half-open spans with a common place."""
    return (left["start"] < right["end"]) & (right["start"] < left["end"])


def contains_span(outer: Column, inner: Column) -> Column:
    return (outer["start"] <= inner["start"]) & (inner["end"] <= outer["end"])


def count_occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term that is not empty."""
    return F.when(term == "", 0).otherwise(((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint"))
