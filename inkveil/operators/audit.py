"""Comparison of two candidate sets over the same texts, span by span."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CATEGORIES = ("agreed", "type_conflict", "boundary_conflict", "detector_only", "registry_only")


def audit(detected: DataFrame, registered: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, text, category) for every distinct span of either side.

    Equal spans agree or differ in type; of the rest, a span that overlaps one of the other side is a boundary conflict,
    and the others are on one side only. A span overlaps some other just when, of those that start before its end, one
    ends after its start: running maxima of both sides' ends in one pass over a document's spans, not a join of pairs.
    Equal values, nulls among them, are one span; a span without a place overlaps none.
    """
    spans = lambda rows, side: rows.select(id_col, "start", "end", "text", "type", F.lit(side).alias("__side"))
    kinds = lambda side: F.array_sort(F.collect_set(F.when(F.col("__side") == side, F.col("type"))))
    sides = [F.max(F.col("__side") == side) for side in (0, 1)]
    every = spans(detected, 0).unionByName(spans(registered, 1)).repartition(id_col)
    both = every.groupBy(id_col, "start", "end", "text").agg(*(kinds(s).alias(f"__kinds{s}") for s in (0, 1)), *(x.alias(f"__has{s}") for s, x in enumerate(sides)))
    known = F.when(F.col("__has0") & F.col("__has1"), F.when(F.col("__kinds0") == F.col("__kinds1"), "agreed").otherwise("type_conflict"))
    judged = both.select(id_col, "start", "end", "text", known.alias("category"), F.when(known.isNull(), F.col("__has0")).alias("__first"))
    # a span on one side only is met twice: where it starts, as what others may overlap, and where it ends, with what started before
    reach = lambda first: F.when(F.col("__first") == first, F.col("end"))
    mark = F.struct(F.col("start").alias("at"), reach(True).alias("reach0"), reach(False).alias("reach1"), F.lit(False).alias("own"))
    nothing = F.lit(None).cast(detected.schema["end"].dataType)
    own = F.struct(F.col("end").alias("at"), nothing.alias("reach0"), nothing.alias("reach1"), F.lit(True).alias("own"))
    marks = F.when(F.col("__first").isNotNull() & F.col("start").isNotNull() & F.col("end").isNotNull(), F.array(mark, own)).otherwise(F.array(own))
    before = Window.partitionBy(id_col).orderBy("__m.at").rangeBetween(Window.unboundedPreceding, -1)
    far = F.when(F.col("__first"), F.max("__m.reach1").over(before)).otherwise(F.max("__m.reach0").over(before))
    reached = judged.withColumn("__m", F.explode(marks)).withColumn("__far", far).where("__m.own")
    alone = F.when(F.col("__far") > F.col("start"), "boundary_conflict").when(F.col("__first"), "detector_only").otherwise("registry_only")
    return reached.select(id_col, "start", "end", "text", F.coalesce("category", alone).alias("category"))


def category_counts(audited: DataFrame) -> DataFrame:
    """(category, n) for all categories, zeros included."""
    every = audited.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return every.join(audited.groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))
