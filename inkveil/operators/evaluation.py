"""Quality against gold annotations: matches, counts by type, identity errors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.metrics import precision_recall_f1

KEYS = ("original", "type", "masked")


def match_entities(expected: DataFrame, actual: DataFrame, case_col: str = "case_id") -> DataFrame:
    """(case, type, outcome): tp, fp or fn for every distinct expected and actual entity, matched one to one.

    Equal entities are numbered on both sides and joined on the number, which is a bag match without pairs.
    """

    def numbered(rows: DataFrame) -> DataFrame:
        distinct = rows.select(case_col, *KEYS).distinct()
        return distinct.withColumn("nth", F.row_number().over(Window.partitionBy(case_col, *KEYS).orderBy(F.lit(1))))

    e, a = numbered(expected).withColumn("e", F.lit(True)), numbered(actual).withColumn("a", F.lit(True))
    on = [e[case_col] == a[case_col], e["nth"] == a["nth"], *(e[k].eqNullSafe(a[k]) for k in KEYS)]
    joined = e.join(a, on, "full")
    outcome = F.when(F.col("e") & F.col("a"), "tp").when(F.col("e"), "fn").otherwise("fp")
    return joined.select(F.coalesce(e[case_col], a[case_col]).alias(case_col), F.coalesce(e["type"], a["type"], F.lit("unknown")).alias("type"), outcome.alias("outcome"))


def metrics_by_type(outcomes: DataFrame) -> DataFrame:
    """(type, tp, fp, fn, precision, recall, f1) for each type, and with a null type over all."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    totals = outcomes.groupingSets([["type"], []], "type").agg(count("tp"), count("fp"), count("fn"))
    return totals.select("type", "tp", "fp", "fn", *(c.alias(n) for n, c in precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")).items()))


def wrong_splits(entities: DataFrame, case_col: str = "case_id") -> DataFrame:
    """(case, group): alias groups that were given more than one mask."""
    groups = entities.where("alias_group IS NOT NULL").groupBy(case_col, "alias_group").agg(F.countDistinct("masked").alias("n"))
    return groups.where("n > 1").select(case_col, "alias_group")


def wrong_merges(entities: DataFrame, case_col: str = "case_id") -> DataFrame:
    """(case, left, right): pairs that must not be merged and share a mask. Entities have entity_id, do_not_merge, masked."""
    blocked = entities.select(case_col, F.col("entity_id").alias("one"), F.explode("do_not_merge").alias("other"), "masked")
    right = entities.select(case_col, F.col("entity_id").alias("other"), "masked")
    pairs = blocked.join(right, [case_col, "other", "masked"]).where("one <> other")
    return pairs.select(case_col, F.least("one", "other").alias("left_id"), F.greatest("one", "other").alias("right_id")).distinct()


def case_report(outcomes: DataFrame, case_col: str = "case_id") -> DataFrame:
    """Counts and metrics of each case."""
    count = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    totals = outcomes.groupBy(case_col).agg(count("tp"), count("fp"), count("fn"))
    return totals.select(case_col, "tp", "fp", "fn", *(c.alias(n) for n, c in precision_recall_f1(F.col("tp"), F.col("fp"), F.col("fn")).items()))
