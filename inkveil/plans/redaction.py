"""End-to-end plans: documents to redacted documents, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.functions import identifiers as I
from inkveil.operators.detect import type_spans
from inkveil.operators.replace import with_replaced


def redact_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: tuple[str, ...] = tuple(I.DETECTORS), seed: int = 0) -> DataFrame:
    """(id, redacted, mappings, leaks): a projection of each document, without a shuffle, for batches and streams alike.

    Identifiers are found, the first of each original is mapped, originals are replaced longest first, signature lines
    are dropped, and high-risk identifiers that are still there are listed.
    """
    text = F.col(text_col)
    masked = lambda x: F.when(x["type"] == "case_number", I.map_case_number(x["text"], seed)).otherwise(F.lit("***"))
    found = docs.where(text.isNotNull()).select(id_col, text_col, F.concat(*(type_spans(text, t) for t in types)).alias("__found"))
    numbered = found.withColumn("__all", F.transform("__found", lambda x, i: F.struct(i.alias("ord"), x["type"].alias("type"), x["text"].alias("original"), masked(x).alias("masked"))))
    firsts = lambda originals: F.filter("__all", lambda x, i: (F.array_position(originals, x["original"]) == i + 1) & (x["original"] != x["masked"]))
    mapped = numbered.withColumn("mappings", F.get(F.transform(F.array(F.transform("__all", lambda x: x["original"])), firsts), 0))
    redacted = with_replaced(mapped, text_col, "mappings", "__replaced").withColumn("redacted", I.strip_court_signatures(F.col("__replaced")))
    again = F.concat(*(type_spans(F.col("redacted"), t) for t in I.DETECTORS if t in I.HIGH_RISK))
    leaks = F.filter(again, lambda x: ~x["text"].contains("某") & ~x["text"].contains("***"))
    return redacted.select(id_col, "redacted", "mappings", F.transform(leaks, lambda x: F.struct(x["type"].alias("type"), x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"))).alias("leaks"))
