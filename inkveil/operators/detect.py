"""Structured-identifier detectors: every type's matches of a text in one pass over the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions import identifiers as I
from inkveil.functions.spans import empty_spans, match_spans


def _is_id(value: Column) -> Column:
    return value.rlike("^(?:" + I.ID_NUMBER + ")$")


def _may_hold(text: Column, kind: str) -> Column:
    """A cheap necessary condition, so that most texts are passed over without the whole pattern."""
    if kind == "email":
        return text.contains("@")
    if kind == "case_number":
        return text.contains("（") | text.contains("(")
    return text.rlike("[0-9]")


def type_spans(text: Column, kind: str) -> Column:
    """Spans of one type, filtered by its shape and extended over a label just before it."""
    pattern, source, confidence = I.DETECTORS[kind]
    spans = F.when(_may_hold(text, kind), match_spans(text, pattern)).otherwise(empty_spans())
    if kind == "unified_social_credit_code":
        spans = F.filter(spans, lambda x: ~_is_id(x["value"]) & x["value"].rlike(I.CREDIT_CODE_SHAPE))
    if kind == "bank_account":
        digits = lambda x: F.regexp_replace(x["value"], r"\D", "")
        spans = F.filter(spans, lambda x: F.length(digits(x)).between(16, 24) & ~_is_id(digits(x)))
        trimmed = lambda x: F.rtrim(x["value"])
        spans = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(trimmed(x))).alias("end"), trimmed(x).alias("value")))

    def row(x: Column) -> Column:
        reach = F.least(x["start"], F.lit(I.LABEL_REACH))
        before = F.substring(text, x["start"] - reach + 1, reach)
        words = sorted(I.LABELS[kind], key=len, reverse=True)
        label = F.length(F.regexp_extract(before, "(" + "|".join(words) + ")$", 1)) if words else F.lit(0)
        start = x["start"] - label
        procedure = F.regexp_extract(x["value"], I.CASE_NUMBER, 1) if kind == "case_number" else F.lit(None).cast("string")
        return F.struct(
            F.lit(kind).alias("type"), F.substring(text, start + 1, x["end"] - start).alias("text"), start.alias("start"), x["end"].alias("end"),
            F.lit(source).alias("source"), F.lit(confidence).alias("confidence"), procedure.alias("procedure"), x["value"].alias("value"),
        )

    return F.transform(spans, row)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", types: tuple[str, ...] = tuple(I.DETECTORS)) -> DataFrame:
    """Candidates (id, ord, type, text, start, end, source, confidence, procedure, value, risk_level, auto_redact).

    ``ord`` is the detectors' order and then the place. Null texts give no rows.
    """
    text = F.col(text_col)
    every = F.concat(*(type_spans(text, t) for t in types))
    rows = docs.where(text.isNotNull()).select(F.col(id_col), F.posexplode(every).alias("ord", "c")).select(id_col, "ord", "c.*")
    return rows.withColumns({"risk_level": I.risk_for(F.col("type")), "auto_redact": F.lit(True)})


def allowed(candidates: DataFrame, profile: tuple[str, ...] | None) -> DataFrame:
    """Candidates of the types that a profile redacts; None redacts all."""
    return candidates if profile is None else candidates.where(F.col("type").isin(*profile))


PROFILES = {
    "minimal": ("person", "id_number", "phone"),
    "standard": ("person", "id_number", "phone", "location", "organization", "case_number"),
    "max": None,
}


def identifier_mappings(candidates: DataFrame, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """(id, ord, type, original, masked): the first candidate of each original, masked by *** or a swapped case number."""
    first = candidates.groupBy(id_col, F.col("text").alias("original")).agg(F.min(F.struct("ord", "type")).alias("f"))
    masked = F.when(F.col("f.type") == "case_number", I.map_case_number(F.col("original"), seed)).otherwise(F.lit("***"))
    return first.select(id_col, F.col("f.ord").alias("ord"), F.col("f.type").alias("type"), "original", masked.alias("masked"))


def scan_leaks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """High-risk identifiers still in a redacted text; masked-looking ones do not count."""
    found = detect(docs, id_col, text_col).where(F.col("type").isin(*I.HIGH_RISK))
    return found.where(~F.col("text").contains("某") & ~F.col("text").contains("***")).select(id_col, "type", "text", "start", "end", "source", "risk_level")
