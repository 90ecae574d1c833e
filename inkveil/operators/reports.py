"""Benchmark and regression reports as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.operators import privacy

STRATA = (("lt_10k", 0, 10_000), ("10k_30k", 10_000, 30_000), ("30k_60k", 30_000, 60_000), ("gte_60k", 60_000, None))
MOST_CHARACTERS = 120_000


def length_stratum(characters: Column) -> Column:
    out = F.lit(STRATA[-1][0])
    for name, _, end in reversed(STRATA[:-1]):
        out = F.when(characters < end, name).otherwise(out)
    return out


def strata_counts(docs: DataFrame, characters: Column) -> DataFrame:
    """(stratum, n) for all strata, zeros included."""
    every = docs.sparkSession.createDataFrame([(s[0],) for s in STRATA], "stratum string")
    counts = docs.groupBy(length_stratum(characters).alias("stratum")).count()
    return every.join(F.broadcast(counts), "stratum", "left").select("stratum", F.coalesce("count", F.lit(0)).cast("bigint").alias("n"))


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, input_id, character_count, length_stratum, sha256) of every input."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    size = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint")
    return docs.select(id_col, F.substring(digest, 1, 16).alias("input_id"), size.alias("character_count"), length_stratum(size).alias("length_stratum"), digest.alias("sha256"))


def oversized(docs: DataFrame, text_col: str = "text", most: int = MOST_CHARACTERS) -> DataFrame:
    """Documents that recognition refuses because of their length."""
    return docs.where(F.length(text_col) > most)


def label_counts(rows: DataFrame, labels: Column) -> DataFrame:
    """(label, n) over arrays of labels."""
    return rows.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def elapsed(start: Column, end: Column) -> dict[str, Column]:
    """Milliseconds between two timestamps, or null with a reason."""
    ms = (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000
    reason = F.when(start.isNull() | end.isNull(), "missing").when(end < start, "order")
    return {"ms": F.when(reason.isNull(), F.floor(ms)).cast("bigint"), "reason": reason}


def deltas(runs: DataFrame, baseline: str, id_col: str, measures: list[str]) -> DataFrame:
    """Each run's measures less the baseline run's; null where either is missing. The baseline is one row."""
    base = runs.where(F.col(id_col) == baseline).limit(1).select(*(F.col(m).alias(f"__{m}") for m in measures))
    return runs.where(F.col(id_col) != baseline).crossJoin(F.broadcast(base)).select(id_col, *((F.col(m) - F.col(f"__{m}")).alias(f"delta_{m}") for m in measures))


def recommendation(differences: DataFrame, id_col: str, cost: str, quality: list[str]) -> DataFrame:
    """One row: the run that costs less than the baseline by most and is nowhere worse, or that there is none."""
    worse = F.lit(False)
    for q in quality:
        worse = worse | F.coalesce(F.col(f"delta_{q}") < 0, F.lit(False))
    fine = differences.where(~worse & (F.col(f"delta_{cost}") < 0))
    best = fine.agg(F.min_by(id_col, F.struct(f"delta_{cost}", id_col)).alias("candidate"), F.min(f"delta_{cost}").alias("best_delta"))
    return best.select(F.when(F.col("candidate").isNull(), "keep_baseline").otherwise("switch").alias("decision"), "candidate", "best_delta")


def sum_category_counts(runs: DataFrame, counts: str) -> DataFrame:
    """(category, n): maps of counts summed by key, negative counts as zero."""
    return runs.select(F.explode(counts).alias("category", "v")).groupBy("category").agg(F.sum(F.greatest("v", F.lit(0))).alias("n"))


def run_statistics(stats: DataFrame) -> DataFrame:
    """One row over the runs of a batch: single values or ``mixed``, sums that are null without evidence."""
    one = lambda c: F.when(F.countDistinct(c) == 1, F.max(c)).when(F.countDistinct(c) > 1, "mixed").alias(c)
    return stats.agg(one("mode"), one("model_id"), one("status"), F.count("*").alias("document_count"), *(F.sum(c).alias(c) for c in ("call_count", "duration_ms", "total_token_count")))


#: Every key that one of the validators of :mod:`inkveil.operators.privacy` bars, and those that name texts and places.
FORBIDDEN_KEYS = tuple(sorted({*privacy.RUNTIME_KEYS, *privacy.RECOGNITION_KEYS, *privacy.REMOTE_KEYS, "text", "path", "source_file"}))


def unsafe_keys(reports: DataFrame, id_col: str, report: str, forbidden: tuple[str, ...] = FORBIDDEN_KEYS) -> DataFrame:
    """(id, key): keys of JSON reports, at any depth and in any case, that could carry personal text."""
    keys = reports.select(id_col, F.inline(privacy.walk_json(F.col(report)))).select(id_col, "key")
    return keys.where(F.lower("key").isin(*forbidden)).distinct()


def stable_hash(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, hash): SHA-256 over a group's rows as JSON lines in a fixed order of rows and columns."""
    fields = sorted(c for c in rows.columns if c not in keys)
    line = F.to_json(F.struct(*fields))
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), line.alias("line")))), lambda x: x["line"])
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("hash"))


def context_mismatches(runs: DataFrame, baseline: str, id_col: str, fields: list[str]) -> DataFrame:
    """(id, fields): what of a run's context differs from the baseline's; equal runs are left out."""
    base = runs.where(F.col(id_col) == baseline).limit(1).select(*(F.col(f).alias(f"__{f}") for f in fields))
    differs = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), f) for f in fields)))
    return runs.where(F.col(id_col) != baseline).crossJoin(F.broadcast(base)).select(id_col, differs.alias("fields")).where(F.size("fields") > 0)


def missing_evidence(runs: DataFrame, required: list[str]) -> DataFrame:
    """One row: the required measures that some run lacks, in their order."""
    lacking = [F.when(F.count_if(F.col(c).isNull()) > 0, c) for c in required]
    return runs.agg(F.array_compact(F.array(*lacking)).alias("missing"))


def unsafe_values(reports: DataFrame, id_col: str, report: str) -> DataFrame:
    """(id, issue): strings of JSON reports, at any place, that hold Chinese text or an absolute path."""
    strings = reports.select(id_col, F.inline(privacy.walk_json(F.col(report)))).where("kind = 'string'")
    issues = F.array_compact(F.array(F.when(F.col("text").rlike(privacy.CHINESE_TEXT), "chinese_text"), F.when(F.col("text").rlike(privacy.ABSOLUTE_PATH), "absolute_path")))
    return strings.select(id_col, F.explode(issues).alias("issue")).distinct()
