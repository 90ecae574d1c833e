"""Union, de-duplication and overlap resolution of span candidates.

Candidates have id, ord (their order), type, text, start, end, source, confidence, needs_review, metadata, provenance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.organizations import is_noisy_capture
from inkveil.functions.spans import contains_span, overlap

#: The higher, the better. Sources are matched exactly, then by prefix.
SOURCE_PRIORITY = {"hebei_admin_db": 95, "china_admin_db": 93, "full_document_llm": 90}
OTHER_SOURCE = 15
TYPE_PRIORITY = {"organization": 40, "project": 30, "location": 20, "grassroots_org": 20, "person": 10}
NOISY_PENALTY = 40
MOST_REVIEWED = 80


def collect(*generators: DataFrame) -> DataFrame:
    """The candidates of several generators, each one's ord after the former's."""
    numbered = [g.withColumns({"generator": F.lit(i)}) for i, g in enumerate(generators)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def deduplicate(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One candidate per (type, text, start): the most confident, the first of equals. Metadata are merged in order, a
    later key replacing an earlier one; provenance lists are united; one that needs review makes all need it."""
    best = F.max_by(F.struct("ord", "end", "source", "confidence"), F.struct("confidence", -F.col("ord")))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("ord", c.alias("v")))), lambda x: x["v"])
    entries = ordered(F.coalesce(F.map_entries("metadata"), F.array()))

    def later_wins(a: Column, e: Column) -> Column:
        m = F.map_from_entries(e)
        return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(m, k)), m)

    merged = F.aggregate(entries, F.create_map().cast("map<string,string>"), later_wins)
    grouped = candidates.groupBy(id_col, "type", "text", "start").agg(
        best.alias("b"), merged.alias("metadata"), F.array_distinct(F.flatten(ordered(F.coalesce("provenance", F.array())))).alias("provenance"), F.bool_or("needs_review").alias("needs_review")
    )
    return grouped.select(id_col, "b.ord", "type", "text", "start", "b.end", "b.source", "b.confidence", "needs_review", "metadata", "provenance")


def source_rank(source: Column) -> Column:
    out = F.lit(OTHER_SOURCE)
    for name, rank in reversed(SOURCE_PRIORITY.items()):
        out = F.when(source.startswith(name), rank).otherwise(out)
    return out


def type_rank(kind: Column) -> Column:
    out = F.lit(0)
    for name, rank in TYPE_PRIORITY.items():
        out = F.when(kind == name, rank).otherwise(out)
    return out


def quality(candidate: Column) -> Column:
    """What decides between overlapping candidates, best last in this order."""
    noisy = (candidate["type"] == "organization") & is_noisy_capture(candidate["text"])
    rank = source_rank(candidate["source"]) - F.when(noisy, NOISY_PENALTY).otherwise(0)
    return F.struct((-rank).alias("r"), (-type_rank(candidate["type"])).alias("t"), (-candidate["confidence"]).alias("c"), (candidate["start"] - candidate["end"]).alias("l"), candidate["ord"].alias("o"))


def _prefers(inner: Column, outer: Column) -> Column:
    """The two cases in which a nested candidate wins over the one around it."""
    nested = contains_span(outer, inner) & (inner["text"] != outer["text"]) & (inner["type"] == outer["type"])
    person = (inner["type"] == "person") & inner["source"].startswith("full_document_llm")
    organization = (inner["type"] == "organization") & outer["text"].endswith(inner["text"]) & is_noisy_capture(outer["text"])
    return nested & (person | organization)


def resolve(candidates: Column) -> Column:
    """From an array of a document's candidates, those that overlap no better one, in document order.

    The best come first; a candidate that a nested one is preferred to gives its place to it.
    """
    ranked = F.transform(F.array_sort(F.transform(candidates, lambda x: F.struct(quality(x).alias("q"), x.alias("c")))), lambda x: x["c"])

    def step(kept: Column, x: Column) -> Column:
        rivals = F.filter(kept, lambda y: overlap(x, y))
        decided = F.get(F.filter(rivals, lambda y: _prefers(x, y) | _prefers(y, x)), 0)
        swapped = F.transform(kept, lambda y: F.when(y == decided, x).otherwise(y))
        return F.when(F.size(rivals) == 0, F.array_append(kept, x)).when(decided.isNotNull() & _prefers(x, decided), swapped).otherwise(kept)

    accepted = F.aggregate(ranked, F.filter(candidates, lambda _: F.lit(False)), step)
    order = F.array_sort(F.transform(accepted, lambda x: F.struct(x["start"].alias("s"), (x["start"] - x["end"]).alias("l"), (-x["confidence"]).alias("c"), x["ord"].alias("o"), x.alias("x"))))
    return F.transform(order, lambda x: x["x"])


def resolve_overlaps(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """:func:`resolve` for every document; documents are independent groups of spans."""
    fields = [f for f in candidates.schema if f.name != id_col]
    maps = [f.name for f in fields if isinstance(f.dataType, T.MapType)]  # maps have no order: they travel as entries
    entries = candidates.withColumns({c: F.map_entries(c) for c in maps}) if maps else candidates
    grouped = entries.groupBy(id_col).agg(F.collect_list(F.struct(*(f.name for f in fields))).alias("all"))
    kept = grouped.select(id_col, F.posexplode(resolve(F.col("all"))).alias("rank", "c")).select(id_col, "rank", "c.*")
    return kept.withColumns({c: F.map_from_entries(c) for c in maps}) if maps else kept


def review_list(candidates: DataFrame, id_col: str = "doc_id", most: int = MOST_REVIEWED) -> DataFrame:
    """The first of each (type, text, start), the first ``most`` of a document."""
    first = Window.partitionBy(id_col, "type", "text", "start").orderBy("ord")
    kept = candidates.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    place = Window.partitionBy(id_col).orderBy("ord")
    return kept.withColumn("__n", F.row_number().over(place)).where(F.col("__n") <= most).drop("__n")
