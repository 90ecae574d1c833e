"""Where every place of a text lies in its redacted form, and back; previews of a restore; traces of a run.

The coordinate map of a text lists its replaced stretches in order, with their ends on both sides. It comes from the same
marks that make the redacted text, by running sums, and a place is carried across by binary search.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.pieces import each_row
from inkveil.functions.scans import count_until, let, running_sum
from inkveil.operators.replace import CLOSE, DIGITS, JVM_ENTRIES, OPEN, _unescaped, mapping_rows, replaced_places, replace_marks, restore, restore_lookup, with_entries
from inkveil.operators.replace import trace_positions as occurrences_of

COORDINATES = "array<struct<start:int,end:int,new_start:int,new_end:int>>"
DIFF_CONTEXT = 3


def _from_marks(text: Column, entries: Column, key: str, value: str) -> Column:
    marked, ordered = replace_marks(text, entries, key, "o")

    def stretches(parts: Column, known: Column) -> Column:
        """Of each mark: what stands before it, and the lengths of what it replaces and of what replaces that."""
        inner = lambda p: _unescaped(F.substring(p, F.instr(p, CLOSE) + 1, F.length(p)))
        entry = lambda p: F.get(known, F.translate(F.substring_index(p, CLOSE, 1), DIGITS, "0123456789").cast("int"))["m"]
        gaps = F.transform(parts, lambda p, i: F.length(F.when(i == 0, _unescaped(p)).otherwise(inner(p))))
        sizes = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(F.length(entry(p)[key]).alias("old"), F.length(F.coalesce(entry(p)[value], F.lit(""))).alias("new")))
        side = lambda g, s, c: running_sum(F.transform(s, lambda x, i: F.get(g, i) + x[c]))
        row = lambda s, a, b: F.transform(s, lambda x, i: F.struct((F.get(a, i) - x["old"]).alias("start"), F.get(a, i).alias("end"), (F.get(b, i) - x["new"]).alias("new_start"), F.get(b, i).alias("new_end")))
        return let(gaps, lambda g: let(sizes, lambda s: let(side(g, s, "old"), lambda a: let(side(g, s, "new"), lambda b: row(s, a, b)))))

    return F.when(text.isNotNull(), let(F.split(marked, OPEN), lambda parts: let(ordered, lambda known: stretches(parts, known))).cast(COORDINATES))


def _listed(places: list[list[tuple[int, int, str]] | None]) -> pa.Array:
    out = []
    for found in places:
        shift, row = 0, []
        for start, end, value in found or ():
            row.append({"start": start, "end": end, "new_start": start + shift, "new_end": start + shift + len(value)})
            shift += len(value) - (end - start)
        out.append(None if found is None else row)
    return pa.array(out, pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "end", "new_start", "new_end")])))


def with_coordinates(docs: DataFrame, mappings: DataFrame, text_col: str = "text", on: str | None = None, guard: bool = True, out: str = "coordinates") -> DataFrame:
    """``docs`` with the coordinate map of what :func:`inkveil.operators.replace.apply_mappings` does to the text.

    A null text has none, one without replacements an empty one. Mappings are those of ``apply_mappings``.
    """
    slim, rows = mapping_rows(mappings, on, guard, "original", "masked")
    if on:
        joined = with_entries(docs, slim, on)
        if not guard:
            return joined.withColumn(out, _from_marks(F.col(text_col), F.col("__entries"), "k", "v")).drop("__entries")

        @F.arrow_udf(COORDINATES)
        def by_row(texts: pa.Array, lists: pa.Array) -> pa.Array:
            return _listed([replaced_places(t, own or ()) for t, own in zip(texts.to_pylist(), lists.to_pylist(), strict=True)])

        return joined.withColumn(out, by_row(F.col(text_col), F.col("__entries"))).drop("__entries")
    if len(rows) <= JVM_ENTRIES and not any(r["g"] for r in rows):
        return with_entries(docs, slim).withColumn(out, _from_marks(F.col(text_col), F.col("__entries"), "k", "v")).drop("__entries")

    @F.arrow_udf(COORDINATES)
    def shared(texts: pa.Array) -> pa.Array:
        return _listed([replaced_places(t, rows, shared=True) for t in texts.to_pylist()])

    return docs.withColumn(out, shared(F.col(text_col)))


def _carried(coordinates: Column, place: Column, begin: bool, old: str, new: str) -> Column:
    """A place of one side on the other. Inside a replaced stretch, a beginning goes to its start and an end to its end."""
    n = count_until(F.transform(coordinates, lambda x: x[f"{old}end"]), place)
    before = F.get(coordinates, n - 1)
    here = F.get(coordinates, n)
    inside = here[f"{old}start"] < place
    plain = F.when(n == 0, place).otherwise(before[f"{new}end"] + place - before[f"{old}end"])
    return F.when(inside, here[f"{new}start"] if begin else here[f"{new}end"]).otherwise(plain)


def to_redacted(coordinates: Column, span: Column) -> Column:
    """A span (start, end) of the text as one of the redacted text."""
    return F.struct(_carried(coordinates, span["start"], True, "", "new_").alias("start"), _carried(coordinates, span["end"], False, "", "new_").alias("end"))


def to_original(coordinates: Column, span: Column) -> Column:
    """A span of the redacted text as one of the text."""
    return F.struct(_carried(coordinates, span["start"], True, "new_", "").alias("start"), _carried(coordinates, span["end"], False, "new_", "").alias("end"))


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _carried_rows(coordinates: np.ndarray, places: np.ndarray, begin: bool, old: int) -> np.ndarray:
    """:func:`_carried` of many places of one text; the four rows of ``coordinates`` are its columns, ``old`` is the first of
    the side that the places are on."""
    new, size = 2 - old, coordinates.shape[1]
    n = np.searchsorted(coordinates[old + 1], places, side="right")
    before, here = np.maximum(n - 1, 0), np.minimum(n, size - 1)
    plain = np.where(n == 0, places, coordinates[new + 1][before] + places - coordinates[old + 1][before])
    inside = (n < size) & (coordinates[old][here] < places)
    return np.where(inside, coordinates[new if begin else new + 1][here], plain)


def _all_carried(coordinates: Column, spans: Column, old: int) -> Column:
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(maps: pa.Array, lists: pa.Array) -> pa.Array:
        table = np.stack([maps.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "new_start", "new_end")])
        ends = [lists.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end")]
        at, own = maps.offsets.to_numpy(), lists.offsets.to_numpy()
        out = [np.array(x, np.int64) for x in ends]
        for i in range(len(maps)):
            if at[i] < at[i + 1]:
                for begin, place, to in zip((True, False), ends, out, strict=True):
                    to[own[i] : own[i + 1]] = _carried_rows(table[:, at[i] : at[i + 1]], place[own[i] : own[i + 1]], begin, old)
        known = np.asarray(maps.is_valid()) & np.asarray(lists.is_valid())
        flat = pa.StructArray.from_arrays([pa.array(x[own[0] : own[-1]], pa.int32()) for x in out], fields=list(SPANS.value_type))
        return pa.ListArray.from_arrays(pa.array(own - own[0], pa.int32()), flat, type=SPANS, mask=pa.array(~known))

    return run(coordinates, spans)


def all_to_redacted(coordinates: Column, spans: Column) -> Column:
    """:func:`to_redacted` of an array of spans, none of them null, by one search for all of a text's places."""
    return _all_carried(coordinates, spans, 0)


def all_to_original(coordinates: Column, spans: Column) -> Column:
    """:func:`to_original` of an array of spans."""
    return _all_carried(coordinates, spans, 2)


def line_spans(text: Column) -> Column:
    """(start, end) of every line of a text, without its line feed."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.length(x))
    return let(lines, lambda n: let(running_sum(F.transform(n, lambda x: x + 1)), lambda e: F.transform(n, lambda x, i: F.struct((F.get(e, i) - 1 - x).alias("start"), (F.get(e, i) - 1).alias("end")))))


def _hunks(old: list[str], new: list[str]) -> list[str]:
    """Unified diff of texts of as many lines each, line by line; others go through the general algorithm."""
    if len(old) != len(new):
        return list(difflib.unified_diff(old, new, fromfile="redacted", tofile="restored", lineterm=""))
    changed = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
    blocks: list[list[int]] = []
    for i in changed:
        if blocks and i - blocks[-1][1] <= 2 * DIFF_CONTEXT + 1:
            blocks[-1][1] = i
        else:
            blocks.append([i, i])
    out = ["--- redacted", "+++ restored"] if blocks else []
    for first, last in blocks:
        lo, hi = max(first - DIFF_CONTEXT, 0), min(last + DIFF_CONTEXT + 1, len(old))
        where = f"{lo + 1}" if hi - lo == 1 else f"{lo + 1},{hi - lo}"
        out.append(f"@@ -{where} +{where} @@")
        i = lo
        while i < hi:
            j = i
            while j < hi and old[j] != new[j]:
                j += 1
            out += ["-" + x for x in old[i:j]] + ["+" + x for x in new[i:j]]
            if j < hi:
                out.append(" " + old[j])
            i = j + 1
    return out


@F.arrow_udf(T.StringType())
def unified_diff(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Unified diff of two texts with three lines of context; empty for equal ones, null if one is null."""
    yield from each_row(batches, lambda a, b: None if a is None or b is None else "\n".join(_hunks(a.splitlines(), b.splitlines())), pa.string())


def preview_restore(docs: DataFrame, mappings: DataFrame, text_col: str = "redacted", on: str | None = None) -> DataFrame:
    """``docs`` with restored, diff and n_restored_entries. Restoring always takes all entries: none is ever skipped, so the
    number of skipped ones, which a preview also shows, is 0."""
    entries = mappings.groupBy(on).agg(F.count("*").alias("n_restored_entries")) if on else None
    done = restore(docs, mappings, text_col, on, "restored").withColumn("diff", unified_diff(F.col(text_col), F.col("restored")))
    if on:
        counted = done.join(entries, on, "left").withColumn("n_restored_entries", F.coalesce("n_restored_entries", F.lit(0).cast("bigint")))
    else:
        counted = done.crossJoin(F.broadcast(mappings.agg(F.count("*").alias("n_restored_entries"))))
    return counted.withColumn("n_skipped_entries", F.lit(0).cast("bigint"))


def debug_trace(docs: DataFrame, mappings: DataFrame, leaks: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", redacted_col: str = "redacted", mode: str = "standard") -> DataFrame:
    """(section, key, json): a run's trace, a row for each of its parts, so that no part grows into one task.

    Sections are summary (one row with counts, by source and type), document (sizes), mapping (an entry with its places in
    each document, the first twenty shown) and leak. Mappings have ord, type, original, masked and source.
    """
    occurrence = occurrences_of(docs, mappings, id_col, text_col)
    placed = mappings.join(occurrence, "original", "left").select(
        F.lit("mapping").alias("section"), F.concat_ws(":", F.lpad(F.col("ord").cast("string"), 6, "0"), F.col(id_col).cast("string")).alias("key"),
        F.to_json(F.struct("type", "original", "masked", "source", F.col(id_col).cast("string").alias("source_file"), F.coalesce("n", F.lit(0)).alias("count"), "positions", F.coalesce("truncated", F.lit(False)).alias("truncated")), {"ignoreNullFields": "false"}).alias("json"),
    )
    size = lambda c: F.length(F.coalesce(F.col(c), F.lit("")))
    documents = docs.select(F.lit("document").alias("section"), F.col(id_col).cast("string").alias("key"), F.to_json(F.struct(F.col(id_col).cast("string").alias("source_file"), size(text_col).alias("original_chars"), size(redacted_col).alias("redacted_chars"))).alias("json"))
    found = docs.select(F.lit(None).cast("string").alias("type")).limit(0) if leaks is None else leaks
    n_leaks = found.agg(F.count("*").alias("leak_count"))
    by = lambda c: mappings.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias(f"{c}_counts"))
    summary = mappings.agg(F.count("*").alias("mapping_count")).crossJoin(n_leaks).crossJoin(by("source")).crossJoin(by("type"))  # single rows
    top = summary.select(F.lit("summary").alias("section"), F.lit("").alias("key"), F.to_json(F.struct(F.lit("1.0").alias("version"), F.lit(mode).alias("mode"), "mapping_count", "leak_count", "source_counts", "type_counts")).alias("json"))
    out = top.unionByName(documents).unionByName(placed)
    return out if leaks is None else out.unionByName(leaks.select(F.lit("leak").alias("section"), F.col(id_col).cast("string").alias("key"), F.to_json(F.struct(*leaks.columns)).alias("json")))
