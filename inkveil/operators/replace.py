"""Longest-first replacement, its inverse, and what can be counted and shown about it.

The longest original has priority over all of the text. Small maps are applied in JVM string functions: originals are
replaced one after the other, longest first, by marks of private-use characters, and the marked text is cut once at its
marks to put the masks in. Characters of that block which texts or originals hold themselves are escaped before, so that
no original can match within a mark. Larger shared maps, and maps with short organization names, for which it matters
what follows in the text, go through an Arrow function: all places are found, the longest kept, and the text is spliced
once. Both ways give the same text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.organizations import FOLLOWED_BY, GUARDED_TYPES, is_short_alias
from inkveil.functions.spans import count_occurrences, occurrences

RESERVED = "".join(chr(0xE000 + k) for k in range(64))  # a block of private-use characters
OPEN, CLOSE, DIGITS, UNIT, HIGH, LOW = RESERVED[0], RESERVED[1], RESERVED[2:12], RESERVED[12], RESERVED[16:24], RESERVED[24:32]
ANY_RESERVED = f"[{RESERVED[0]}-{RESERVED[-1]}]"
JVM_ENTRIES = 64
BROADCAST_MAPPINGS, BROADCAST_BYTES = 100_000, 16 << 20
AHEAD = 24
_FOLLOWED = re.compile(FOLLOWED_BY)


def _mark(i: Column) -> Column:
    return F.concat(F.lit(OPEN), F.translate(i.cast("string"), "0123456789", DIGITS), F.lit(CLOSE))


def _escaped(text: Column) -> Column:
    """Every character of the reserved block as three: one with which nothing else begins, and its number in two digits."""
    place = lambda c: F.instr(F.lit(RESERVED), c)
    unit = lambda c: F.concat(F.lit(UNIT), F.substring(F.lit("".join(h * 8 for h in HIGH)), place(c), F.lit(1)), F.substring(F.lit(LOW * 8), place(c), F.lit(1)))
    letters = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(ANY_RESERVED), unit(c)).otherwise(c))
    return F.when(text.rlike(ANY_RESERVED), F.array_join(letters, "")).otherwise(text)


def _unescaped(text: Column) -> Column:
    parts = F.split(text, UNIT)

    def one(p: Column) -> Column:
        place = (F.instr(F.lit(HIGH), F.substring(p, 1, 1)) - 1) * 8 + F.instr(F.lit(LOW), F.substring(p, 2, 1))
        return F.concat(F.substring(F.lit(RESERVED), place, F.lit(1)), F.substring(p, F.lit(3), F.length(p)))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.when(text.contains(UNIT), F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))).otherwise(text)


def _ordered(entries: Column, key: str, ordinal: str) -> Column:
    """Entries longest key first, in their own order among equals, numbered."""
    rank = F.array_sort(F.transform(F.filter(entries, lambda x: x[key] != ""), lambda x: F.struct((-F.length(x[key])).alias("n"), x[ordinal].alias("o"), x.alias("m"))))
    return F.transform(rank, lambda x, i: F.struct(x["m"][key].alias("key"), x["m"].alias("m"), i.alias("i")))


def replace_marks(text: Column, entries: Column, key: str = "original", ordinal: str = "ord") -> tuple[Column, Column]:
    """The escaped text with a mark for each replaced stretch, and the numbered entries."""
    ordered = _ordered(entries, key, ordinal)
    return F.aggregate(ordered, _escaped(text), lambda t, x: F.replace(t, _escaped(x["key"]), _mark(x["i"]))), ordered


def fill_parts(parts: Column, ordered: Column, value, between=lambda t: t) -> Column:
    """A marked text that is split at OPEN, with ``value`` of each mark's entry, and ``between`` of what stands between marks."""

    def one(p: Column) -> Column:
        i = F.translate(F.substring_index(p, CLOSE, 1), DIGITS, "0123456789").cast("int")
        return F.concat(F.coalesce(value(F.get(ordered, i)["m"]), F.lit("")), between(_unescaped(F.substring(p, F.instr(p, CLOSE) + 1, F.length(p)))))

    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return F.concat(between(_unescaped(F.get(parts, F.lit(0)))), F.array_join(rest, ""))


def fill_marks(marked: Column, ordered: Column, value, between=lambda t: t) -> Column:
    """:func:`fill_parts` of a marked text."""
    return fill_parts(F.split(marked, OPEN), ordered, value, between)


def with_replaced(docs: DataFrame, text_col: str, entries: str, out: str, key: str = "original", value: str = "masked", ordinal: str = "ord") -> DataFrame:
    """``docs`` with the keys of an array column of entries replaced in the text, longest key first, as :func:`replace_all`.

    Marks and order are columns of their own, so that each is computed once a text, and not at all without entries.
    """
    marked, ordered = replace_marks(F.col(text_col), F.col(entries), key, ordinal)
    some = F.size(entries) > 0
    bound = docs.withColumns({"__parts": F.when(some, F.split(marked, OPEN)), "__ordered": F.when(some, ordered)})
    done = F.when(some, fill_parts(F.col("__parts"), F.col("__ordered"), lambda m: m[value])).otherwise(F.col(text_col))
    return bound.withColumn(out, done).drop("__parts", "__ordered")


def replace_all(text: Column, entries: Column, key: str = "original", value: str = "masked", ordinal: str = "ord") -> Column:
    """``text`` with the keys of ``entries`` (array of structs) replaced by their values, longest key first."""
    marked, ordered = replace_marks(text, entries, key, ordinal)
    return fill_marks(marked, ordered, lambda m: m[value])


def _chosen(text: str, found: Iterable[tuple[int, int]], entries: list[tuple[str, str, bool]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the entries (key, value, guarded) among the places ``found`` (entry, start), lowest entry first.

    A guarded key stays where a longer company name goes on after it.
    """
    taken, chosen = bytearray(len(text)), []
    for i, start in sorted(found):
        key, value, guarded = entries[i]
        end = start + len(key)
        if taken.find(1, start, end) < 0 and not (guarded and _FOLLOWED.match(text, end, end + AHEAD)):
            taken[start:end] = b"\1" * len(key)
            chosen.append((start, end, value))
    return sorted(chosen)


def splice(text: str, chosen: list[tuple[int, int, str]]) -> str:
    """``text`` with values put in at (start, end, value)."""
    out, at = [], 0
    for start, end, value in chosen:
        out += [text[at:start], value]
        at = end
    return "".join([*out, text[at:]])


def _places(text: str, entries: list[tuple[str, str, bool]]) -> Iterable[tuple[int, int]]:
    for i, (key, _, _) in enumerate(entries):
        at = text.find(key)
        while at >= 0:
            yield i, at
            at = text.find(key, at + 1)


def _longest_first(rows: Iterable[dict]) -> list[tuple[str, str, bool]]:
    ordered = sorted((r for r in rows if r["k"]), key=lambda r: (-len(r["k"]), r["o"]))
    return [(r["k"], r["v"] or "", bool(r["g"])) for r in ordered]


_AUTOMATA: dict[tuple, tuple] = {}  # of the last map of a worker, so that batches and tasks share it


def _automaton(rows: list[dict]) -> tuple[ahocorasick.Automaton | None, list[tuple[str, str, bool]]]:
    entries = _longest_first(rows)
    key = tuple(entries)
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        automaton = ahocorasick.Automaton()
        for i, (word, _, _) in enumerate(entries):
            if word not in automaton:
                automaton.add_word(word, i)
        automaton.make_automaton()
        _AUTOMATA[key] = (automaton if entries else None, entries)
    return _AUTOMATA[key]


def replaced_places(text: str | None, rows: list[dict], shared: bool = False) -> list[tuple[int, int, str]] | None:
    """(start, end, value) of what a map's rows (k, v, o, g) replace in a text; None for a null text.

    A ``shared`` map's automaton is built once in a worker; small maps of single texts are searched entry by entry.
    """
    if text is None:
        return None
    if not shared:
        entries = _longest_first(rows)
        return _chosen(text, _places(text, entries), entries)
    automaton, entries = _automaton(rows)
    return _chosen(text, ((i, last + 1 - len(entries[i][0])) for last, i in automaton.iter(text)), entries) if automaton else []


def _spliced_by_shared(text: Column, rows: list[dict]) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else splice(t, replaced_places(t, rows, shared=True)) for t in texts.to_pylist()], pa.string())

    return run(text)


def _spliced_by_row(text: Column, entries: Column) -> Column:
    @F.arrow_udf("string")
    def run(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([None if t is None else splice(t, replaced_places(t, own or ())) for t, own in zip(texts.to_pylist(), lists.to_pylist(), strict=True)], pa.string())

    return run(text, entries)


def _checked(mappings: DataFrame) -> None:
    """A shared map has a bounded number of entries and bytes: it goes to every task."""
    texts = [F.coalesce(F.octet_length(F.col(f.name)), F.lit(0)) for f in mappings.schema if f.dataType.simpleString() == "string"]
    n, size = mappings.agg(F.count("*"), F.sum(sum(texts, F.lit(0).cast("bigint")))).first()
    if n > BROADCAST_MAPPINGS or (size or 0) > BROADCAST_BYTES:
        raise ValueError(f"a shared map has at most {BROADCAST_MAPPINGS} entries of {BROADCAST_BYTES} bytes; key larger ones by document")


def with_entries(docs: DataFrame, mappings: DataFrame, on: str | None = None, column: str = "__entries") -> DataFrame:
    """``docs`` with an array of mapping entries: those of the same ``on`` key, or all of one shared map.

    A shared map is one row, broadcast while its size is below a checked bound; otherwise it is refused, since every
    document would have to go through all of it (give mappings a key then).
    """
    fields = [c for c in mappings.columns if c != on]
    packed = F.collect_list(F.struct(*fields)).alias(column)
    if on:
        return docs.join(mappings.groupBy(on).agg(packed), on, "left").withColumn(column, F.coalesce(column, F.array()))
    _checked(mappings)
    return docs.crossJoin(F.broadcast(mappings.agg(packed)))


def mapping_rows(mappings: DataFrame, on: str | None, guard: bool, key: str, value: str) -> tuple[DataFrame, list[dict]]:
    """Mappings as (on, k, v, o, g); and those of one shared map, whose size is checked, as rows on the driver."""
    guarded = F.col("type").isin(*GUARDED_TYPES) & is_short_alias(F.btrim(F.col(key))) if guard else F.lit(False)
    slim = mappings.select(*([on] if on else []), F.col(key).alias("k"), F.col(value).alias("v"), F.col("ord").alias("o"), F.coalesce(guarded, F.lit(False)).alias("g"))
    if on:
        return slim, []
    _checked(slim)
    return slim, [r.asDict() for r in slim.collect()]


def _applied(docs: DataFrame, mappings: DataFrame, text_col: str, on: str | None, guard: bool, out: str, key: str, value: str) -> DataFrame:
    slim, rows = mapping_rows(mappings, on, guard, key, value)
    if on:
        joined = with_entries(docs, slim, on)
        done = joined.withColumn(out, _spliced_by_row(F.col(text_col), F.col("__entries"))) if guard else with_replaced(joined, text_col, "__entries", out, "k", "v", "o")
        return done.drop("__entries")
    if len(rows) > JVM_ENTRIES or any(r["g"] for r in rows):
        return docs.withColumn(out, _spliced_by_shared(F.col(text_col), rows))
    return with_replaced(with_entries(docs, slim), text_col, "__entries", out, "k", "v", "o").drop("__entries")


def apply_mappings(docs: DataFrame, mappings: DataFrame, text_col: str = "text", on: str | None = None, guard: bool = True, out: str = "redacted") -> DataFrame:
    """``docs`` with the redacted text. Mappings have ord, type, original, masked, and the ``on`` column if given."""
    return _applied(docs, mappings, text_col, on, guard, out, "original", "masked")


def restore_lookup(mappings: DataFrame, *keys: str) -> DataFrame:
    """(masked, original) for restoring: of entries with one mask the first ``restore_original``, else the last original."""
    first = F.min_by("restore_original", F.when(F.col("restore_original").isNotNull(), F.col("ord")))
    groups = mappings.groupBy(*keys, "masked").agg(F.coalesce(first, F.max_by("original", "ord")).alias("original"), F.min("ord").alias("ord"), F.countDistinct("original").alias("n_originals"))
    return groups.withColumn("ambiguous", F.col("n_originals") > 1)


def restore(docs: DataFrame, mappings: DataFrame, text_col: str = "redacted", on: str | None = None, out: str = "restored") -> DataFrame:
    """``docs`` with masks replaced by their originals, longest mask first."""
    lookup = restore_lookup(mappings, *([on] if on else []))
    return _applied(docs, lookup, text_col, on, False, out, "masked", "original")


def placeholder_counts(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", text_col: str = "redacted") -> DataFrame:
    """(id, masked, n): how often each distinct mask stands in each text; masks that do not occur give no row."""
    masks = mappings.where("masked <> ''").select(F.lit(0).alias("ord"), "masked").distinct()
    counted = with_entries(docs, masks).select(id_col, F.explode(F.transform("__entries", lambda x: F.struct(x["masked"].alias("masked"), count_occurrences(F.col(text_col), x["masked"]).alias("n")))).alias("c"))
    return counted.select(id_col, "c.*").where("n > 0")


def unresolved_placeholders(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", text_col: str = "restored") -> DataFrame:
    """(id, placeholder): known masks that are still in a text, and bracketed ones that no map knows."""
    text = F.col(text_col)
    masks = with_entries(docs, mappings.where("masked <> ''").select(F.lit(0).alias("ord"), "masked").distinct())
    known = F.filter(F.transform("__entries", lambda x: x["masked"]), lambda m: text.contains(m))
    unknown = F.regexp_extract_all(text, F.lit("【[^】\n]{1,80}】"), F.lit(0))
    return masks.select(id_col, F.explode(F.array_distinct(F.concat(known, unknown))).alias("placeholder"))


def trace_positions(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 20) -> DataFrame:
    """(id, original, n, positions, truncated): non-overlapping places of each original, the first ``most`` shown."""
    text = F.col(text_col)
    joined = with_entries(docs, mappings.select("ord", "original"))
    each = joined.select(id_col, text_col, F.explode(F.filter("__entries", lambda x: text.contains(x["original"]))).alias("m"))
    found = each.select(id_col, F.col("m.original").alias("original"), occurrences(text, F.col("m.original"), overlapping=False).alias("all"))
    return found.select(id_col, "original", F.size("all").alias("n"), F.slice("all", 1, most).alias("positions"), (F.size("all") > most).alias("truncated"))


def escape_html(text: Column) -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def highlight(docs: DataFrame, mappings: DataFrame, text_col: str = "text", on: str | None = None, out: str = "html") -> DataFrame:
    """``docs`` with the text as HTML, what would be replaced in ``<mark>``."""
    joined = with_entries(docs, mappings, on)
    marked, ordered = replace_marks(F.col(text_col), F.col("__entries"))
    shown = fill_marks(marked, ordered, lambda m: F.concat(F.lit("<mark>"), escape_html(m["original"]), F.lit("</mark>")), escape_html)
    return joined.withColumn(out, shown).drop("__entries")
