"""Place dictionary: division and alias tables, their terms, and the terms' occurrences in texts.

A dictionary join does not compare every text with every term: one automaton of all terms reads each text once, or each
place of a text is looked up by its next characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels, suffixes that are counted in a name, words that are no place by themselves, words of an address.
LEVELS = {"province": 1, "city": 2, "county": 3, "county_city": 3, "township": 4, "village": 5, "community": 5}
SUFFIX_WORDS = ("省", "市", "区", "县", "镇", "乡", "街道")
GENERIC_TERMS = ("省", "市", "区", "县", "镇", "乡", "街道", "社区", "村", "市辖区", "村村民委员会", "村村委会", "社区居民委员会", "社区居委会")
ADDRESS_WORDS = ("住", "住所地", "户籍地", "经常居住地", "位于", "地址", "所在地", "登记", "户籍")
NEAR = 20
KEY_CHARS = 2
BROADCAST_TERMS = 1_000_000


def level_rank(level: Column) -> Column:
    out = F.lit(9)
    for name, rank in LEVELS.items():
        out = F.when(level == name, rank).otherwise(out)
    return out


def level_from_code(code: Column) -> Column:
    """The level of a twelve-digit division code, from its trailing zeros."""
    return (
        F.when(F.substring(code, 3, 10) == "0" * 10, "province").when(F.substring(code, 5, 8) == "0" * 8, "city")
        .when(F.substring(code, 7, 6) == "0" * 6, "county").when(F.substring(code, 10, 3) == "000", "township").otherwise("village")
    )


def parent_code(code: Column) -> Column:
    """The code one level up; the province's own parent is the empty text."""
    level, cut = level_from_code(code), {"city": 2, "county": 4, "township": 6, "village": 9}
    out = F.lit("")
    for name, n in cut.items():
        out = F.when(level == name, F.rpad(F.substring(code, 1, n), 12, "0")).otherwise(out)
    return out


def suffix_count(name: Column) -> Column:
    """How many administrative suffixes occur in a name, each as often as it occurs."""
    total = F.lit(0)
    for word in SUFFIX_WORDS:
        total = total + (F.length(name) - F.length(F.replace(name, F.lit(word), F.lit("")))) / len(word)
    return total


def short_alias(level: Column, name: Column) -> Column:
    """What a division is called for short; null if there is no such name of two characters."""
    province = F.regexp_extract(name, "^(.{2,})(?:省|自治区|特别行政区)$", 1)
    city, county = F.regexp_extract(name, "^(.{2,})市$", 1), F.regexp_extract(name, "^(.{2,})[区县市旗]$", 1)
    alias = F.when(level == "province", province).when(level == "city", city).when(level.isin("county", "county_city"), county)
    return F.nullif(alias, F.lit(""))


def entity_type(level: Column, name: Column) -> Column:
    """Villages and communities, and their committees, are organizations; all else is a place."""
    return F.when(level.isin("village", "community") | name.rlike("(?:村民委员会|居民委员会|村委会|居委会)$"), "grassroots_org").otherwise("location")


def is_short_local_name(term: Column, level: Column) -> Column:
    """So short that it is a place only beside an address."""
    county = level.isin("county", "county_city") & ~term.rlike("[区县市旗]$") & (F.length(term) <= 3)
    village = level.isin("village", "community") & ~term.rlike("(?:村民委员会|居民委员会|村委会|居委会)$") & (F.length(term) <= 2)
    return county | village


def has_address_context(text: Column, start: Column, end: Column) -> Column:
    """Words of an address are near: one of ADDRESS_WORDS before, or the levels of an address around."""
    lo = F.greatest(start - NEAR, F.lit(0))
    before, window = F.substring(text, lo + 1, start - lo), F.substring(text, lo + 1, end + NEAR - lo)
    return before.rlike("|".join(ADDRESS_WORDS)) | (window.contains("镇") & window.contains("村")) | (window.contains("街道") & window.contains("社区"))


def divisions(rows: DataFrame) -> DataFrame:
    """The first row of each code, with level and parent where they are missing. Rows have code, name, ord."""
    first = Window.partitionBy("code").orderBy("ord")
    kept = rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    return kept.withColumns({"level": level_from_code(F.col("code")), "parent_code": parent_code(F.col("code"))})


def full_names(table: DataFrame) -> DataFrame:
    """Divisions with the names of their ancestors before their own, level by level."""
    out = table.withColumn("full_name", F.col("name")).withColumn("__up", F.col("parent_code"))
    for _ in range(max(LEVELS.values()) - 1):
        up = table.select(F.col("code").alias("__up"), F.col("name").alias("__name"), F.col("parent_code").alias("__next"))
        out = out.join(up, "__up", "left").withColumn("full_name", F.concat(F.coalesce("__name", F.lit("")), "full_name")).withColumn("__up", F.coalesce("__next", F.lit(""))).drop("__name", "__next")
    return out.drop("__up")


def terms(table: DataFrame, aliases: DataFrame | None = None, deepest: str = "village") -> DataFrame:
    """(term, code, canonical_name, level, entity_type, confidence) of divisions (code, name, level, and full_name if it
    is known) and aliases (alias, canonical_name, division_code, confidence).

    Full names, names and short forms of two characters or more, generic ones left out; full names of townships only when
    they are the name; aliases with more than one administrative suffix only if they are the name itself or a village's.
    Levels below ``deepest`` are left out. Of equal terms the most confident, then the smallest code.
    """
    full = F.coalesce("full_name", "name") if "full_name" in table.columns else F.col("name")
    rows = table.select("code", "level", F.btrim("name").alias("name"), F.btrim(full).alias("full")).where(level_rank(F.col("level")) <= LEVELS[deepest])
    part = lambda term, confidence: rows.select(term.alias("term"), "code", F.col("full").alias("canonical_name"), "level", F.lit(confidence).alias("confidence"))
    whole = F.when((F.col("full") == F.col("name")) | F.col("level").isin("village", "community", "county", "county_city", "city", "province"), F.col("full"))
    every = part(whole, 0.98).unionByName(part(F.col("name"), 0.92)).unionByName(part(short_alias(F.col("level"), F.col("name")), 0.9))
    if aliases is not None:
        own = aliases.join(table.select("code", "level"), aliases["division_code"] == table["code"], "left").withColumn("level", F.coalesce("level", F.lit("unknown")))
        alias, leaf = F.btrim("alias"), F.element_at(F.split(F.btrim("canonical_name"), "/"), -1)
        fits = F.col("level").isin("village", "community") | (alias == leaf) | (suffix_count(alias) <= 1)
        deep = F.lit(deepest == "village") | (level_rank(F.col("level")) <= LEVELS[deepest])
        every = every.unionByName(own.where(fits & deep).select(alias.alias("term"), F.col("division_code").alias("code"), "canonical_name", "level", "confidence"))
    best = Window.partitionBy("term").orderBy(F.desc("confidence"), "code")
    kept = every.where((F.length("term") >= 2) & ~F.col("term").isin(*GENERIC_TERMS)).withColumn("__n", F.row_number().over(best)).where("__n = 1")
    return kept.select("term", "code", "canonical_name", "level", entity_type(F.col("level"), F.col("term")).alias("entity_type"), "confidence")


def find_terms(docs: DataFrame, dictionary: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = BROADCAST_TERMS) -> DataFrame:
    """(id, start, end, and the dictionary's columns): every occurrence of every term, nested and overlapping ones too.

    A dictionary of at most ``most`` terms (checked) goes to every task as one automaton, which reads a text once. A
    larger one is joined on terms' first characters, and only its terms of fewer than KEY_CHARS go to the automaton.
    """
    kept = dictionary.where(F.length("term") > 0)
    words = [r[0] for r in kept.select("term").distinct().limit(most + 1).collect()]
    if len(words) > most:
        brief = kept.where(F.length("term") < KEY_CHARS)  # as many as there are characters, at most
        scanned = _scan_terms(docs, brief, [r[0] for r in brief.select("term").distinct().collect()], id_col, text_col)
        return _join_terms(docs, kept, id_col, text_col).unionByName(scanned)
    return _scan_terms(docs, kept, words, id_col, text_col)


def _scan_terms(docs: DataFrame, dictionary: DataFrame, words: list[str], id_col: str, text_col: str) -> DataFrame:
    """Every occurrence of ``words``, the dictionary's terms, by one automaton."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for w in words:
            automaton.add_word(w, w)
        automaton.make_automaton()
        for batch in batches:
            row, start, term = [], [], []
            for i, text in enumerate(batch.column(text_col).to_pylist() if words else ()):
                for last, w in automaton.iter(text) if text else ():
                    row.append(i), start.append(last + 1 - len(w)), term.append(w)
            yield pa.RecordBatch.from_arrays([batch.column(id_col).take(pa.array(row, pa.int64())), pa.array(start, pa.int32()), pa.array(term, pa.string())], names=[id_col, "start", "term"])

    found = docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {id_type}, start int, term string")
    rows = dictionary.where(F.length("term") > 0)
    few = rows.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS  # a term may have many rows
    return found.join(F.broadcast(rows) if few else rows, "term").select(id_col, "start", (F.col("start") + F.length("term")).alias("end"), *dictionary.columns)


def _join_terms(docs: DataFrame, dictionary: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every place of a text, keyed by its next KEY_CHARS characters, against the terms with that key. Shorter terms than
    the key are left to the automaton."""
    longest = dictionary.agg(F.max(F.length("term"))).first()[0] or 0
    chars = F.split(F.col(text_col), "")
    places = F.transform(F.sequence(F.lit(1), F.size("c") - KEY_CHARS + 1), lambda i: F.struct((i - 1).alias("start"), F.array_join(F.slice("c", i, KEY_CHARS), "").alias("key"), F.array_join(F.slice("c", i, longest), "").alias("ahead")))
    spread = docs.where(F.length(text_col) >= KEY_CHARS).select(F.col(id_col), chars.alias("c")).select(id_col, F.explode(places).alias("p")).select(id_col, "p.*")
    keyed = dictionary.where(F.length("term") >= KEY_CHARS).withColumn("key", F.substring("term", 1, KEY_CHARS))
    exact = spread.join(keyed, "key").where(F.col("ahead").startswith(F.col("term")))
    return exact.select(id_col, "start", (F.col("start") + F.length("term")).alias("end"), *dictionary.columns)


def admitted(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Occurrences (id, start, end, term, level) but short local names that stand beside no address."""
    short = is_short_local_name(F.col("term"), F.col("level"))
    doubtful = found.where(short).join(docs.select(id_col, F.col(text_col).alias("__text")), id_col)
    return found.where(~short).unionByName(doubtful.where(has_address_context(F.col("__text"), F.col("start"), F.col("end"))).drop("__text"))


def resolve_places(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of places the longest, then the most confident, then the first. One that begins with a kept, longer one of no deeper
    level goes, and so does one that overlaps a kept one, unless both are townships or above."""
    rank = level_rank(F.col("level")).alias("rank")
    rows = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("l"), (-F.col("confidence")).alias("c"), "start", "end", "term", "code", "level", rank)))
    grouped = found.groupBy(id_col).agg(rows.alias("all"))
    direct = lambda x: x["rank"] <= LEVELS["township"]

    def blocked(x: Column, y: Column) -> Column:
        begins = (x["start"] == y["start"]) & (x["end"] < y["end"]) & (x["rank"] >= y["rank"])
        return begins | ((x["start"] < y["end"]) & (y["start"] < x["end"]) & ~(direct(x) & direct(y)))

    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), lambda a, x: F.when(F.exists(a, lambda y: blocked(x, y)), a).otherwise(F.array_append(a, x)))
    return grouped.select(id_col, F.explode(kept).alias("p")).select(id_col, "p.start", "p.end", "p.term", "p.code", "p.level")
