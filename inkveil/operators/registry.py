"""Recogniser payloads: parsing, verification against the text, must-link and cannot-link pairs."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.spans import occurrences

PAYLOAD = "persons array<string>, organizations array<string>, locations array<string>, same_entities array<array<string>>"
MOST_NAMES, MOST_LENGTH = 16, 240
KINDS = {"persons": "person", "organizations": "organization", "locations": "location"}


@F.arrow_udf(T.StringType())
def complete_object(payloads: pa.Array) -> pa.Array:
    """The first complete JSON object of a text, or null.

    A text that breaks off inside its object gets the brackets it lacks, after the last complete item.
    """
    return pa.array([_complete(p) for p in payloads.to_pylist()], pa.string())


def _complete(text: str | None) -> str | None:
    begin = (text or "").find("{")
    if begin < 0:
        return None
    closers: list[str] = []
    quoted = escaped = False
    safe: tuple[int, str] | None = None  # how far all items are complete, and what closes them there
    for i, c in enumerate(text[begin:], begin):
        if quoted:
            quoted = not (c == '"' and not escaped)
            escaped = c == "\\" and not escaped
            continue
        if c == '"':
            quoted = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closers or closers.pop() != c:
                return None
            if not closers:
                return _valid(text[begin : i + 1])
            safe = (i + 1, "".join(reversed(closers)))
        elif c == "," and closers:
            safe = (i, "".join(reversed(closers)))
    return _valid(text[begin : safe[0]] + safe[1]) if safe else None


def _valid(text: str) -> str | None:
    try:
        return text if isinstance(json.loads(text), dict) else None
    except ValueError:
        return None


def parse_payloads(rows: DataFrame, id_col: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(id, type, name, nth): the distinct names of each kind in their order, without empty and overlong ones."""
    parsed = rows.select(id_col, F.from_json(F.col(payload), PAYLOAD).alias("p"))

    def claimed(field: str, kind: str) -> Column:
        return F.transform(F.coalesce(F.col(f"p.{field}"), F.array()), lambda n, i: F.struct(F.lit(kind).alias("type"), F.btrim(n).alias("name"), i.alias("nth")))

    arrays = [claimed(field, kind) for field, kind in KINDS.items()]
    named = parsed.select(id_col, F.explode(F.concat(*arrays)).alias("n")).select(id_col, "n.*")
    usable = named.where((F.col("name") != "") & (F.length("name") <= MOST_LENGTH))
    return usable.groupBy(id_col, "type", "name").agg(F.min("nth").alias("nth"))


def same_entity_edges(rows: DataFrame, id_col: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(id, a, b): each name of a group with the group's first; the group's components need no more pairs than that."""
    groups = rows.select(id_col, F.explode(F.from_json(F.col(payload), PAYLOAD)["same_entities"]).alias("g")).where(F.size("g") > 1)
    return groups.select(id_col, F.get("g", 0).alias("a"), F.explode(F.slice("g", 2, MOST_NAMES - 1)).alias("b")).where("a <> b").distinct()


def materialise(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, type, name, start, end): the names' occurrences in their own text; names that do not occur give none."""
    joined = docs.select(id_col, text_col).hint("merge").join(names, id_col).where(F.col(text_col).contains(F.col("name")))
    found = joined.select(id_col, "type", "name", F.explode(occurrences(F.col(text_col), F.col("name"), overlapping=False)).alias("start"))
    return found.withColumn("end", F.col("start") + F.length("name"))


def primary_names(members: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """The longest name of each group, the first of equals, with at most MOST_NAMES names of it in that order."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.length(name)), "nth")
    ranked = members.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= MOST_NAMES)
    return ranked.withColumn("primary_name", F.first(name).over(order)).drop("__n")


def conflicting_names(names: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, name) claimed for more than one type: they are only reviewed."""
    return names.groupBy(id_col, "name").agg(F.countDistinct("type").alias("n")).where("n > 1").select(id_col, "name")


def valid_payload(payload: Column) -> Column:
    return F.from_json(payload, PAYLOAD).isNotNull() & F.is_valid_utf8(payload)


DETAILED = "entities array<struct<entity_id:string,entity_type:string,primary_text:string,variants:array<string>,confidence:double>>, do_not_merge array<struct<left_id:string,right_id:string>>"
IDENTITY_MARKERS = ("又名", "曾用名", "别名", "化名", "绰号", "即", "原名")
IDENTITY_REACH = 48


def parse_detailed(rows: DataFrame, id_col: str = "doc_id", payload: str = "payload") -> DataFrame:
    """(id, entity_id, type, name, nth, confidence, blocked) of the detailed payload form; of repeated ids the first
    entity counts, confidences are held within 0 and 1, ``blocked`` lists the ids that an entity must not merge with."""
    parsed = rows.select(id_col, F.from_json(F.col(payload), DETAILED).alias("p"))
    blocks = lambda e: F.array_distinct(F.array_compact(F.transform(F.coalesce(F.col("p.do_not_merge"), F.array()), lambda b: F.when(b["left_id"] == e["entity_id"], b["right_id"]).when(b["right_id"] == e["entity_id"], b["left_id"]))))
    entities = parsed.select(id_col, F.posexplode(F.transform("p.entities", lambda e: F.struct(e.alias("e"), blocks(e).alias("blocked")))).alias("place", "x"))
    first = entities.groupBy(id_col, F.col("x.e.entity_id").alias("entity_id")).agg(F.min_by("x", "place").alias("x")).where("entity_id <> ''")
    names = F.array_distinct(F.filter(F.concat(F.array("x.e.primary_text"), F.coalesce("x.e.variants", F.array())), lambda n: n.isNotNull() & (n != "") & (F.length(n) <= MOST_LENGTH)))
    confidence = F.least(F.greatest(F.coalesce("x.e.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return first.select(id_col, "entity_id", F.col("x.e.entity_type").alias("type"), F.posexplode(F.slice(names, 1, MOST_NAMES)).alias("nth", "name"), confidence.alias("confidence"), F.col("x.blocked").alias("blocked"))


def merge_passes(first: DataFrame, second: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, entity_id, type, name): the first pass's groups, each second-pass entity joined to the first of them that it
    shares a name and type with, or else kept as a group of its own under a new id."""
    shared = second.join(first.select(id_col, "type", "name", F.col("entity_id").alias("into")), [id_col, "type", "name"])
    target = shared.groupBy(id_col, "entity_id").agg(F.min("into").alias("into"))
    moved = second.join(target, [id_col, "entity_id"], "left").withColumn("entity_id", F.coalesce("into", F.concat(F.lit("second-"), "entity_id")))
    columns = [id_col, "entity_id", "type", "name"]
    every = first.select(*columns, F.lit(0).alias("pass")).unionByName(moved.select(*columns, F.lit(1).alias("pass")))
    return every.groupBy(id_col, "type", "name").agg(F.min_by("entity_id", F.struct("pass", "entity_id")).alias("entity_id")).select(*columns)


def identity_evidence(text: Column, left: Column, right: Column) -> Column:
    """Both names stand within IDENTITY_REACH characters of one sentence, with a word that equates them."""
    between = "[^。！？；\\n]{0," + str(IDENTITY_REACH) + "}?"
    marker = "(?:" + "|".join(IDENTITY_MARKERS) + ")"
    q = lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))
    return F.regexp_like(text, F.concat(q(left), F.lit(between + marker + between), q(right))) | F.regexp_like(text, F.concat(q(right), F.lit(between + marker + between), q(left)))


def validated(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Names (id, entity_id, type, name, nth) that stand in their text, with the entity's primary name (its first, or else
    the first that is left) and whether several entities of one type claim the name: such a name is only reviewed."""
    texts = docs.select(id_col, F.col(text_col).alias("__text")).hint("merge")  # a text's size cannot be told from its source's: never broadcast
    present = names.join(texts, id_col).where(F.col("__text").contains(F.col("name"))).drop("__text")
    once = present.groupBy(id_col, "entity_id", "type", "name").agg(F.min("nth").alias("nth"))
    claims, own = Window.partitionBy(id_col, "type", "name"), Window.partitionBy(id_col, "entity_id")
    first = F.min(F.when(F.col("nth").isNotNull(), F.struct("nth", "name"))).over(own)["name"]
    judged = once.withColumns({"conflict": F.count("entity_id").over(claims) > 1, "primary_name": first})
    return judged.where("type IS NOT NULL AND entity_id IS NOT NULL").select(id_col, "type", "name", "entity_id", "nth", "conflict", "primary_name")


def person_groups(docs: DataFrame, names: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Names (id, entity_id, type, name, nth) with ``part``: 0 for all names of an entity that belong together, 1 and on for
    persons' names that no words of the text equate with one of the parts before."""
    grouped = names.groupBy(id_col, "entity_id", "type").agg(F.array_sort(F.collect_list(F.struct("nth", "name"))).alias("all"))
    texts = grouped.join(docs.select(id_col, F.col(text_col).alias("__text")).hint("merge"), id_col)
    start = F.array().cast("array<struct<nth:int,name:string,part:int>>")

    def step(kept: Column, x: Column) -> Column:
        known = F.filter(kept, lambda y: (y["name"] == x["name"]) | identity_evidence(F.col("__text"), y["name"], x["name"]))
        fresh = F.coalesce(F.array_max(F.transform(kept, lambda y: y["part"])) + 1, F.lit(0))
        part = F.when(F.col("type") != "person", 0).when(F.size(known) > 0, F.array_min(F.transform(known, lambda y: y["part"]))).otherwise(fresh)
        return F.array_append(kept, F.struct(x["nth"].cast("int").alias("nth"), x["name"].alias("name"), part.cast("int").alias("part")))

    return texts.select(id_col, "entity_id", "type", F.explode(F.aggregate("all", start, step)).alias("n")).select(id_col, "entity_id", "type", "n.name", "n.nth", "n.part")
