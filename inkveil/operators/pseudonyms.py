"""Masks with running ordinals: a subject's number is its rank by first appearance among its kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.ordinals import ordinal_text
from inkveil.functions.places import is_compound_path, location_core, location_suffix, masked_part, path_parts

PROJECT_SUFFIXES = ("工程", "项目")


def ordinals(rows: DataFrame, keys: list[str], subject: str, position: str, out: str = "ordinal") -> DataFrame:
    """``rows`` with the rank of their subject's first position within ``keys`` (1, 2, ...), ties by subject.

    First positions are aggregated before they are ranked, so a subject is one row in its window however often it occurs.
    """
    first = rows.groupBy(*keys, subject).agg(F.min(position).alias("__first"))
    window = Window.partitionBy(*keys).orderBy("__first", subject)
    ranked = first.withColumn(out, F.row_number().over(window)).drop("__first")
    return rows.join(ranked, [*keys, subject])


def mask_persons(persons: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Persons (id, ord, text, entity) masked as surname, 某, ordinal among the surname's subjects of the document."""
    named = persons.where(F.col("text").rlike("^[一-龥·]{2,6}$")).withColumns({"surname": F.substring("text", 1, 1), "subject": F.coalesce("entity", "text")})
    numbered = ordinals(named, [id_col, "surname"], "subject", "ord")
    return numbered.select(id_col, "ord", F.lit("person").alias("type"), F.col("text").alias("original"), F.concat("surname", F.lit("某"), ordinal_text(F.col("ordinal"))).alias("masked"))


def mask_locations(places: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Places (id, ord, text) masked as the ordinal of their core and their suffix, and their cores likewise; a core and its
    full form share the ordinal. Paths of several levels are masked level by level, and stay when they are none."""
    path = F.filter(path_parts(F.col("text")), lambda p: p.isNotNull())
    rows = places.withColumns({"compound": is_compound_path(F.col("text")) | (F.size(path) > 1), "parts": path})
    pieces = rows.withColumn("pieces", F.when(F.col("compound"), F.col("parts")).otherwise(F.array("text"))).select(id_col, "ord", "text", "compound", F.posexplode("pieces").alias("nth", "piece"))
    cored = pieces.withColumns({"core": location_core(F.col("piece")), "at": F.struct("ord", "nth")}).where(F.col("compound") | (F.length("core") >= 2))
    numbered = ordinals(cored, [id_col], "core", "at").withColumn("prefix", ordinal_text(F.col("ordinal")))
    shown = F.when(F.col("compound"), masked_part(F.col("piece"), F.col("prefix"))).otherwise(F.concat("prefix", location_suffix(F.col("piece"))))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", shown.alias("m")))), lambda x: x["m"]), "")
    whole = numbered.groupBy(id_col, "ord", "text", "compound").agg(joined.alias("masked"), F.max("core").alias("core"))
    bare = F.when(~F.col("compound"), F.col("core")).when(F.col("text").endswith("省"), F.regexp_replace("text", "省$", ""))
    both = F.array(F.struct(F.lit(0).alias("nth"), F.col("text").alias("original")), F.struct(F.lit(1).alias("nth"), bare.alias("original")))
    every = whole.select(id_col, "ord", "masked", F.explode(both).alias("o")).where("o.original IS NOT NULL AND o.original <> ''")
    first = every.groupBy(id_col, "o.original").agg(F.min_by(F.struct("ord", "masked"), F.struct("ord", "o.nth")).alias("f"))
    return first.select(id_col, "f.ord", F.lit("location").alias("type"), "original", "f.masked").where("original <> masked")


def mask_projects(projects: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Projects (id, ord, text) masked as an ordinal and their kind."""
    numbered = ordinals(projects, [id_col], "text", "ord")
    kind = F.when(F.col("text").endswith("工程"), "工程").otherwise("项目")
    return numbered.select(id_col, "ord", F.lit("project").alias("type"), F.col("text").alias("original"), F.concat(ordinal_text(F.col("ordinal")), kind).alias("masked"))


#: Fixed order of mapping types in a map.
TYPE_ORDER = {"organization": 0, "location": 1, "person": 2, "project": 3}


def map_order(kind: Column, original: Column) -> list[Column]:
    """Sort keys of a map: type, longest original, original."""
    rank = F.lit(9)
    for name, n in TYPE_ORDER.items():
        rank = F.when(kind == name, n).otherwise(rank)
    return [rank, -F.length(original), original]


def first_wins(mappings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One entry per original of a map: the first. Entries that change nothing or have no mask are left out."""
    useful = mappings.where((F.col("original") != F.col("masked")) & (F.col("masked") != "") & (F.col("original") != ""))
    order = Window.partitionBy(id_col, "original").orderBy("ord")
    return useful.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
