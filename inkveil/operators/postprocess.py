"""Anti-joins that remove mappings whose occurrences all lie inside those of others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.noise import is_company_variant, is_noise_entity, is_noise_project
from inkveil.functions.organizations import alias_cores, canonical_score
from inkveil.functions.rejects import is_false_organization, is_false_person, is_false_place
from inkveil.functions.spans import occurrences
from inkveil.operators.components import alias_components
from inkveil.operators.replace import with_entries


def mapping_occurrences(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", text_col: str = "text", on: str | None = None) -> DataFrame:
    """(id, type, original, start, end): every occurrence, overlapping ones too."""
    joined = with_entries(docs, mappings, on)
    each = joined.select(id_col, text_col, F.explode(F.filter("__entries", lambda x: F.col(text_col).contains(x["original"]))).alias("m"))
    found = each.select(id_col, F.col("m.type").alias("type"), F.col("m.original").alias("original"), F.explode(occurrences(F.col(text_col), F.col("m.original"))).alias("start"))
    return found.withColumn("end", F.col("start") + F.length("original"))


def inside_only(inner: DataFrame, outer: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, original) whose occurrences in ``inner`` (at least one) all lie within an occurrence of ``outer``.

    Within a document, an occurrence lies inside another just when, of those that start no later, one ends no earlier: a
    running maximum in one pass over both, instead of a join of all pairs.
    """
    marks = inner.select(id_col, "original", "start", "end", F.lit(0).alias("is_outer")).unionByName(outer.select(id_col, "original", "start", "end", F.lit(1).alias("is_outer")))
    reach = F.max(F.when(F.col("is_outer") == 1, F.col("end"))).over(Window.partitionBy(id_col).orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    seen = marks.withColumn("covered", F.coalesce(reach >= F.col("end"), F.lit(False))).where("is_outer = 0")
    return seen.groupBy(id_col, "original").agg(F.bool_and("covered").alias("inside")).where("inside").select(id_col, "original")


def locations_inside_organizations(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, original) of locations that occur only within organizations; a mapping without occurrences stays."""
    found = mapping_occurrences(docs, mappings, id_col, text_col)
    return inside_only(found.where("type = 'location'"), found.where("type = 'organization'"), id_col)


def fragments_inside_longer(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 4) -> DataFrame:
    """(id, original) of originals of at most ``most`` characters that occur only within longer originals."""
    found = mapping_occurrences(docs, mappings, id_col, text_col)
    size = F.length("original")
    return inside_only(found.where(size <= most), found.where(size > most), id_col)


def alias_prefixed_locations(mappings: DataFrame, key: str = "map_id") -> DataFrame:
    """Mappings without locations that are an organization's alias followed by another location."""
    cuts = F.explode(F.transform(F.sequence(F.lit(1), F.length("original") - 1), lambda i: F.struct(F.substring(F.col("original"), F.lit(1), i).alias("alias"), F.substring(F.col("original"), i + 1, F.length("original")).alias("place"))))
    places = mappings.where("type = 'location'")
    halves = places.where(F.length("original") > 1).select(key, "original", cuts.alias("cut")).select(key, "original", "cut.*")
    aliases = mappings.where("type = 'organization'").select(key, F.col("original").alias("alias")).distinct()
    compound = halves.join(aliases, [key, "alias"], "left_semi").join(places.select(key, F.col("original").alias("place")), [key, "place"], "left_semi")
    return mappings.join(compound.select(key, "original", F.lit("location").alias("type")).distinct(), [key, "original", "type"], "left_anti").select(*mappings.columns)


def without_noise(mappings: DataFrame) -> DataFrame:
    """Mappings whose original can be what its type says."""
    noise = (
        F.when(F.col("type") == "person", is_false_person(F.col("original")))
        .when(F.col("type") == "organization", is_false_organization(F.col("original")))
        .when(F.col("type") == "location", is_false_place(F.col("original"), F.lit("")))
        .otherwise(False)
    )
    return mappings.where(~noise)


def without_noise_names(mappings: DataFrame) -> DataFrame:
    """Mappings whose original is no clause, document or figure, and for organizations and projects can be such a name."""
    name = F.coalesce("original", F.lit(""))
    organization = F.col("type").isin("organization", "individual_business")
    return mappings.where(~is_noise_entity(name) & (~organization | is_company_variant(name)) & ((F.col("type") != "project") | ~is_noise_project(name)))


SAMPLED = "sample_library:"
BLOCK_CHARS = 64
SAMPLED_TYPES = ("organization", "individual_business", "location", "grassroots_org", "person", "project")


def inside_trusted_samples(docs: DataFrame, mappings: DataFrame, id_col: str = "doc_id", text_col: str = "text", on: str | None = None) -> DataFrame:
    """(id, original) of found mappings (with source) that occur only within names of the sample library, and of places
    each of whose occurrences holds two such names or more."""
    sampled = F.col("source").startswith(SAMPLED)
    trusted = mapping_occurrences(docs, mappings.where(sampled & F.col("type").isin(*SAMPLED_TYPES)), id_col, text_col, on)
    found = mapping_occurrences(docs, mappings.where(~F.coalesce(sampled, F.lit(False))), id_col, text_col, on)
    inside = inside_only(found, trusted, id_col)
    block = lambda c: F.floor(c / BLOCK_CHARS)  # noqa: E731  names meet the places that reach into their block only
    names = trusted.select(id_col, F.col("original").alias("name"), F.col("start").alias("s"), F.col("end").alias("e"), block(F.col("start")).alias("block"))
    places = found.where(F.col("type").isin("location", "grassroots_org")).withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.greatest("start", F.col("end") - 1)))))
    held = places.join(names, [id_col, "block"], "left").withColumn("held", (F.col("s") >= F.col("start")) & (F.col("e") <= F.col("end")) & (F.col("name") != F.col("original")))
    each = held.groupBy(id_col, "original", "start").agg(F.count_distinct(F.when(F.col("held"), F.col("name"))).alias("n"))
    return inside.unionByName(each.groupBy(id_col, "original").agg(F.min("n").alias("n")).where("n >= 2").select(id_col, "original")).distinct()


def alias_edges(mappings: DataFrame, key: str = "map_id") -> DataFrame:
    """(key, a, b): links of organizations of one map that share an alias core and may be merged, connected like all pairs.

    A core links its names by a star, not by all pairs: to the least of the names that block none, or else the least. Only
    names that must not be merged with that one are paired with all others of the core.
    """
    blocked = F.coalesce(F.col("do_not_merge"), F.array().cast("array<string>"))
    own = mappings.where("type = 'organization'").select(key, "original", "entity_id", blocked.alias("blocked"), F.explode(alias_cores(F.col("original"))).alias("core"))
    first = own.groupBy(key, "core").agg(F.min(F.struct((F.size("blocked") > 0).alias("blocks"), "original", "entity_id", "blocked")).alias("f"))
    holds = lambda names, one: F.coalesce(F.array_contains(names, one), F.lit(False))
    free = lambda x: ~holds(F.col("blocked"), F.col(f"{x}.entity_id")) & ~holds(F.col(f"{x}.blocked"), F.col("entity_id"))
    met = own.join(first, [key, "core"])
    star = met.where((F.col("original") != F.col("f.original")) & free("f")).select(key, F.col("f.original").alias("a"), F.col("original").alias("b"))
    apart = met.where(~free("f")).select(key, "core", F.struct("original", "entity_id", "blocked").alias("o"))
    others = own.join(apart, [key, "core"]).where((F.col("original") != F.col("o.original")) & free("o"))
    return star.unionByName(others.select(key, F.least("original", "o.original").alias("a"), F.greatest("original", "o.original").alias("b"))).distinct()


def merge_aliases(mappings: DataFrame, key: str = "map_id") -> DataFrame:
    """``mappings`` with one mask for every group of organizations that share alias cores: that of the canonical name."""
    groups = alias_components(alias_edges(mappings, key), key).select(key, F.col("node").alias("original"), "component")
    members = mappings.join(groups, [key, "original"])
    best = members.groupBy(key, "component").agg(F.max_by("masked", F.struct(canonical_score(F.col("original")).alias("s"), "original")).alias("group_mask"))
    masks = groups.join(best, [key, "component"]).select(key, "original", F.lit("organization").alias("type"), "group_mask")
    joined = mappings.join(masks, [key, "original", "type"], "left")
    return joined.withColumn("masked", F.coalesce("group_mask", "masked")).select(*mappings.columns)
