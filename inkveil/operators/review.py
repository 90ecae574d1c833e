"""Edits that reviewers make to a map, applied as set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.ordinals import ordinal_index, ordinal_text
from inkveil.operators.pseudonyms import ordinals


def apply_edits(mappings: DataFrame, edits: DataFrame, key: str = "map_id") -> DataFrame:
    """``mappings`` after ``edits`` (key, nth, action, original, masked, type): the last edit of an original decides.

    ``delete`` removes it, ``modify`` replaces its mask, ``add`` adds it unless it is there, ``keep`` changes nothing.
    """
    last = edits.groupBy(key, "original").agg(F.max_by(F.struct("action", F.col("masked").alias("new_mask"), F.col("type").alias("new_type")), "nth").alias("e"))
    joined = mappings.join(last.select(key, "original", "e.*"), [key, "original"], "left")
    kept = joined.where(~F.coalesce(F.col("action") == "delete", F.lit(False)))
    kept = kept.withColumn("masked", F.when(F.col("action") == "modify", F.coalesce("new_mask", "masked")).otherwise(F.col("masked"))).select(*mappings.columns)
    added = last.where("e.action = 'add'").select(key, "original", F.col("e.new_type").alias("type"), F.col("e.new_mask").alias("masked")).join(mappings, [key, "original"], "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def rename_group(mappings: DataFrame, renames: DataFrame, key: str = "map_id") -> DataFrame:
    """Every mapping with one mask gets another: ``renames`` has (key, masked, new_mask), the last of equals by order."""
    new = renames.groupBy(key, "masked").agg(F.max("new_mask").alias("new_mask"))
    return mappings.join(new, [key, "masked"], "left").withColumn("masked", F.coalesce("new_mask", "masked")).select(*mappings.columns)


def ambiguous_masks(mappings: DataFrame, key: str = "map_id") -> DataFrame:
    """(key, masked, originals): masks that stand for several subjects, which a restore could mix up."""
    return mappings.groupBy(key, "masked").agg(F.count_distinct(F.coalesce("entity_id", "original")).alias("subjects"), F.array_sort(F.collect_set("original")).alias("originals")).where("subjects > 1")


def merge_batch_maps(maps: DataFrame, base_first: str = "batch_ord") -> DataFrame:
    """One map of several documents' maps: of equal originals the entry of the earliest document, then the first."""
    order = Window.partitionBy("original").orderBy(base_first, "ord")
    return maps.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


ORDINAL = "(?:[甲乙丙丁戊己庚辛壬癸]|[0-9]{2,9})"


def renumber(mappings: DataFrame, key: str = "map_id") -> DataFrame:
    """``mappings`` whose masks' ordinals count on without gaps: groups with one mask are numbered by first appearance
    within their type, persons within their surname, and the ordinal in the mask is replaced."""
    stem = F.when(F.col("type") == "person", F.regexp_extract("masked", "^(.某)", 1)).otherwise("")
    numbered = ordinals(mappings.withColumn("__stem", stem), [key, "type", "__stem"], "masked", "ord", "__n")
    place = F.when(F.col("type") == "person", F.concat(F.lit("^.某"), F.lit(ORDINAL + "$"))).otherwise(F.lit("^" + ORDINAL))
    new = F.when(F.col("type") == "person", F.concat("__stem", ordinal_text(F.col("__n")))).otherwise(F.concat(ordinal_text(F.col("__n")), F.regexp_replace("masked", "^" + ORDINAL, "")))
    return numbered.withColumn("masked", F.when(F.regexp_like(F.col("masked"), place), new).otherwise(F.col("masked"))).select(*mappings.columns)


def classify_rows(edited: DataFrame, original: DataFrame, key: str = "map_id") -> DataFrame:
    """(key, original, state) of a reviewed map against the automatic one: unchanged, modified, added or deleted."""
    left, right = original.select(key, "original", F.col("masked").alias("was")), edited.select(key, "original", F.col("masked").alias("now"))
    joined = left.join(right, [key, "original"], "full")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") == F.col("now"), "unchanged").otherwise("modified")
    return joined.select(key, "original", state.alias("state"))


#: Endings that a mask made by hand keeps; the first that fits.
ORGANIZATION_ENDS = ("有限公司", "股份有限公司", "公司", "集团", "银行", "信用社", "合作社", "事务所", "律所", "学校", "医院", "法院", "检察院", "委员会", "村委会", "居委会", "商行", "经营部", "店", "厂")
LOCATION_ENDS = ("自治区", "自治州", "居民委员会", "村民委员会", "街道", "社区", "省", "市", "区", "县", "旗", "镇", "乡", "村", "小区", "项目", "工程")
FAMILIES = {"organization": "organization", "individual_business": "organization", "location": "location", "grassroots_org": "location", "person": "person"}


def _ending(name: Column, ends: tuple[str, ...], other: str) -> Column:
    out = F.lit(other)
    for end in reversed(ends):
        out = F.when(name.endswith(end), F.lit("公司" if end.endswith("有限公司") else end)).otherwise(out)
    return out


def suggest_masks(selected: DataFrame, mappings: DataFrame, key: str = "map_id") -> DataFrame:
    """Masks for names that a reviewer selects (key, nth, original, type), numbered on from those of the map: persons
    within their surname or as natural persons, organizations and places by their ending, all else as sensitive."""
    family = lambda c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in FAMILIES.items() for x in pair)), c), c)
    name = F.btrim("original")
    full = (F.col("type") == "person") & name.rlike("^[一-龥]{2,4}$")
    stem = F.when(full, F.concat(F.substring(name, 1, 1), F.lit("某"))).when(F.col("type") == "person", "自然人").when(F.col("type").isin("organization", "location"), "").otherwise("敏感信息")
    end = F.when(F.col("type") == "organization", _ending(name, ORGANIZATION_ENDS, "机构")).when(F.col("type") == "location", _ending(name, LOCATION_ENDS, "地")).otherwise("")
    asked = selected.withColumns({"original": name, "family": family(F.col("type")), "stem": stem, "ending": end})
    stems = asked.select(key, "family", "stem").distinct()
    number = F.regexp_extract(F.substring("masked", F.length("stem") + 1, F.length("masked")), "^([甲乙丙丁戊己庚辛壬癸]|[0-9]+)", 1)
    used = mappings.withColumn("family", family(F.col("type"))).join(stems, [key, "family"]).where(F.col("masked").startswith(F.col("stem"))).withColumn("n", ordinal_index(number))
    last = used.groupBy(key, "family", "stem").agg(F.max("n").alias("last"))
    order = Window.partitionBy(key, "family", "stem").orderBy("nth")
    numbered = asked.join(last, [key, "family", "stem"], "left").withColumn("ordinal", F.coalesce("last", F.lit(0)) + F.row_number().over(order))
    return numbered.select(key, "nth", "type", "original", F.concat("stem", ordinal_text(F.col("ordinal")), "ending").alias("masked"))
