"""Masks of administrative places and paths, with ordinals that a division's full and short names share.

A document's candidates fall into clusters that no span reaches out of, so that the rule which of them stay is applied to
a few spans at a time. A mask's ordinal belongs to a subject: a division's code leads to the core of the name under which
it first appears, and every other name to its own core.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.ordinals import ordinal_text
from inkveil.functions.places import location_core, masked_part
from inkveil.operators.gazetteer import level_rank

# Levels whose places are taken without being asked for, by source, and those that may overlap their like.
REGIONAL_SOURCE = "hebei_admin_db"
WIDE_LEVELS = ("province", "city", "county", "county_city")
REGIONAL_LEVELS = ("province", "city", "county", "county_city", "township")
#: Endings of a place in the order in which they are tried, and the shape of a path with its five levels.
ENDINGS = ("居民委员会", "村民委员会", "居委会", "村委会", "自治区", "自治州", "街道", "社区", "省", "市", "区", "县", "旗", "镇", "乡", "村")
PATH = (
    r"^([一-龥]+?(?:省|自治区))?"
    r"([一-龥]+?(?:市|自治州))?"
    r"([一-龥]+?(?:(?<!社)区|县))?"
    r"([一-龥]+?(?:街道|镇|乡))?"
    r"([一-龥]+?(?:居民委员会|居委会|村民委员会|村委会|社区|村))?$"
)
TASK_ROWS = 250_000
CODE_DIGITS = 12
CUTS = {1: 2, 2: 4, 3: 6, 4: 9, 5: 12}  # digits of a code that name its ancestor of a level


def code_interval(code: Column) -> Column:
    """(lo, hi): the codes of a division and of all below it; shorter codes are filled up with zeros."""
    full = F.rpad(code, CODE_DIGITS, "0")
    own = F.lit(CODE_DIGITS)
    for level in (4, 3, 2, 1):
        own = F.when(F.substring(full, F.lit(CUTS[level] + 1), F.lit(CODE_DIGITS)).rlike("^0+$"), CUTS[level]).otherwise(own)
    return F.struct(full.alias("lo"), F.concat(F.left(full, own), F.repeat(F.lit("9"), F.lit(CODE_DIGITS) - own)).alias("hi"))


def with_ancestors(rows: DataFrame, divisions: DataFrame, code_col: str = "code") -> DataFrame:
    """``rows`` with ``ancestors``: (code, name) of the divisions whose intervals hold the row's code, from the top.

    Intervals of a code tree nest, and the one of a level that holds a code begins at the code's own digits of that level:
    so the range condition is an equality on five keys, one join instead of one for each level. Divisions have code, name.
    """
    keyed = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__full", F.rpad(code_col, CODE_DIGITS, "0"))
    at = F.array_distinct(F.array(*(F.rpad(F.left("__full", F.lit(n)), CODE_DIGITS, "0") for n in CUTS.values())))
    own = divisions.select(F.rpad("code", CODE_DIGITS, "0").alias("__at"), F.col("name").alias("__name"))
    met = keyed.select("__row", F.explode(at).alias("__at")).join(own, "__at")
    held = met.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct(F.col("__at").alias("code"), F.col("__name").alias("name")))).alias("ancestors"))
    empty = F.array().cast("array<struct<code:string,name:string>>")
    return keyed.join(held, "__row", "left").withColumn("ancestors", F.coalesce("ancestors", empty)).drop("__row", "__full")


def path_parts(text: Column) -> Column:
    """The levels of a path that a text consists of, from the top; none if it is no path."""
    part = lambda k: F.nullif(F.regexp_extract(text, PATH, k), F.lit(""))
    return F.array_compact(F.array(*(part(k) for k in range(1, 6))))


def ending(text: Column) -> Column:
    out = F.lit("")
    for e in reversed(ENDINGS):
        out = F.when(text.endswith(e), e).otherwise(out)
    return out


def mask_suffix(level: Column, text: Column, canonical: Column) -> Column:
    """What stands after the ordinal: the kind of the name itself, of the full name, or of the level; may be empty."""
    by_level = (
        F.when(level == "province", F.when(canonical.endswith("自治区"), "自治区").otherwise("省")).when(level == "city", F.when(canonical.endswith("自治州"), "自治州").otherwise("市"))
        .when(level == "county_city", "市").when(level == "county", "县").when(level == "township", "镇").otherwise("")
    )
    named = F.coalesce(F.nullif(ending(text), F.lit("")), F.nullif(ending(canonical), F.lit("")), by_level)
    return (
        F.when(text.endswith("村民委员会"), "村民委员会").when(text.endswith("村委会"), "村委会").when(text.endswith("居民委员会"), "社区居民委员会").when(text.endswith("居委会"), "社区居委会")
        .when(level == "community", "社区").when(level == "village", "村").otherwise(named)
    )


def automatic(candidates: DataFrame) -> DataFrame:
    """Places that are masked without being asked for: of the regional source down to townships, of others provinces, cities
    and districts (counties only where the text ends in 区)."""
    level = F.col("level")
    wide = level.isin(*WIDE_LEVELS) & ((level != "county") | F.col("text").endswith("区"))
    return candidates.where((F.col("type") == "location") & F.when(F.col("source") == REGIONAL_SOURCE, level.isin(*REGIONAL_LEVELS)).otherwise(wide))


def accepted_places(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Candidates (id, start, end, text, level, ...) that stay, by place, shorter ones first: one that overlaps a kept one of
    another level goes, and so does one that overlaps any below townships."""
    order = [F.col("start"), F.col("end") - F.col("start"), F.col("end"), F.col("text"), F.col("code")]
    before = Window.partitionBy(id_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    opens = (F.col("start") >= F.coalesce(F.max("end").over(before), F.lit(0))).cast("int")
    upto = Window.partitionBy(id_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    clustered = candidates.withColumn("__opens", opens).withColumn("__cluster", F.sum("__opens").over(upto))
    fields = [c for c in candidates.columns if c != id_col]
    row = F.struct(F.col("start").alias("o1"), (F.col("end") - F.col("start")).alias("o2"), F.col("end").alias("o3"), F.col("text").alias("o4"), F.col("code").alias("o5"), F.struct(*fields).alias("c"))
    grouped = clustered.groupBy(id_col, "__cluster").agg(F.array_sort(F.collect_list(row)).alias("all"))
    blocks = lambda x, y: (y["c"]["end"] > x["c"]["start"]) & (y["c"]["start"] < x["c"]["end"]) & ~((x["c"]["level"] == y["c"]["level"]) & x["c"]["level"].isin(*REGIONAL_LEVELS))
    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), lambda a, x: F.when(F.exists(a, lambda y: blocks(x, y)), a).otherwise(F.array_append(a, x)))
    return grouped.select(id_col, F.explode(kept).alias("k")).select(id_col, "k.c.*")


def partitions_for(rows: DataFrame) -> int:
    """As many partitions as keep TASK_ROWS of ``rows`` each, and no fewer than the session's: what a task holds does not grow
    with the table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / TASK_ROWS))


def mask_admin_places(candidates: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, end, original, masked, level, code, source) of the places that stay among ``candidates`` (id, type, text,
    start, end, level, code, canonical_name, source).

    A text of several levels is masked level by level; another one is an ordinal and its kind, and the names of one code
    share the ordinal. Ordinals run by place in the document. Null codes and canonical names are like empty ones; repeated
    rows stay once; documents without candidates give no rows.
    """
    spread = candidates.repartition(partitions_for(candidates), id_col)
    own = automatic(spread.withColumns({"code": F.coalesce("code", F.lit("")), "canonical_name": F.coalesce("canonical_name", F.lit(""))})).dropDuplicates([id_col, "start", "end", "text", "code", "level"])
    kept = accepted_places(own, id_col).withColumns({"parts": path_parts(F.col("text")), "suffix": mask_suffix(F.col("level"), F.col("text"), F.col("canonical_name"))})
    whole = (F.size("parts") <= 1) & (F.col("suffix") != "")
    pieces = kept.withColumn("whole", whole).withColumn("pieces", F.when(whole, F.array("text")).otherwise(F.col("parts"))).select("*", F.posexplode_outer("pieces").alias("nth", "piece"))
    asked = pieces.withColumns({"core": location_core(F.col("piece")), "own_code": F.when(F.col("whole") & (F.col("code") != ""), F.col("code")), "at": F.struct("start", F.col("end") - F.col("start"), "end", "text", "code", "nth")})
    first = F.first("core").over(Window.partitionBy(id_col, "own_code").orderBy("at"))  # no join: a document stays in its partition
    subjects = asked.withColumn("subject", F.coalesce(F.when(F.col("own_code").isNotNull(), first), F.col("core")))
    plain = F.col("piece").isNull()  # a place that is neither whole nor a path keeps its text, and takes no ordinal
    began = subjects.withColumn("began", F.min("at").over(Window.partitionBy(id_col, "subject")))
    numbered = began.withColumn("prefix", ordinal_text(F.dense_rank().over(Window.partitionBy(id_col).orderBy(plain, "began", "subject"))))
    shown = F.when(plain, F.col("text")).when(F.col("whole"), F.concat("prefix", "suffix")).otherwise(masked_part(F.col("piece"), F.col("prefix")))
    keys = [id_col, "start", "end", "text", "level", "code", "source"]
    joined = numbered.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", shown.alias("m")))), lambda x: x["m"]), "").alias("masked"))
    return joined.select(id_col, "start", "end", F.col("text").alias("original"), "masked", "level", "code", "source")
