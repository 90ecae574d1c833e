"""Feedback samples and case folders: upserts, top lists, unique bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions.identifiers import PROVINCES
from inkveil.functions.rejects import any_of
from inkveil.operators.gazetteer import find_terms

#: Fixed order of actions.
ACTION_ORDER = {"delete": 0, "keep": 1, "modify": 2, "add": 3}


def upsert_latest(rows: DataFrame, key: str, order: list[Column], first_seen: str | None = None) -> DataFrame:
    """The last row of each key; with the key's earliest time as ``first_seen_at`` if a column is named.

    A hot key is fine: the last row and the earliest time are aggregates, combined before the shuffle.
    """
    fields = [c for c in rows.columns if c != key]
    aggregates = [F.max_by(F.struct(*fields), F.struct(*order)).alias("r")]
    if first_seen:
        aggregates.append(F.min(first_seen).alias("first_seen_at"))
    grouped = rows.groupBy(key).agg(*aggregates)
    return grouped.select(key, "r.*", *(["first_seen_at"] if first_seen else []))


def recent(rows: DataFrame, condition: Column, order: list[Column], limit: int = 100) -> DataFrame:
    """The newest rows that meet a condition."""
    return rows.where(condition).orderBy(*order).limit(limit)


def action_rank(action: Column) -> Column:
    out = F.lit(9)
    for name, n in ACTION_ORDER.items():
        out = F.when(action == name, n).otherwise(out)
    return out


def best_with_ties(rows: DataFrame, group: str, member: str, within: list[str]) -> DataFrame:
    """Within each key, the groups with the most distinct members, all of them if several have as many."""
    counted = rows.groupBy(*within, group).agg(F.countDistinct(member).alias("n"))
    return counted.withColumn("__r", F.rank().over(Window.partitionBy(*within).orderBy(F.desc("n")))).where("__r = 1").drop("__r")


def binding(rows: DataFrame, key: str, target: str) -> DataFrame:
    """(key, state, target): ``unique`` with its target, or ``ambiguous``; keys without a target are ``missing``."""
    grouped = rows.groupBy(key).agg(F.countDistinct(target).alias("n"), F.min(target).alias("t"))
    state = F.when(F.col("n") == 0, "missing").when(F.col("n") == 1, "unique").otherwise("ambiguous")
    return grouped.select(key, state.alias("state"), F.when(F.col("n") == 1, F.col("t")).alias(target))


def next_ordinals(used: DataFrame, key: str, ordinal: str) -> DataFrame:
    """(key, next): one more than the largest ordinal in use."""
    return used.groupBy(key).agg((F.max(ordinal) + 1).alias("next"))


def effective_delta(existing: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(state, n): incoming samples that are created, updated or unchanged; the last of an incoming key counts (by nth)."""
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*values), "nth").alias("new"))
    old = existing.select(key, F.struct(*values).alias("old"))
    joined = last.join(old, key, "left")
    state = F.when(F.col("old").isNull(), "created").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("updated")
    return joined.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def few_shot(rows: DataFrame, per_action: int = 8) -> DataFrame:
    """The newest samples of each action, at most ``per_action``, for prompts."""
    order = Window.partitionBy("action").orderBy(F.desc("updated_at"), F.desc("original"))
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per_action)


def protected_name(original: Column, surnames: str) -> Column:
    """A short common person name, which one deletion must not block everywhere."""
    return original.rlike(f"^[{surnames}][一-龥]{{1,2}}$")


#: Endings by which an added sample is seen to be a whole entity. Fixed values.
COMPOUND_SURNAMES = (
    "欧阳", "司马", "上官", "夏侯", "诸葛", "闻人", "东方", "赫连", "皇甫", "尉迟",
    "公羊", "澹台", "公冶", "宗政", "濮阳", "淳于", "单于", "太叔", "申屠", "公孙",
    "仲孙", "轩辕", "令狐", "钟离", "宇文", "长孙", "慕容", "鲜于", "闾丘", "司徒",
    "司空", "端木", "巫马", "公西", "漆雕", "乐正", "拓跋", "夹谷", "谷梁", "南宫",
)
DELETE_SAFE_TYPES = ("case_number", "phone", "id_number", "bank_account", "uscc", "email")
COMPANY_MASKS = ("公司", "集团", "律所", "事务所", "机构", "商行", "经营部", "合作社")
PLACE_ENDS = ("省", "市", "区", "县", "镇", "乡", "村", "社区", "街道")
PROJECT_MASKS = ("小区", "项目", "工程")


def lookup_allowed(original: Column, masked: Column, kind: Column) -> Column:
    """Whether a sample may serve as a mapping elsewhere."""
    return (original != "") & (masked != "") & (original != masked) & ~((F.length(original) == 1) & F.lit(PROVINCES).contains(original)) & (kind != "case_number")


def added_type(original: Column, masked: Column, kind: Column) -> Column:
    """The type of an added sample that is a whole entity beyond doubt; else null."""
    size, ends = F.length(original), lambda c, words: c.rlike(any_of(words) + "$")
    organization = ends(masked, ("公司", "集团")) & (((kind == "organization") & (size >= 2)) | ((size >= 3) & original.rlike("公司|集团")))
    placed = kind.isin("location", "grassroots_org") | ends(original, (*PLACE_ENDS, "小区")) | ends(masked, ("小区", "村", "镇", "县", "区", "市", "省"))
    location = ends(masked, PLACE_ENDS) & (size >= 2) & placed
    person = kind.isin("person", "manual") & size.between(2, 4) & masked.rlike("^[一-龥]某[一-龥]?$")
    project = (size >= 3) & ends(masked, PROJECT_MASKS)
    found = F.when(organization, "organization").when(location, "location").when(person, "person").when(project, "project")
    return F.when(lookup_allowed(original, masked, kind), found)


def _sampled(samples: DataFrame) -> DataFrame:
    """Samples (ord, action, type, original, masked, old_original, new_original, new_masked) with what they map: name, mask."""
    action, text = F.coalesce("action", F.lit("keep")), lambda c: F.coalesce(c, F.lit(""))
    changed = action == "modify"
    return samples.withColumns({
        "action": action, "kind": F.coalesce("type", F.lit("")), "name": F.when(changed, text("new_original")).otherwise(text("original")), "mask": F.when(changed, text("new_masked")).otherwise(text("masked")),
    })


def trusted_mappings(samples: DataFrame) -> DataFrame:
    """(ord, type, original, masked, source) of samples that may be applied elsewhere: kept and modified ones, and added
    ones that are whole entities; the first of each original."""
    rows = _sampled(samples)
    promoted = F.when(F.col("action") == "add", added_type(F.col("name"), F.col("mask"), F.col("kind")))
    company = (F.col("kind") == "person") & F.col("mask").rlike(any_of(COMPANY_MASKS) + "$")
    declared = F.when(F.col("kind") == "", "sample").otherwise(F.col("kind"))
    usable = rows.withColumn("promoted", promoted).where((F.col("action").isin("keep", "modify") | F.col("promoted").isNotNull()) & (F.col("name") != "") & (F.col("mask") != "") & (F.col("name") != F.col("mask")))
    kind = F.when(company, "organization").otherwise(F.coalesce("promoted", declared))
    first = F.min_by(F.struct("ord", kind.alias("type"), F.col("mask").alias("masked"), F.concat(F.lit("sample_library:"), F.col("action")).alias("source")), "ord")
    return usable.groupBy(F.col("name").alias("original")).agg(first.alias("f")).select("f.ord", "f.type", "original", "f.masked", "f.source")


def sample_lookup(samples: DataFrame) -> DataFrame:
    """(original, masked) of all kept, added and modified samples that may be looked up; the last of each original."""
    rows = _sampled(samples).where(F.col("action").isin("keep", "add", "modify") & lookup_allowed(F.col("name"), F.col("mask"), F.col("kind")))
    return rows.groupBy(F.col("name").alias("original")).agg(F.max_by("mask", "ord").alias("masked"))


def sample_blacklist(samples: DataFrame, surnames: str, compound: tuple[str, ...] = COMPOUND_SURNAMES) -> DataFrame:
    """(original) that deletions and changed originals keep from being found, but short common names of persons."""
    rows = _sampled(samples)
    old = F.when(rows["action"] == "delete", F.coalesce("original", F.lit(""))).when((rows["action"] == "modify") & (F.coalesce("old_original", F.lit("")) != F.col("name")), F.coalesce("old_original", F.lit("")))
    blocked = rows.select(F.btrim(old).alias("original"), "kind").where("original <> ''")
    name = F.col("original").rlike("^[一-龥]{2,3}$") & ~F.col("original").rlike("某|公司|法院|项目|工程")
    common = F.substring("original", 1, 1).rlike(f"[{surnames}]") | ((F.length("original") == 3) & F.substring("original", 1, 2).isin(*compound))
    return blocked.where(F.col("kind").isin(*DELETE_SAFE_TYPES) | ~(name & common)).select("original").distinct()


def detect_samples(docs: DataFrame, samples: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, original, masked): the occurrences of sampled originals; longer ones first, none overlapping."""
    found = find_terms(docs, sample_lookup(samples).withColumnRenamed("original", "term"), id_col, text_col)
    spans = F.array_sort(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("l"), "start", "end", "term", "masked")))
    free = lambda kept, x: ~F.exists(kept, lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"]))
    kept = F.aggregate("all", F.filter("all", lambda _: F.lit(False)), lambda a, x: F.when(free(a, x), F.array_append(a, x)).otherwise(a))
    rows = found.groupBy(id_col).agg(spans.alias("all")).select(id_col, F.explode(kept).alias("p"))
    return rows.select(id_col, "p.start", "p.end", F.col("p.term").alias("original"), "p.masked")


CASE_NAME = r"^(?!\.{1,2}$)[^/\\:*?\"<>|\x00-\x1f]{1,120}$"


def valid_case_name(name: Column) -> Column:
    """A folder name without separators, reserved characters or surrounding space."""
    return name.rlike(CASE_NAME) & (name == F.btrim(name))


def thread_id(url: Column) -> Column:
    """The number that a thread's address ends with; null if it ends otherwise."""
    return F.nullif(F.regexp_extract(url, r"/(\d{5,30})/?$", 1), F.lit(""))


def suggest_locations(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """(folder, matched, confidence, state): folders by how many wanted file names they hold; the best one is ``unique``
    or, with equals, ``ambiguous``. ``found`` has (folder, name), ``wanted`` has name."""
    names = wanted.select("name").distinct()
    total = names.count()
    ranked = found.join(names, "name", "left_semi").groupBy("folder").agg(F.count_distinct("name").alias("matched"))
    best = ranked.groupBy("matched").agg(F.count("*").alias("equals")).orderBy(F.desc("matched")).limit(1)
    state = F.when(F.col("equals") == 1, "unique").otherwise("ambiguous")
    return ranked.join(F.broadcast(best), "matched").select("folder", "matched", F.round(F.col("matched") / max(total, 1), 2).alias("confidence"), state.alias("state"))


def workflow_state(saved: Column, has_map: Column, bound: Column, restored: Column) -> Column:
    """How far a case has come."""
    return F.when(restored, "restored").when(bound & has_map, "bound").when(has_map, "redacted").when(saved, "saved").otherwise("new")
