"""Organization-name algebra. Lists are fixed values in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions.rejects import any_of
from inkveil.functions.spans import quoted

NOISY_PREFIXES = ("到的", "从未找", "未找", "直接找", "找", "一中", "二中", "三名", "该聊天", "首先", "原名", "否认其", "否认与")
NOISY_PARTS = ("的管理", "聊天记录", "主张过", "系关联公司")
SHORT_ALIAS = 6
GUARDED_TYPES = ("organization", "individual_business")
FOLLOWED_BY = r"(?:公司|集团|[一-龥A-Za-z0-9·]{1,16}(?:有限责任公司|股份有限公司|集团有限公司|有限公司|公司|集团))"


def simple_legal_suffix(value: Column) -> Column:
    """The generic form that stands for a full legal suffix in a mask."""
    return F.when(value.endswith("集团"), "集团").when(value.endswith("幼儿园"), "幼儿园").otherwise("公司")


def is_noisy_capture(text: Column) -> Column:
    """A span that took narrative words along with an organization."""
    numbered = text.rlike(r"^[一二三四五六七八九十\d]") & (F.length(text) <= 7)
    parts = F.lit(False)
    for p in NOISY_PARTS:
        parts = parts | text.contains(p)
    return text.rlike("^(?:" + "|".join(NOISY_PREFIXES) + ")") | numbered | parts | text.rlike(r"^合同[一二三四五六七八九十百零\d]+$")


def is_short_alias(original: Column) -> Column:
    """An alias so short that it must not be replaced inside a longer company name."""
    return (F.length(original) <= SHORT_ALIAS) & ~original.rlike("(?:公司|集团)$")


_LEGAL = any_of(L.LEGAL_SUFFIXES)
_INDUSTRY = any_of(sorted(L.INDUSTRY_TERMS, key=len, reverse=True))
_PROVINCE = any_of(sorted((p + s for p in L.PROVINCE_NAMES for s in ("省", "")), key=len, reverse=True))
_NAMED = "(?:以下简称|简称为|简称|下称)"


def legal_suffix(name: Column) -> Column:
    """The first of the legal suffixes that the name ends with; empty if none."""
    out = F.lit("")
    for s in reversed(L.LEGAL_SUFFIXES):
        out = F.when(name.endswith(s), F.lit(s)).otherwise(out)
    return out


def company_body(name: Column) -> Column:
    """A company's name without its legal suffix, bracketed places and a leading province."""
    body = F.regexp_replace(name, f"^(.+?){_LEGAL}$", "$1")
    places = any_of((*L.PROVINCE_NAMES, "[一-龥]{1,7}[省市区县镇乡]"))
    body = F.btrim(F.regexp_replace(body, f"[（(]{places}[）)]", ""), F.lit("（）() "))
    return F.regexp_replace(body, f"^{_PROVINCE}(?=..)", "")


def industry(body: Column) -> Column:
    """The longest industry term that a body ends with; empty if none."""
    return F.regexp_extract(body, f"({_INDUSTRY})$", 1)


def brand(name: Column) -> Column:
    """What distinguishes a company: its body without a leading city and the industry."""
    body = F.regexp_replace(company_body(name), "^[一-龥]{2,6}?[市州盟](?=..)", "")
    return F.btrim(F.regexp_replace(body, f"^(.+?){_INDUSTRY}$", "$1"), F.lit("（）() "))


def alias_cores(name: Column) -> Column:
    """Cores by which a company may be called: its body, its brand, halves of a brand of four characters or more."""
    body, own = company_body(name), brand(name)
    number = F.regexp_extract(body, "第([一二三四五六七八九十]+)工程", 1)
    cores = F.array(
        body, own, F.when(F.length(own) >= 4, F.substring(own, 1, 2)), F.when(F.length(own) >= 4, F.substring(own, 3, 100)),
        F.when(body.contains("电力建设"), "电建"), F.when(number != "", F.concat(number, F.lit("建"))),
    )
    return F.when(legal_suffix(name) != "", F.array_distinct(F.filter(F.array_compact(cores), lambda c: F.length(c) >= 2))).otherwise(F.array().cast("array<string>"))


# The ways in which a text gives an organization another name.
_FORMER = r"(?:原名称|原名|曾用名|原公司名称|原为|原系)"
_OPENING = "[“\"'「『（(]?"
_WHOLE_NAME = L.ORGANIZATION.replace(r"(?:^|(?<=[\s，,。；;：:、（(与和及由向对给找]))", "")
ALIAS_PATTERNS = (
    rf"{_FORMER}(?:\s*[：:]\s*|\s*为\s+|\s+)({_WHOLE_NAME})",  # a whole name stands after a colon or space
    rf"{_NAMED}\s*{_OPENING}\s*([一-龥A-Za-z0-9·]{{2,20}}(?:公司|集团))",
    rf"{_NAMED}\s*{_OPENING}\s*([一-龥A-Za-z0-9·]{{2,20}})",
)


def explicit_aliases(text: Column, name: Column) -> Column:
    """Names that a text gives to an organization in the clause after each mention of it: all former names and short forms.

    A mention's clause is a bracket right after it and what follows, up to the end of the sentence and 120 characters,
    unless that goes on with another party; a mention that is itself a short form has none.
    """
    mention = F.concat(F.lit(rf"(?<!{_NAMED}\s{{0,9}})"), quoted(name), F.lit(r"(?=((?:[（(][^）)]*[）)])?+(?:(?![与及和])[^。！？；]{0,120})?))"))
    clauses = F.regexp_extract_all(text, mention, F.lit(1))
    found = F.transform(clauses, lambda c: F.flatten(F.array(*(F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in ALIAS_PATTERNS))))
    return F.when((name != "") & text.contains(name), F.array_distinct(F.filter(F.flatten(found), lambda a: (a != "") & (a != name)))).otherwise(F.array().cast("array<string>"))


def institution_mask(name: Column) -> Column:
    """First character, 某 and the kind, for law firms, accountants, hospitals, schools and bank branches; else null."""
    kind = F.regexp_extract(name, "(律师事务所|会计师事务所|医院|学校)$", 1)
    branch = F.when(name.contains("银行"), F.regexp_extract(name, "(分行|支行|营业部)$", 1)).otherwise("")
    suffix = F.when(kind != "", kind).otherwise(branch)
    return F.when(suffix != "", F.concat(F.substring(name, 1, 1), F.lit("某"), suffix))


def canonical_score(name: Column) -> Column:
    """How well a name stands for its subject: full companies before short ones, longer before shorter."""
    base = (
        F.when(name.rlike("(?:有限责任公司|股份有限公司|集团有限公司|有限公司)$"), 9000).when(name.rlike(any_of(L.INSTITUTION_SUFFIXES) + "$"), 7000)
        .when(name.rlike("(?:公司|集团|幼儿园)$") & (F.length(name) > 4), 5000).when(name.rlike("(?:公司|集团|幼儿园)$"), 1500).otherwise(100)
    )
    return base + F.least(F.length(name), F.lit(80))
