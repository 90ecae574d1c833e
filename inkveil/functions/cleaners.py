"""Cleaning of captured names: what is no part of a person's or an organization's name is cut off its ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions.rejects import any_of

BRACKETS = (("（", "）"), ("(", ")"), ("【", "】"), ("[", "]"), ("《", "》"), ("<", ">"))
MARKS = " ：:，,。、；;\n\t"
PERSON_MARKS = " ：:，,。；;\n\t（）()"
NARRATIVE = (
    "^(?:设立的|成立的|注册的|组建的|设立|成立|注册"
    "|到(?=[一-龥A-Za-z0-9()（）·]{4,}(?:有限责任公司|股份有限公司|集团有限公司|有限公司|集团))"
    "|原(?=[一-龥]{4,}(?:有限责任公司|股份有限公司|集团有限公司|有限公司)))"
)
WITH_PERSON = "^([一-龥·]{2,4})(?:与|和|及)(.+)$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_odd_brackets(text: Column) -> Column:
    """Brackets at an end go when their partner is not at the other, as long as there are any."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in BRACKETS))

    def step(s: Column, p: Column) -> Column:
        begins, ends = s.startswith(p["a"]), s.endswith(p["b"])
        first, last = F.substring(s, F.lit(2), F.length(s)), F.substring(s, F.lit(1), F.length(s) - 1)
        return F.when(begins & ~ends, _trim(first)).when(ends & ~begins, _trim(last)).otherwise(s)

    return F.aggregate(F.flatten(F.array_repeat(pairs, F.length(text) + 1)), _trim(text), step)


def clean_person(name: Column) -> Column:
    """A person's name without marks, odd brackets and trailing particles; at least one character stays."""
    bare = without_odd_brackets(F.btrim(name, F.lit(PERSON_MARKS)))
    return _trim(F.regexp_replace(bare, f"(?s)(?<=.)[{L.PERSON_TAILS}]+$", ""))


def _without_narrative(name: Column) -> Column:
    """Verbs before an organization and "person and" go, again and again."""
    surface = any_of(L.ORG_SURFACES)

    def step(a: Column, _: Column) -> Column:
        return F.when(a["done"], a).otherwise(_let(a["s"], lambda s: _let(once(s), lambda t: F.struct(t.alias("s"), (t == s).alias("done")))))

    def once(s: Column) -> Column:
        stripped = F.btrim(F.regexp_replace(s, NARRATIVE, ""), F.lit(MARKS))
        person, rest = F.regexp_extract(s, WITH_PERSON, 1), F.btrim(F.regexp_extract(s, WITH_PERSON, 2), F.lit(MARKS))
        joined = s.rlike(WITH_PERSON) & (rest != "") & ~person.rlike(surface) & rest.rlike(surface)
        return F.when(stripped != s, stripped).when(joined, rest).otherwise(s)

    start = F.struct(name.alias("s"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.length(name) + 1), start, step, lambda a: a["s"])


def clean_organization(name: Column) -> Column:
    """An organization's own name: without party roles, joints, narrative before it, odd brackets and a doubled legal
    form; empty when nothing of its own is left."""
    balanced = lambda s: (F.regexp_count(s, F.lit("（")) == F.regexp_count(s, F.lit("）"))) & (F.regexp_count(s, F.lit(r"\(")) == F.regexp_count(s, F.lit(r"\)")))
    trim = lambda s: F.btrim(s, F.lit(MARKS))
    single = F.regexp_replace(without_odd_brackets(F.btrim(name, F.lit(MARKS + "（）()"))), "(有限责任公司|股份有限公司|集团有限公司|有限公司)公司$", "$1")
    shaped = _let(trim(single), lambda s: F.when(balanced(s), s).otherwise(without_odd_brackets(s)))
    no_role = trim(F.regexp_replace(shaped, "^" + any_of(L.PARTY_ROLES), ""))
    own = _let(trim(F.regexp_replace(no_role, "^" + any_of(L.NAME_JOINTS), "")), _without_narrative)

    def kept(s: Column) -> Column:
        core = F.regexp_replace(s, any_of(sorted(L.ORG_ENDINGS, key=len, reverse=True)) + "$", "")
        empty = (core == "") | core.rlike("^名" + any_of(L.PROVINCE_NAMES)) | s.rlike("^[一-龥]{2,12}(?:市)?分公司$") | s.isin("公司", "该公司", "本公司", "分公司")
        return F.when(empty, "").otherwise(s)

    return _let(own, kept)
