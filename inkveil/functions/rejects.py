"""Scalar tests that reject captured text that is no person, organization or place."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkveil.functions import lexicon as L
from inkveil.functions.scans import let

PLACE_SUFFIX = "(?:自治区|自治州|街道|社区|省|市|盟|区|县|旗|镇|乡|村)"


def any_of(words: Iterable[str]) -> str:
    """A regular expression for any of the words, which are plain text."""
    return "(?:" + "|".join(words) + ")"


def is_false_person(name: Column, stop_words: tuple[str, ...] = L.NO_PERSON_WORDS) -> Column:
    """Too short or long, figures, a mask in the middle, legal words, particles, place names, verb-like endings."""
    size = F.length(name)
    surname = F.substring(name, 1, 1).rlike(f"[{L.COMMON_SURNAMES}]")
    return (
        ~size.between(2, 20)
        | name.rlike(r"[0-9０-９.%‰万亿元]")
        | (name.contains("某") & ~name.endswith("某"))
        | ((size > 4) & ~name.rlike("[·•]"))
        | name.rlike(any_of(stop_words + L.PERSON_WORKS + L.PERSON_PARTICLES))
        | ((size == 3) & ~surname & name.rlike(f"[{L.PERSON_TAIL_ACTIONS}]$"))
        | ((size <= 3) & (name.rlike(any_of(L.PERSON_SHORT_ENDS) + "$") | name.rlike("^" + any_of(L.PERSON_SHORT_STARTS))))
        | name.rlike("^" + any_of(L.PROVINCE_NAMES))
    )


def _has_action_verb(core: Column) -> Column:
    """A verb is in the core, unless it ends it as the name of a trade."""
    found = core.rlike(any_of(v for v in L.ORG_ACTION_VERBS if v not in L.INDUSTRY_CORE_SUFFIXES))
    for v in L.ORG_ACTION_VERBS:
        if v in L.INDUSTRY_CORE_SUFFIXES:
            found = found | (core.contains(v) & ~(core.endswith(v) & (F.length(core) > len(v) + 1)))
    return found


def is_false_organization(name: Column) -> Column:
    """References to contracts, bare legal forms, odd brackets, sentences, pronouns, verbs, generic brands."""
    return let(name, lambda n: let(F.regexp_extract(n, f"^(.+?){any_of(L.LEGAL_SUFFIXES)}$", 1), lambda core: _is_false(n, core)))


def _is_false(name: Column, core: Column) -> Column:
    brackets = name.rlike("[（）()]") & ~name.rlike("^[一-龥A-Za-z0-9·]+[（(][一-龥A-Za-z0-9·]{2,12}[）)][一-龥A-Za-z0-9·]*(?:有限责任公司|股份有限公司|集团有限公司|有限公司|公司|集团)$")
    generic = let(F.regexp_extract(core, f"^(.+?){any_of(L.NO_BRANDS)}$", 1), lambda g: (g != "") & ((F.length(g) <= 2) | _has_action_verb(g)))
    false_core = (
        core.isin(*L.ORG_CORE_PRONOUNS)
        | (F.length(core) < 2)
        | core.rlike("我|两家|等$|等公司$")
        | core.rlike("(?:省|市|区|县|旗|镇|乡|街道|村|社区)$")
        | (core.rlike("^[一-龥]{2,3}$") & F.substring(core, 1, 1).rlike(f"[{L.COMMON_SURNAMES}]"))
        | _has_action_verb(core)
        | core.isin(*L.NO_BRANDS, *L.NO_ORG_CORES)
        | generic
    )
    bare = name.rlike(any_of(L.ORG_PRONOUNS)) | _has_action_verb(name)
    return (
        name.rlike(r"^合同[一二三四五六七八九十百零\d]+$|系关联公司|^否认其|^否认与")
        | name.isin(*L.LEGAL_SUFFIXES)
        | brackets
        | name.rlike(any_of(L.ORG_SENTENCE_WORDS))
        | F.when(core != "", false_core).otherwise(bare)
    )


def is_false_place(place: Column, before: Column) -> Column:
    """Not a place although it ends like one; ``before`` is the character in front of it, empty at a text's start."""
    lead = any_of(L.PLACE_LEADS)
    bare = F.regexp_replace(place, "^" + lead, "")
    body = F.regexp_replace(place, PLACE_SUFFIX + "$", "")
    committee = bare.rlike("(?:村民委员会|居民委员会|村委会|居委会)$")
    rest = (
        place.isin(*L.PLACE_NO_CORES) | bare.isin(*L.PLACE_NO_CORES, *L.PLACE_GENERIC) | body.isin(*L.PLACE_NO_CORES)
        | place.rlike("^" + any_of(L.PLACE_REFERENCES)) | bare.rlike("^" + any_of(L.PLACE_REFERENCES))
        | bare.rlike(f"^[一-龥]{PLACE_SUFFIX}$") | bare.rlike("^[一-龥]{2,4}村村$")
        | body.rlike(f"[{L.PLACE_NO_CHARS}]")
        | place.rlike("^" + any_of(L.PLACE_NO_STARTS))
        | place.rlike("^" + lead + ".")
        | ((before != "") & before.rlike(f"[{L.PLACE_BEFORE}]"))
        | (place.startswith("某") & place.rlike("(?:省|市|区|县|镇|乡|街道)$"))
    )
    return place.rlike(any_of(L.PLACE_NO_WORDS)) | F.when(committee, bare.isin("村村民委员会", "村村委会", "社区居民委员会", "社区居委会")).otherwise(rest)
