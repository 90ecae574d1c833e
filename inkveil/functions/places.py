"""Place-name algebra: cores, suffixes, administrative paths. Lists are fixed values in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SUFFIXES = ("居民委员会", "村民委员会", "居委会", "村委会", "特别行政区", "自治区", "自治州", "街道", "社区", "省", "市", "区", "县", "旗", "镇", "乡", "村")
PATH = (
    r"^([一-龥]+?(?:省|自治区|特别行政区))?"
    r"([一-龥]+?(?:市|自治州|地区|盟))?"
    r"([一-龥]+?(?:(?<!社)区|县|旗|市))?"
    r"([一-龥]+?(?:街道|镇|乡))?"
    r"([一-龥]+?(?:居民委员会|居委会|村民委员会|村委会|社区|村))?$"
)
MOST_SUFFIXES = 6


def location_core(name: Column) -> Column:
    """Administrative suffixes stripped from the end while two characters stay; a name in 小镇 is its own core."""
    tail = "(?:" + "|".join(SUFFIXES) + ")"
    core = name
    for _ in range(MOST_SUFFIXES):
        longest = F.regexp_replace(core, rf"^(.{{2,}}?){tail}$", "$1")
        core = longest
    return F.when(name.endswith("小镇"), name).otherwise(core)


def location_suffix(name: Column) -> Column:
    """The first suffix of the list that the name ends with, else 地."""
    out = F.lit("地")
    for s in reversed(SUFFIXES):
        out = F.when(name.endswith(s), F.lit(s)).otherwise(out)
    return out


def is_compound_path(name: Column) -> Column:
    return name.rlike("省|自治区|特别行政区")


def path_parts(name: Column) -> Column:
    """The five levels of an administrative path, null where a level is missing; an array of nulls if it is no path."""
    part = lambda k: F.nullif(F.regexp_extract(name, PATH, k), F.lit(""))
    return F.array(*(part(k) for k in range(1, 6)))


def masked_part(part: Column, prefix: Column) -> Column:
    """A path level with its name replaced by ``prefix``, its kind kept."""
    kinds = (
        ("特别行政区", "特别行政区"), ("自治区", "自治区"), ("省", "省"), ("自治州", "自治州"), ("地区", "盟"), ("盟", "盟"), ("市", "市"),
        ("社区居民委员会", "社区居民委员会"), ("居民委员会", "社区居民委员会"), ("居委会", "社区居委会"), ("村民委员会", "村民委员会"), ("村委会", "村委会"),
        ("社区", "社区"), ("区", "区"), ("县", "县"), ("旗", "旗"), ("街道", "街道"), ("镇", "镇"), ("乡", "乡"), ("村", "村"),
    )
    out = F.lit("")
    for ending, kind in reversed(kinds):
        out = F.when(part.endswith(ending), F.lit(kind)).otherwise(out)
    return F.concat(prefix, out)
