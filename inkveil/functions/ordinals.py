"""Running ordinals of masks: ten stems, then plain numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STEMS = "甲乙丙丁戊己庚辛壬癸"


def ordinal_text(n: Column) -> Column:
    """1 to 10 as stems, larger numbers in digits."""
    return F.when(n <= len(STEMS), F.substring(F.lit(STEMS), n.cast("int"), F.lit(1))).otherwise(n.cast("string"))


def ordinal_index(value: Column) -> Column:
    """The inverse of :func:`ordinal_text`; 0 for anything else."""
    place = F.locate(value, F.lit(STEMS)) if isinstance(value, str) else F.position(value, F.lit(STEMS))
    return F.when(F.length(value) == 1, F.when(place > 0, place).when(value.rlike("^[0-9]$"), value.cast("int")).otherwise(0)).when(value.rlike("^[0-9]{2,9}$"), value.cast("int")).otherwise(0)
