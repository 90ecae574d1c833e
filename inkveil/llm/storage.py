"""Small helpers used by every operator here; tables are written to the folders of :mod:`inkveil.shared`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.shared import drop_shared, materialize, shared_dir

__all__ = ["drop_shared", "id_bucket", "join_classes", "materialize", "shared_dir"]

MOST_HOT, FEW_ROWS = 10_000, 100_000


def id_bucket(id_col: str | Column, modulus: int) -> Column:
    """``crc32(id as text) mod modulus``; the fold a row belongs to (null ids: fold of the empty text)."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``classes`` (one row for each key, its rows counted in ``size``) that no key can overload.

    Classes of more than one in MOST_HOT of all ``total`` rows are MOST_HOT at most: they are broadcast, so their rows stay
    where they are. The rows of the others are joined by key. Of FEW_ROWS rows or fewer all classes are broadcast. Keys
    must not be null.
    """
    if total <= FEW_ROWS:
        return rows.join(F.broadcast(classes), key).drop(size)
    hot = F.col(size) > total // MOST_HOT
    few = F.broadcast(classes.where(hot))
    rest = rows.join(F.broadcast(classes.where(hot).select(key)), key, "left_anti").join(classes.where(~hot), key)
    return rest.unionByName(rows.join(few, key)).drop(size)
