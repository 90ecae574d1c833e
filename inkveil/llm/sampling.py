"""Bounded samples of labelled texts for fitting models on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.storage import materialize

MARGIN = 1.5


def pick_ids(known: DataFrame, per_class: int) -> DataFrame:
    """(id, label, nth): the first ``per_class`` ids of each label in the order of a hash, from rows (id, label).

    The hash thins each label to some MARGIN times that number before anything is sorted. Repeated rows count once.
    """
    mark = F.xxhash64("id", "label")
    share = {r[0]: r[1] for r in known.groupBy("label").agg(F.approx_count_distinct(F.xxhash64("id")).alias("n")).collect()}
    thin = F.lit(False)
    for label, n in share.items():
        thin = thin | ((F.col("label") == label) & (F.pmod(mark, F.lit(1 << 30)) / (1 << 30) < MARGIN * per_class / n))
    order = Window.partitionBy("label").orderBy("mark", "id")
    few = known.where(thin).select("id", "label", mark.alias("mark")).distinct()
    return few.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_class).select("id", "label", "nth")


def sample_texts(rows: DataFrame, picked: DataFrame, most_bytes: int) -> list[tuple]:
    """(text, label) of the ``picked`` ids, from rows (id, text) or (id, label, text); at most ``most_bytes`` of each label.

    Texts are taken in the order of ``nth`` whatever their length; one that does not fit in what is left of the bytes is
    passed over, and when none fits the first is taken alone. Null and empty texts are left out; an id with several
    texts gives its least one.
    """
    own = picked.select(F.col("id").alias("wanted_id"), F.col("label").alias("wanted_label"), "nth")
    same = F.col("id").eqNullSafe(F.col("wanted_id"))
    if "label" in rows.columns:
        same = same & (F.col("label") == F.col("wanted_label"))
    met = rows.where(F.length("text") > 0).join(F.broadcast(own), same).select(F.col("wanted_label").alias("label"), "nth", "text")
    held = materialize(met.groupBy("label", "nth").agg(F.min("text").alias("text")))
    sizes = held.select("label", "nth", F.octet_length("text")).orderBy("label", "nth").collect()
    used: dict = {}
    wanted = []
    for label, nth, size in sizes:
        if used.get(label, 0) + size <= most_bytes:
            used[label] = used.get(label, 0) + size
            wanted.append((label, nth))
    for label, nth, _ in sizes:
        if label not in used:
            used[label] = 0
            wanted.append((label, nth))
    if not wanted:
        return []
    chosen = F.lit(False)
    for label in used:  # a list of rows would be made a table by Python workers, and be broadcast
        nths = F.split(F.lit(",".join(str(n) for x, n in wanted if x == label)), ",").cast("array<int>")
        chosen = chosen | ((F.col("label") == F.lit(label)) & F.array_contains(nths, F.col("nth")))
    got = held.where(chosen).orderBy("label", "nth").collect()
    return [(r["text"], r["label"]) for r in got]
