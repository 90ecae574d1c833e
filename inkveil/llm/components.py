"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.storage import drop_shared, join_classes, shared_dir

MOST_ROUNDS = 60


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node's larger neighbours are linked to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("degree"))
    return join_classes(both.where("b > a"), least, "a", "degree", 2 * n).select(F.col("m").alias("a"), "b").where("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours are linked to the least of them. Edges have a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("degree"))
    moved = join_classes(edges, least, "b", "degree", n).where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(least.select(F.col("m").alias("a"), "b"))


def min_labels(links: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of ``links`` (a, b). No links: no rows.

    Each round's edges are written to shared storage, so lineage stays short; only a count and a checksum of them come
    to the driver. Rounds grow with the logarithm of a component's size. Nodes with a great share of all links are
    joined by broadcast.
    """
    spark = links.sparkSession
    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    path, before = shared_dir(spark), None
    edges.distinct().write.parquet(path)
    for _ in range(MOST_ROUNDS):
        edges = spark.read.schema(links.select("a", "b").schema).parquet(path)
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == before or not mark[0]:
            break
        before, following = mark, shared_dir(spark)
        _small_star(_large_star(edges, mark[0]).distinct(), mark[0]).distinct().write.parquet(following)
        drop_shared(spark, path)
        path = following
    else:
        raise RuntimeError("components did not settle")
    label = edges.select(F.col("b").alias("node"), F.col("a").alias("label"))
    return label.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
