"""Groups of mappings that name one subject: connected components of must-link edges within each map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.shared import drop_shared, shared_dir

MOST_ROUNDS = 60


def _round(links: DataFrame, key: str) -> DataFrame:
    """Links (key, a, b), a < b, after a large-star and a small-star step: first every node's larger neighbours, then
    every node and its smaller neighbours are linked to the least of its neighbourhood."""
    both = links.unionByName(links.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(key, "a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    large = both.where("b > a").join(least, [key, "a"]).where("low <> b").select(key, F.col("low").alias("a"), "b").distinct()
    lowest = large.groupBy(key, "b").agg(F.min("a").alias("low"))
    moved = large.join(lowest, [key, "b"]).where("a <> low").select(key, F.col("low").alias("a"), F.col("a").alias("b"))
    return moved.unionByName(lowest.select(key, F.col("low").alias("a"), "b")).distinct()


def alias_components(edges: DataFrame, key: str = "map_id") -> DataFrame:
    """(key, node, component): the least node that edges (key, a, b) lead to, itself included.

    Every round's links are written to shared storage; only their number and a checksum come to the driver. At the end
    each component is a star around its least node.
    """
    spark = edges.sparkSession
    ends = edges.select(key, F.col("a").alias("node")).unionByName(edges.select(key, F.col("b").alias("node"))).distinct()
    path, before = shared_dir(spark), None
    start = edges.where("a <> b").select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    start.write.parquet(path)
    for _ in range(MOST_ROUNDS):
        links = spark.read.schema(start.schema).parquet(path)
        mark = links.agg(F.count("*"), F.bit_xor(F.xxhash64(key, "a", "b"))).first()
        if mark == before or not mark[0]:
            break
        before, following = mark, shared_dir(spark)
        _round(links, key).write.parquet(following)
        drop_shared(spark, path)
        path = following
    else:
        raise RuntimeError("components did not settle")
    labels = links.select(key, F.col("b").alias("node"), F.col("a").alias("label"))
    return ends.join(labels, [key, "node"], "left").select(key, "node", F.coalesce("label", "node").alias("component"))
