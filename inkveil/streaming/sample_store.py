"""A store of feedback samples that batches of a stream are merged into, each batch once.

Entries lie in hash buckets of their key. A batch reads and rewrites only the buckets that it touches, as a version of
its own, and becomes visible with its commit, which names the version of every bucket. A batch that was broken off before
is written anew; one that was committed before changes nothing. Deleted entries stay as tombstones, so that an older row
that comes late does not bring them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkveil.shared import file_system

BUCKETS = 64
_STATE = ("bucket", "first_seen_at", "last_seen_at", "deleted")


def _versions(spark: SparkSession, root: str) -> list[int]:
    """Batch ids whose commits are whole, in order."""
    system, folder = file_system(spark, f"{root}/_commits")
    if not system.exists(folder):
        return []
    names = [s.getPath() for s in system.listStatus(folder)]
    whole = [p.getName() for p in names if system.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("v=")) for n in whole if n.startswith("v="))


def _committed(spark: SparkSession, root: str) -> dict[int, int]:
    """The version of each bucket in the last commit: one row a bucket."""
    known = _versions(spark, root)
    return {r["bucket"]: r["version"] for r in spark.read.schema("bucket int, version bigint").json(f"{root}/_commits/v={known[-1]}").collect()} if known else {}


def _stored(spark: SparkSession, root: str, versions: dict[int, int]) -> DataFrame | None:
    paths = [f"{root}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
    if not paths:
        return None
    schema = spark.read.parquet(paths[0]).schema
    return spark.read.schema(schema).parquet(*paths)


def merge_batch(batch: DataFrame, batch_id: int, root: str, key: str, order: list[str], time: str, deleted: str | None = None, buckets: int = BUCKETS) -> bool:
    """Merge rows into the store; whether anything was done. Of a key's rows the last in ``order`` stays, with the least and
    greatest ``time`` of all its rows as first_seen_at and last_seen_at; ``deleted`` is a boolean column.

    Rows with a null key are left out. Rows are aggregated before they are shuffled, so a hot key is one row for a task.
    Batch ids must ascend, as a stream's do. Rows must not have columns called like those of the store.
    """
    spark = batch.sparkSession
    if batch_id in _versions(spark, root):
        return False
    versions = _committed(spark, root)
    fields = [c for c in batch.columns if c not in (key, deleted)]
    gone = F.coalesce(F.col(deleted).cast("boolean"), F.lit(False)) if deleted else F.lit(False)
    fresh = batch.where(F.col(key).isNotNull()).withColumns({"bucket": F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"), "first_seen_at": F.col(time), "last_seen_at": F.col(time), "deleted": gone}).select(key, *fields, *_STATE)
    touched = [r[0] for r in fresh.select("bucket").distinct().collect()]  # no more than there are buckets
    old = _stored(spark, root, {b: versions[b] for b in touched if b in versions})
    if old is not None:
        fresh = fresh.unionByName(old.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).select(fresh.columns))
    last = F.max_by(F.struct(*fields, "deleted"), F.struct(*order)).alias("r")
    merged = fresh.groupBy("bucket", key).agg(last, F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at")).select(key, "r.*", "first_seen_at", "last_seen_at", "bucket")
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data/v={batch_id}")
    after = {**versions, **dict.fromkeys(touched, batch_id)}
    listed = spark.range(1).select(F.explode(F.map_from_entries(F.from_json(F.lit("[" + ",".join(f'{{"b":{b},"v":{v}}}' for b, v in sorted(after.items())) + "]"), "array<struct<b:int,v:bigint>>"))).alias("bucket", "version"))
    listed.coalesce(1).write.mode("overwrite").json(f"{root}/_commits/v={batch_id}")
    return True


def read_store(spark: SparkSession, root: str, tombstones: bool = False) -> DataFrame:
    """The entries of the last commit, without deleted ones unless they are asked for. An empty store is refused."""
    stored = _stored(spark, root, _committed(spark, root))
    if stored is None:
        raise ValueError(f"nothing is stored in {root}")
    return stored if tombstones else stored.where("NOT deleted").drop("deleted")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> list[int]:
    """Delete versions that none of the last ``keep`` commits names, and older commits; what was deleted."""
    known = _versions(spark, root)
    kept = known[-keep:] if keep else []
    named = {r["version"] for v in kept for r in spark.read.schema("bucket int, version bigint").json(f"{root}/_commits/v={v}").collect()}
    gone = []
    for v in known:
        if v not in kept:
            system, commit = file_system(spark, f"{root}/_commits/v={v}")
            system.delete(commit, True)
        if v not in named and v not in kept:
            system, data = file_system(spark, f"{root}/data/v={v}")
            system.delete(data, True)
            gone.append(v)
    return gone


def store_samples(stream: DataFrame, root: str, checkpoint: str, key: str, order: list[str], time: str, deleted: str | None = None, buckets: int = BUCKETS, available_now: bool = True) -> StreamingQuery:
    """Merge a stream of sample rows into the store. Root and checkpoint must be on shared storage."""
    merge = lambda batch, batch_id: merge_batch(batch, batch_id, root, key, order, time, deleted, buckets) and None
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
