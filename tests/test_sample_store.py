"""The store of samples: every batch once, whatever the order of its rows, only touched buckets rewritten."""

import random

import pytest
from pyspark.sql import functions as F

from inkveil.streaming import sample_store as S

SCHEMA = "k string, n int, t int, v string, gone boolean"


def rows(seed, n=60):
    rng = random.Random(seed)
    return [(rng.choice("abcdefghij"), seed * 1000 + i, rng.randint(0, 99), rng.choice("xyz"), rng.random() < 0.2) for i in range(n)] + [(None, 0, 0, "x", False)]


def want(batches, tombstones=False):
    by = {}
    for r in (r for b in batches for r in b if r[0] is not None):
        by.setdefault(r[0], []).append(r)
    out = {}
    for k, own in by.items():
        last = max(own, key=lambda r: (r[2], r[1]))
        if tombstones or not last[4]:
            out[k] = (last[1], last[2], last[3], min(r[2] for r in own), max(r[2] for r in own))
    return out


def state(spark, root, **kind):
    return {r.k: (r.n, r.t, r.v, r.first_seen_at, r.last_seen_at) for r in S.read_store(spark, root, **kind).collect()}


def merge(spark, data, batch_id, root):
    return S.merge_batch(spark.createDataFrame(data, SCHEMA), batch_id, root, "k", ["t", "n"], "t", "gone", 8)


def test_replays_and_broken_batches_change_nothing(spark, tmp_path):
    root, batches = f"file://{tmp_path}/store", [rows(1), rows(2), rows(3)]
    with pytest.raises(ValueError):
        S.read_store(spark, root)
    for i, b in enumerate(batches):
        assert merge(spark, b, i, root)
        before = state(spark, root)
        assert before == want(batches[: i + 1]) and state(spark, root, tombstones=True) == want(batches[: i + 1], True)
        assert not merge(spark, rows(9), i, root) and state(spark, root) == before
    spark.createDataFrame(rows(7), SCHEMA).withColumn("bucket", F.lit(1)).write.partitionBy("bucket").parquet(f"{root}/data/v=3")  # broken off before its commit
    assert state(spark, root) == before
    assert merge(spark, rows(4), 3, root) and state(spark, root) == want([*batches, rows(4)])
    assert merge(spark, [], 4, root) and state(spark, root) == want([*batches, rows(4)])


def test_only_touched_buckets_are_rewritten_and_old_versions_go(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    merge(spark, rows(1), 0, root)
    versions = S._committed(spark, root)
    merge(spark, [("a", 1, 500, "late", False)], 1, root)
    after = S._committed(spark, root)
    assert sum(after[b] != versions[b] for b in versions) == 1 and len(list((tmp_path / "store/data/v=1").glob("bucket=*"))) == 1
    merge(spark, rows(2, 400), 2, root)
    merge(spark, [("a", 1, 600, "later", True)], 3, root)
    before = state(spark, root)
    assert "a" not in before and S.vacuum(spark, root, keep=1) == [0, 1] and state(spark, root) == before
    merge(spark, [("a", 1, 550, "too late", False)], 4, root)
    assert "a" not in state(spark, root) and state(spark, root, tombstones=True)["a"][2] == "later"


def test_a_stream_of_batches(spark, tmp_path):
    source, root = tmp_path / "in", f"file://{tmp_path}/store"
    data = [rows(1), rows(2)]
    for i, b in enumerate(data):
        spark.createDataFrame(b, SCHEMA).coalesce(1).write.parquet(f"file://{source}/{i}")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"file://{source}/*")
    for _ in range(2):
        query = S.store_samples(read(), root, f"file://{tmp_path}/checkpoint", "k", ["t", "n"], "t", "gone", 8)
        assert query.awaitTermination(120) and query.exception() is None
        assert state(spark, root) == want(data)
    assert S._versions(spark, root) == [0, 1]
