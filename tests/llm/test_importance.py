"""Importance resampling against a plain version and its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkveil.llm import importance
from inkveil.llm.queries import ORACLES, QUERIES
from tests.compare import both


def runs(text, most):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, most, buckets, percent, least):
    place = lambda run: zlib.crc32(run.encode()) % buckets
    mine = [(i, *runs(t, most)) for i, t in docs]
    s, t = Counter(place(x) for _, _, r in mine for x in r), Counter(place(x) for text in target for x in runs(text, most)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    out = []
    for i, n, r in mine:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(place(x)) for x in r)
        out.append((i, n, len(r), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    drawn = Counter((*x, rank + 1) for rank, x in enumerate(able[: percent * len(able) // 100]))
    rest = Counter((*x, None) for x in [*able[percent * len(able) // 100 :], *(x for x in out if x[1] < least)])
    return drawn + rest


def rows(n=120):
    rng, words = np.random.default_rng(4), "The alpha ÉTÉ Beta-gamma x1y 日本語 don't_know 42 of".split()
    docs = [(i, " ".join(rng.choice(words, rng.integers(0, 60)))) for i in range(n)]
    odd = [None, "", "   ", "A" * 5000, "ÀB\x00c İ", "-- !!", "one " * 30]
    return docs + [(500 + i, t) for i, t in enumerate(odd)] + [docs[5], docs[5], (7, "another text " * 20), (None, "no id " * 15), (None, None)]


@pytest.mark.parametrize(("most", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 97, 50, 5), (1, 10, 100, 0)])
def test_scores_and_ranks_equal_a_plain_version(spark, most, buckets, percent, least):
    target = ["Alpha of the x1y", None, "", "日本語 of of of", "étÉ gamma"]
    clash = ("id", "place", "part", "rank", "score", "words", "start")
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string").withColumns({c: F.lit("clash") for c in clash}).repartition(3)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, wanted, most=most, buckets=buckets, percent=percent, least_words=least)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows(), target, most, buckets, percent, least)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert importance.resample(none, some).count() == 0
    assert [tuple(r) for r in importance.resample(some, none, least_words=3).select("doc_id", "n_features", "rank").collect()] == [(1, 2, None)]


def test_query_equals_its_sql_on_odd_rows(spark, tmp_path):
    data = [(i, t) for i, t in rows() if i is not None and i != 7] + [(7, "another text " * 20)]
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in data], pa.int64()), "text": [t for _, t in data]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([0, 1], pa.int64()), "text": ["alpha of x1y", None]}), tmp_path / "benchmark.parquet")
    ours, theirs = both(spark, QUERIES["op12_importance_resampling"], ORACLES["op12_importance_resampling"], tmp_path)
    assert ours == theirs and len(ours) > 100


def test_scoring_does_not_explode_and_gains_are_a_literal(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    plan = importance.importance_scores(docs, list(range(importance.BUCKETS)))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "split(0,1" not in plan and "Aggregate" not in plan
