"""Personal data: fixed patterns against plain regular expressions, proposals and trees against plain versions, held-out accuracy."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from inkveil.llm import boosting, pii
from inkveil.llm.queries import QUERIES
from inkveil.llm.spans import located, scan

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(kind, m[0])]
    return sorted(found)


def texts():
    rng = random.Random(7)
    signs = ["1", "22", "4111", "255", "256", ".", "..", " ", "-", "+", "+1", "(", ")", "@", "a", "b.c", "%", "é", "😀", "\n", "4111111111111111", "4012 8888 8888 1881", "000", "at", "dot", "192.168.1.", "x_y"]
    fixed = [
        None, "", " ", "a@b.c_d@e.f.g@h", "1.2.3.4.5.6.7.8", "001.0002.3.255", "1.2.3.256 300.1.1.1", "+1 (509) 555-6973 and +49.30.1234567-", "+1 (826) 555-4081 190.137.223.204", "4111 1111 1111 1111, 4111-1111-1111-1112",
        "9" * 20000, "a" * 20000 + "@", "1." * 5000, "x@" + "a.b-" * 8000 + "c", "1-" * 9000, "é😀 me@host.de 😀", "12  34 5", "call (509) 555-6973 now", "mail anna at example dot com please", "+" * 3000,
    ]
    return fixed + ["".join(rng.choices(signs, k=rng.randint(1, 40))) for _ in range(400)]


@pytest.fixture(scope="module")
def model(spark):
    return pii.train_pii(spark)


def test_base_spans_equal_plain_patterns_and_added_ones_touch_nothing(spark, model):
    data = [*enumerate(texts()), (None, "me@x.org"), (None, None), (3, texts()[3])]
    clash = ("base", "found", "row", "kind", "start", "x")
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in clash}).repartition(3)
    got = pii.find_pii(docs, model)
    assert got.columns == [*docs.columns, "base_spans", "spans"]
    rows = got.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows) == sorted((i is None, i or 0, t or "") for i, t in data)
    for r in rows:
        assert [tuple(x) for x in r.base_spans] == brute(r.text), r.text[:80]
        fixed = [tuple(x) for x in r.base_spans]
        added = [tuple(x) for x in r.spans if tuple(x) not in fixed]
        assert sorted(fixed + added) == [tuple(x) for x in r.spans] and all(r[c] == c for c in clash)
        for n, (a, _, b) in enumerate(added):
            assert all(y <= a or b <= x for x, _, y in [*fixed, *added[n + 1 :]])
    assert pii.find_pii(docs.limit(0), model).count() == 0
    by_text = {r.text: [(pii.KINDS[x.kind], r.text[x.start : x.end]) for x in r.spans] for r in rows if r.text}
    assert by_text["call (509) 555-6973 now"] == [("local_phone", "(509) 555-6973")]
    assert by_text["mail anna at example dot com please"] == [("masked_email", "anna at example dot com")]
    assert ("local_phone", "(826) 555-4081") in by_text["+1 (826) 555-4081 190.137.223.204"]


def test_query_renders_the_spans_of_whole_texts(spark, tmp_path):
    data = list(enumerate(t for t in texts()[:60]))
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in data], pa.int64()), "text": [t for _, t in data], "base": ["x"] * len(data)}), tmp_path / "documents.parquet")
    rows = QUERIES["op13_pii_boosting"](spark, str(tmp_path)).collect()
    assert len(rows) == len(data)
    for r in rows:
        spans = brute(data[r.doc_id][1])
        text = ",".join(f"{list(PLAIN)[k]}:{a}:{b}" for a, k, b in spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in spans) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_held_out_samples(spark, model):
    samples = pii.labelled_samples(spark, 6000).where("id >= 3000 and floor(id / 10) % 2 = 1")
    seen = {k: [0, 0, 0] for k in range(len(pii.GENERATORS))}
    for r in pii.find_pii(samples, model).select("start", "end", "kind", "spans").collect():
        found = {(x.start, x.end) for x in r.spans if x.kind >= len(pii.BASE)}
        right, based = (r.start, r.end) in found, any(x.kind < len(pii.BASE) for x in r.spans)
        if r.start is not None and not based:
            seen[r.kind][0 if right else 1] += 1
        seen[r.kind][2] += len(found) - right
    for k, (hit, missed, wrong) in seen.items():
        assert hit >= 0.9 * (hit + wrong), (list(pii.GENERATORS)[k], hit, missed, wrong)
    assert sum(s[0] for s in seen.values()) >= 0.75 * sum(s[0] + s[1] for s in seen.values()), seen


def test_the_likeliest_of_overlapping_proposals_stays(spark, model):
    text = "ssn 219-21-1006 42, call 219-21-1006, iban DE89370400440532013000 card 4111.1111.1111.1111 " * 30
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    row = spark.createDataFrame([(text,)], "text string").select(pii.proposals(F.col("text"), none).alias("found")).select("found", pii._chosen(F.col("found"), model).alias("chosen")).first()
    score = model.trees.scores(np.array([x.features for x in row.found]))
    able = [(s, x.end - x.start, -x.start, -x.kind, x) for s, x in zip(score, row.found, strict=True) if s >= model.least[x.kind]]
    keep = [a for a in able if not any(b[:4] > a[:4] and b[4].start < a[4].end and a[4].start < b[4].end for b in able)]
    assert [(x.start, x.kind, x.end) for x in row.chosen] == sorted((x.start, x.kind + len(pii.BASE), x.end) for *_, x in keep)
    assert len(keep) > 50 and len(able) > len(keep)


def test_trees_as_a_column_equal_trees_on_the_driver(spark):
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 6, (300, 5))
    truth = ((rows[:, 0] > 2) & (rows[:, 3] < 4)) | (rows[:, 1] == 5)
    trees = boosting.fit_trees(rows, truth * 3, ~truth * 2)
    scores = trees.scores(rows)
    assert ((scores > 0) == truth).mean() > 0.97
    frame = spark.createDataFrame([(i, [int(v) for v in r]) for i, r in enumerate(rows)], "i int, f array<int>")
    got = {r.i: r.s for r in frame.select("i", boosting.score(trees, F.col("f")).alias("s")).collect()}
    assert np.allclose([got[i] for i in range(len(rows))], scores)
    empty = boosting.fit_trees(np.zeros((0, 5), int), np.zeros(0, int), np.zeros(0, int))
    assert frame.select(boosting.score(empty, F.col("f")).alias("s")).first().s == 0.0
    least = boosting.least_scores(np.array([0] * 4 + [1]), np.array([3.0, 2.0, 2.0, 1.0, 9.0]), np.array([60, 20, 0, 0, 3]), np.array([0, 0, 1, 60, 0]), 2, 0.95)
    assert least == [2.0, float("inf")]


def test_model_without_samples_adds_nothing(spark):
    model = pii.train_pii(spark, pii.labelled_samples(spark, 10).limit(0))
    docs = spark.createDataFrame([(1, "call (509) 555-6973 or a@b.cd")], "doc_id int, text string")
    row = pii.find_pii(docs, model).first()
    assert row.spans == row.base_spans and len(row.spans) == 1


def test_located_and_scan(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("ab1é😀 ", k=rng.randint(0, 60))) for _ in range(60)]
    frame = spark.createDataFrame([(w,) for w in words], "t string")
    for r in frame.select("t", located(F.col("t"), "(a+)b?", 1).alias("x")).collect():
        want = [(m.start(), m.end(), m[1]) for m in re.finditer("(a+)b?", r.t)]
        assert [(x.start, x.end, x.value) for x in r.x] == want
        for i, x in enumerate(r.x):
            begin, end = (r.x[i - 1].end if i else 0), (r.x[i + 1].start if i + 1 < len(r.x) else len(r.t))
            assert (x.before, x.after) == (r.t[max(begin, x.start - 40) : x.start], r.t[x.end : min(end, x.end + 40)])
    lists = [[rng.randint(-9, 9) for _ in range(n)] for n in (0, 1, 2, 3, 8, 9, 31, 64, 100)]
    got = spark.createDataFrame([(v,) for v in lists], "v array<int>").select("v", scan(F.col("v"), lambda a, b: a + b, F.lit(0)).alias("s"), scan(F.col("v"), F.greatest, F.lit(-99)).alias("m")).collect()
    for r in got:
        assert r.s == np.cumsum(r.v).tolist() and r.m == (np.maximum.accumulate(r.v).tolist() if r.v else [])


def test_main_path_runs_no_python(spark, model):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id int, text string")
    plan = pii.find_pii(docs, model)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
