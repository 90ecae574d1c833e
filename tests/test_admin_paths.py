"""Administrative places: intervals of codes, which candidates stay, and ordinals that a code's names share."""

import random
import re

from pyspark.sql import functions as F

from inkveil.functions.ordinals import STEMS
from inkveil.operators import admin_paths as A
from inkveil.plans import fixtures

SCHEMA = "doc_id int, type string, text string, start int, end int, level string, code string, canonical_name string, source string"


def core(name):
    if name.endswith("小镇"):
        return name
    while True:
        cut = next((s for s in ("居民委员会", "村民委员会", "居委会", "村委会", "特别行政区", "自治区", "自治州", "街道", "社区", "省", "市", "区", "县", "旗", "镇", "乡", "村") if name.endswith(s) and len(name) - len(s) >= 2), None)
        if cut is None:
            return name
        name = name[: -len(cut)]


def plain(rows):
    """One candidate after the other, as a reader would do it."""
    direct = {"province", "city", "county", "county_city", "township"}
    kept, by_core, by_code, count, out = [], {}, {}, 0, []

    def ask(name):
        nonlocal count
        c = core(name)
        if c not in by_core:
            count += 1
            by_core[c] = STEMS[count - 1] if count <= 10 else str(count)
        return by_core[c]

    for r in sorted(set(rows), key=lambda r: (r[3], r[4] - r[3], r[4], r[2], r[6] or "")):
        _, kind, text, start, end, level, code, canonical, source = r
        if kind != "location" or not (level in direct if source == "hebei_admin_db" else level in direct - {"township"} and (level != "county" or text.endswith("区"))):
            continue
        if any(end > s and start < e and not (level == own and level in direct) for s, e, own in kept):
            continue
        kept.append((start, end, level))
        match = re.match(r"^([一-龥]+?(?:省|自治区))?([一-龥]+?(?:市|自治州))?([一-龥]+?(?:(?<!社)区|县))?([一-龥]+?(?:街道|镇|乡))?([一-龥]+?(?:居民委员会|居委会|村民委员会|村委会|社区|村))?$", text)
        parts = [p for p in match.groups() if p] if match else []
        ends = lambda t: next((e for e in A.ENDINGS if t.endswith(e)), "")
        fixed = [("村民委员会", "村民委员会"), ("村委会", "村委会"), ("居民委员会", "社区居民委员会"), ("居委会", "社区居委会")]
        suffix = next((m for e, m in fixed if text.endswith(e)), None) or {"community": "社区", "village": "村"}.get(level) or ends(text) or ends(canonical or "") or {"province": "省", "city": "自治州" if (canonical or "").endswith("自治州") else "市", "county_city": "市", "county": "县", "township": "镇"}.get(level, "")
        if len(parts) <= 1 and suffix:
            if not code:
                masked = ask(text) + suffix
            else:
                by_code.setdefault(code, None)
                if by_code[code] is None:
                    by_code[code] = ask(text)
                masked = by_code[code] + suffix
        else:
            names = ["自治区", "省", "自治州", "市", "居民委员会", "居委会", "村民委员会", "村委会", "社区", "区", "县", "街道", "镇", "乡", "村"]
            shown = {"居民委员会": "社区居民委员会", "居委会": "社区居委会"}
            masked = "".join(ask(p) + (lambda e: shown.get(e, e))(next(e for e in names if p.endswith(e))) for p in parts) or text
        out.append((r[0], start, end, text, masked, level, code or "", source))
    return out


def test_masks_equal_a_reading_one_by_one(spark):
    rng = random.Random(11)
    rows = []
    for doc in range(60):
        source = rng.choice(["hebei_admin_db", "china_admin_db"])
        for _ in range(rng.randint(0, 14)):
            text, level, canonical, code = rng.choice(fixtures.ADMIN_PLACES)
            start = rng.randint(0, 60)
            rows.append((doc, rng.choice(["location"] * 9 + ["grassroots_org"]), text, start, start + len(text), level, rng.choice([code, code, None]), rng.choice([canonical, None]), source))
    frame = spark.createDataFrame(rows, SCHEMA).dropDuplicates(["doc_id", "start", "end", "text", "code", "level"])
    rows = [tuple(r) for r in frame.collect()]
    got = sorted(tuple(r) for r in A.mask_admin_places(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    want = sorted(x for doc in range(60) for x in plain([r for r in rows if r[0] == doc]))
    assert got == want and len(got) > 150
    assert A.mask_admin_places(frame.limit(0)).count() == 0


def test_full_and_short_names_share_the_ordinal_of_their_code(spark):
    rows = [(1, "location", "广东省", 0, 3, "province", "44", "广东省", "x"), (1, "location", "深圳", 3, 5, "city", "4403", "广东省深圳市", "x"), (1, "location", "广东", 9, 11, "province", "44", "广东省", "x"), (1, "location", "深圳市", 12, 15, "city", "4403", "", "x"), (1, "location", "鼓楼区", 20, 23, "county", "320106", "", "x"), (1, "location", "鼓楼区", 30, 33, "county", "350102", "", "x")]
    got = [r.masked for r in A.mask_admin_places(spark.createDataFrame(rows, SCHEMA)).orderBy("start").collect()]
    assert got == ["甲省", "乙市", "甲省", "乙市", "丙区", "丙区"]


def test_ancestors_are_the_intervals_that_hold_a_code(spark):
    names = [("11", "一"), ("110000000000", "一"), ("1101", "二"), ("110102", "三"), ("110102003", "四"), ("110102003004", "五"), ("12", "六"), ("1201", "七"), ("130102003000", "八")]
    divisions = spark.createDataFrame(names[1:], "code string, name string")
    rows = spark.createDataFrame([("110102003004",), ("110102003004",), ("1201",), ("120105",), ("130102003001",), ("99",), (None,)], "code string").withColumn("name", F.lit("clash"))
    got = [(r.code, [a.name for a in r.ancestors]) for r in A.with_ancestors(rows, divisions).collect()]
    intervals = {r.code: (r.i.lo, r.i.hi) for r in divisions.select("code", A.code_interval(F.col("code")).alias("i")).collect()}
    assert intervals["1101"] == ("110100000000", "110199999999") and intervals["110102003004"] == ("110102003004",) * 2
    for code, ancestors in got:
        full = (code or "").ljust(12, "0")
        assert ancestors == ([n for c, n in sorted((intervals[c][0], n) for c, n in names[1:] if intervals[c][0] <= full <= intervals[c][1])] if code else []), code
    assert len(got) == 7


def test_a_task_holds_a_bounded_number_of_places(spark, monkeypatch):
    monkeypatch.setattr(A, "TASK_ROWS", 100)
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("location").alias("type"), F.lit("石家庄市").alias("text"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("city").alias("level"), F.lit("").alias("canonical_name"), F.lit("1301").alias("code"), F.lit("hebei_admin_db").alias("source"))
    masked = A.mask_admin_places(rows)
    plan = masked._jdf.queryExecution().executedPlan().toString()
    assert masked.rdd.getNumPartitions() == 10 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
