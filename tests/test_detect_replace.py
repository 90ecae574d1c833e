"""Identifiers, replacement, restoration and leaks on literal texts."""

import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from inkveil.functions import identifiers, ordinals, places, spans
from inkveil.operators import detect, replace
from inkveil.plans.oracles import ORACLES
from inkveil.plans.queries import QUERIES
from inkveil.plans.redaction import redact_identifiers

ID = "110101199003074514"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def found(spark, text, *types):
    rows = detect.detect(docs(spark, text), types=types or tuple(identifiers.DETECTORS)).collect()
    for r in rows:
        assert text[r.start : r.end] == r.text
    return [(r.type, r.text) for r in rows]


def test_phones(spark):
    assert found(spark, "a 138 0013 8000, b 138-0013-8000, c +86 13800138000, d 1380013800") == [("phone", "138 0013 8000"), ("phone", "138-0013-8000"), ("phone", "+86 13800138000")]


def test_labels_belong_to_the_identifier(spark):
    assert found(spark, f"😀公民身份号码{ID}，案号（2024）冀01民初123号") == [("id_number", "公民身份号码" + ID), ("case_number", "（2024）冀01民初123号")]
    text = "银行账号6222021234567890123 统一社会信用代码91130100MA07XYQA1B 邮箱a.b@example.com。"
    assert found(spark, text) == [("unified_social_credit_code", "统一社会信用代码91130100MA07XYQA1B"), ("bank_account", "银行账号6222021234567890123"), ("email", "邮箱a.b@example.com")]


def test_an_id_is_neither_bank_account_nor_credit_code(spark):
    assert found(spark, ID) == [("id_number", ID)]
    assert found(spark, "张三在石家庄市工作") == []


def test_trailing_separators_are_trimmed(spark):
    assert found(spark, "6222 0212 3456 7890 ok", "bank_account") == [("bank_account", "6222 0212 3456 7890")]


def test_null_texts_and_profiles(spark):
    assert detect.detect(docs(spark, None, "")).count() == 0
    rows = detect.detect(docs(spark, f"{ID} a@b.cc"))
    assert [r.type for r in detect.allowed(rows, detect.PROFILES["minimal"]).collect()] == ["id_number"]
    assert detect.allowed(rows, detect.PROFILES["max"]).count() == 2


def test_case_numbers_swap_provinces_consistently(spark):
    swap = lambda t, seed=0: spark.range(1).select(identifiers.map_case_number(F.lit(t), seed)).first()[0]
    assert swap("（2024）最高法民终1号") == "（2024）最高法民终1号"
    once = swap("（2024）冀01民初2号")
    assert once != "（2024）冀01民初2号" and swap("（2023）冀09民终9号")[6] == once[6]
    assert len({swap(f"（2024）{p}01民初2号")[6] for p in identifiers.PROVINCES}) == len(identifiers.PROVINCES)


def test_end_to_end(spark):
    text = f"原告{ID}，电话13800138000，（2024）冀01民初2号\n审判长  张三\n书记员 李四\n正文"
    r = redact_identifiers(docs(spark, text)).first()
    assert ID not in r.redacted and "13800138000" not in r.redacted and "冀" not in r.redacted and "审判长" not in r.redacted and r.redacted.endswith("正文")
    assert {m.masked for m in r.mappings} >= {"***"}
    assert [x.type for x in r.leaks] == ["case_number"]  # a swapped case number still looks like one


MAP = "ord int, type string, original string, masked string"


def test_longest_first_is_not_leftmost_first(spark):
    m = spark.createDataFrame([(0, "x", "AB", "1"), (1, "x", "BCD", "2"), (2, "x", "", "3")], MAP)
    got = [r.redacted for r in replace.apply_mappings(docs(spark, "ABCD", "AB ABCD", None), m).collect()]
    assert got == ["A2", "1 A2", None]


def test_masks_are_not_replaced_again(spark):
    m = spark.createDataFrame([(0, "x", "ab", "cd"), (1, "x", "cd", "ab")], MAP)
    assert replace.apply_mappings(docs(spark, "abcd"), m).first().redacted == "cdab"


def reference_replace(text, entries):
    """Longest first over the whole text, found from every place on, never in what is taken."""
    taken, chosen = [], []
    for key, value in sorted((e for e in entries if e[0]), key=lambda e: -len(e[0])):
        for at in range(len(text)):
            if text.startswith(key, at) and not any(at < e and s < at + len(key) for s, e in taken):
                taken.append((at, at + len(key))), chosen.append((at, at + len(key), value))
    for s, e, value in sorted(chosen, reverse=True):
        text = text[:s] + value + text[e:]
    return text


def test_digits_and_private_use_characters_are_replaced_exactly(spark, monkeypatch):
    rng = random.Random(2)
    letters = ["0", "1", "a", "b", "\ue000", "\ue001", "\ue002", "\ue00c", "\ue010", "\ue018", "甲", "😀"]
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    for _ in range(4):
        keys = list(dict.fromkeys(word(rng.randint(1, 4)) for _ in range(14)))
        entries = [(k, word(rng.randint(0, 3))) for k in keys]
        texts = ["", *(word(rng.randint(1, 40)) for _ in range(60)), "abc lives at 0 abc", "\ue000\ue002\ue001"]
        m = spark.createDataFrame([(i, "x", k, v) for i, (k, v) in enumerate(entries)], MAP)
        want = [reference_replace(t, entries) for t in texts]
        for most in (64, 0):
            monkeypatch.setattr(replace, "JVM_ENTRIES", most)
            assert [r.redacted for r in replace.apply_mappings(docs(spark, *texts), m).orderBy("doc_id").collect()] == want
        keyed = m.crossJoin(spark.range(len(texts)).withColumnRenamed("id", "doc_id"))
        for guard in (True, False):
            assert [r.redacted for r in replace.apply_mappings(docs(spark, *texts), keyed, on="doc_id", guard=guard).orderBy("doc_id").collect()] == want


def test_round_trip_with_digits(spark):
    m = spark.createDataFrame([(0, "x", "abc", "【0】"), (1, "x", "0", "【1】"), (2, "x", "ab", "【2】")], MAP + "").withColumn("restore_original", F.lit(None).cast("string"))
    texts = ["abc lives at 0 abc", "ab0abc00", "\ue000\ue002\ue001 0"]
    red = replace.apply_mappings(docs(spark, *texts), m)
    assert [r.redacted for r in red.orderBy("doc_id").collect()][:2] == ["【0】 lives at 【1】 【0】", "【2】【1】【0】【1】【1】"]
    assert [r.restored for r in replace.restore(red, m).orderBy("doc_id").collect()] == texts


def test_what_follows_an_alias_is_read_from_the_text_itself(spark):
    m = spark.createDataFrame([(0, "organization", "华为", "甲"), (1, "organization", "技术有限公司", "乙"), (2, "individual_business", "小米", "丙")], MAP)
    got = [r.redacted for r in replace.apply_mappings(docs(spark, "华为技术有限公司", "华为和", "小米星辰集团，小米"), m).orderBy("doc_id").collect()]
    assert got == ["华为乙", "甲和", "小米星辰集团，丙"]


def test_short_alias_stays_inside_a_longer_company(spark):
    m = spark.createDataFrame([(0, "organization", "华为", "甲公司")], MAP)
    assert replace.apply_mappings(docs(spark, "华为，华为技术有限公司"), m).first().redacted == "甲公司，华为技术有限公司"
    assert replace.apply_mappings(docs(spark, "华为，华为技术有限公司"), m, guard=False).first().redacted == "甲公司，甲公司技术有限公司"


def test_maps_keyed_by_document(spark):
    m = spark.createDataFrame([(0, 0, "x", "a", "1"), (1, 0, "x", "a", "2")], "doc_id bigint, " + MAP)
    assert {r.doc_id: r.redacted for r in replace.apply_mappings(docs(spark, "a", "a", "a"), m, on="doc_id").collect()} == {0: "1", 1: "2", 2: "a"}


def test_shared_maps_have_a_checked_size(spark, monkeypatch):
    monkeypatch.setattr(replace, "BROADCAST_MAPPINGS", 1)
    with pytest.raises(ValueError):
        replace.apply_mappings(docs(spark, "a"), spark.createDataFrame([(0, "x", "a", "1"), (1, "x", "b", "1")], MAP))


def test_restore_prefers_the_primary_text_and_else_the_last(spark):
    rows = [(0, "x", "甲方公司", "M", "甲方有限公司"), (1, "x", "甲方", "M", None), (2, "x", "p", "N", None), (3, "x", "q", "N", None)]
    m = spark.createDataFrame(rows, MAP + ", restore_original string")
    done = docs(spark, "M N").withColumnRenamed("text", "redacted")
    assert replace.restore(done, m).first().restored == "甲方有限公司 q"
    assert {r.masked: r.ambiguous for r in replace.restore_lookup(m).collect()} == {"M": True, "N": True}


def test_unresolved_placeholders_and_counts(spark):
    m = spark.createDataFrame([(0, "x", "a", "甲"), (1, "x", "b", "乙")], MAP)
    d = docs(spark, "甲甲 【未知】", "")
    assert {r.placeholder for r in replace.unresolved_placeholders(d, m, text_col="text").collect()} == {"甲", "【未知】"}
    assert [(r.masked, r.n) for r in replace.placeholder_counts(d, m, text_col="text").collect()] == [("甲", 2)]


def test_highlight_escapes(spark):
    m = spark.createDataFrame([(0, "x", "a&b", "甲")], MAP)
    assert replace.highlight(docs(spark, "<a&b>"), m).first().html == "&lt;<mark>a&amp;b</mark>&gt;"


def test_occurrences(spark):
    one = lambda t, w, o: spark.range(1).select(spans.occurrences(F.lit(t), F.lit(w), o)).first()[0]
    assert one("aaaa", "aa", True) == [0, 1, 2] and one("aaaa", "aa", False) == [0, 2]
    assert one("😀ab\\Eab", "ab", True) == [1, 5] and one("x", "", True) == [] and one("a\\Eb", "\\E", True) == [1]


def test_trace_is_cut_at_twenty(spark):
    r = replace.trace_positions(docs(spark, "ab" * 30), spark.createDataFrame([(0, "x", "ab", "1")], MAP)).first()
    assert r.n == 30 and r.truncated and r.positions == list(range(0, 40, 2))


def test_ordinals_and_places(spark):
    rows = spark.createDataFrame([(1,), (10,), (11,)], "n int").select(ordinals.ordinal_text(F.col("n")).alias("o"), "n")
    assert [r.o for r in rows.collect()] == ["甲", "癸", "11"]
    assert [r[0] for r in rows.select(ordinals.ordinal_index(F.col("o"))).collect()] == [1, 10, 11]
    names = spark.createDataFrame([(n,) for n in ("石家庄市", "河北省", "某小镇", "建北街道社区居委会", "长安区", "县城")], "t string")
    assert [tuple(r) for r in names.select(places.location_core(F.col("t")), places.location_suffix(F.col("t"))).collect()] == [
        ("石家庄", "市"), ("河北", "省"), ("某小镇", "镇"), ("建北", "居委会"), ("长安", "区"), ("县城", "地"),
    ]
    parts = spark.range(1).select(places.path_parts(F.lit("河北省石家庄市长安区建北街道棉一社区"))).first()[0]
    assert parts == ["河北省", "石家庄市", "长安区", "建北街道", "棉一社区"]
    masked = spark.createDataFrame([(p,) for p in parts], "p string").select(places.masked_part(F.col("p"), F.lit("甲"))).collect()
    assert [r[0] for r in masked] == ["甲省", "甲市", "甲区", "甲街道", "甲社区"]


def test_redact_documents_takes_the_types_of_its_sql_and_the_whole_plan_all(spark, tmp_path):
    """A phone number inside a longer token, one beside an e-mail address, and an account."""
    rows = [(1, "18945874088f67ab"), (2, "13912345678 a@b.com"), (3, "6222000011112222333"), (4, "nothing"), (5, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "one"))
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{tmp_path}/one/*.parquet'")
    ours = sorted(tuple(r) for r in QUERIES["redact_documents"](spark, str(tmp_path)).collect())
    assert ours == sorted(duck.execute(ORACLES["redact_documents"]).fetchall()) and [r[0] for r in ours] == [2, 3]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    every = sorted(tuple(r) for r in QUERIES["redact_all_identifiers"](spark, str(tmp_path)).collect())
    assert every == [(1, 1, sha("***f67ab"), 0), (2, 2, sha("*** ***"), 0), (3, 1, sha("***"), 0)]
