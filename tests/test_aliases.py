"""Explicit names of organizations, their fixed point over documents, and a recogniser's verdicts."""

import pytest
from pyspark.sql import functions as F

from inkveil.functions.organizations import explicit_aliases
from inkveil.functions.spans import FEW, occurrences
from inkveil.operators import aliases, companies
from inkveil.operators import postprocess as P
from inkveil.plans.queries import QUERIES

NAME = "河北甲乙科技有限公司"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"{NAME}（以下简称“甲乙公司”）诉称", ["甲乙公司"]),
        (f"{NAME}（原名：丙丁有限公司，曾用名：戊己集团，简称甲乙、下称乙司）", ["丙丁有限公司", "戊己集团", "甲乙", "乙司"]),
        (f"{NAME}原名丙丁有限公司", []),
        (f"{NAME}，原为 华泰律师事务所，改制", ["华泰律师事务所"]),
        (f"{NAME}与丙公司（简称丙）", []),
        (f"甲方简称{NAME}（下称甲）", []),
        (f"{NAME}起诉。简称乙", []),
        (f"{NAME}{'字' * 118}简称乙。", []),
        (f"{NAME}诉称，{'字' * 100}{NAME}{'字' * 60}简称乙丙。", ["乙丙"]),
        (f"{NAME}（简称甲乙）。后{NAME}下称「乙司」", ["甲乙", "乙司"]),
        ("", []),
    ],
)
def test_explicit_aliases(spark, text, want):
    assert spark.range(1).select(explicit_aliases(F.lit(text), F.lit(NAME)).alias("a")).first().a == want


def test_no_name_has_no_aliases(spark):
    rows = spark.createDataFrame([("", "x简称甲乙"), (None, "x简称甲乙")], "n string, t string")
    assert [r.a or [] for r in rows.select(explicit_aliases(F.col("t"), F.col("n")).alias("a")).collect()] == [[], []]


def test_chains_are_followed_and_rounds_counted(spark, monkeypatch):
    chain = f"{NAME}（简称“甲乙”）。甲乙（曾用名：丙丁集团）。丙丁集团下称丙丁。丙丁（简称{NAME}）。戊己，简称庚辛。"
    docs = spark.createDataFrame([(1, chain), (2, f"{NAME}起诉"), (3, None), (4, ""), (5, "戊己，简称庚辛。"), (5, "庚辛（下称壬癸）")], "doc_id int, text string").withColumns({c: F.lit("clash") for c in ("id", "name", "parent", "depth")})
    names = spark.createDataFrame([(1, NAME), (1, NAME), (2, NAME), (3, NAME), (4, NAME), (5, "戊己"), (1, ""), (1, None), (9, NAME)], "doc_id int, name string")
    written = []
    real = aliases.materialize
    monkeypatch.setattr(aliases, "materialize", lambda df: written.append(real(df)) or written[-1])
    got = {(r.doc_id, r.name, r.parent, r.depth) for r in aliases.discover_aliases(docs, names).collect()}
    assert got == {
        (1, NAME, None, 0), (1, "甲乙", NAME, 1), (1, "丙丁集团", "甲乙", 2), (1, "丙丁", "丙丁集团", 3), (2, NAME, None, 0), (3, NAME, None, 0), (4, NAME, None, 0), (9, NAME, None, 0), (5, "戊己", None, 0), (5, "庚辛", "戊己", 1),
        (5, "壬癸", "庚辛", 2),
    }
    assert [w.count() for w in written] == [6, 2, 2, 1, 0]  # what each round found; the one that finds nothing is the last
    with pytest.raises(RuntimeError):
        aliases.discover_aliases(docs, names, most_rounds=1)
    assert aliases.discover_aliases(docs, names.limit(0)).count() == 0


def test_query_follows_chains_three_deep(spark):
    depths = {r.depth for r in QUERIES["discovered_aliases"](spark, "/root/testdata/sf0.001").select("depth").distinct().collect()}
    assert {0, 1, 2, 3} <= depths


def test_verdicts(spark):
    text = "甲乙公司与河北甲乙公司签约" + "。" * 100 + "丙丁"
    docs = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id int, text string")
    rows = [(0, "甲乙公司", 0), (1, "签约", 11), (2, "丙丁", len(text) - 2), (3, "某某公司提交的", 0), (4, "甲乙公司", 7)]
    cands = spark.createDataFrame([(d, o, "organization", t, s, s + len(t), "rule", 0.5) for d in (1, 2, 3) for o, t, s in rows], "doc_id int, ord int, type string, text string, start int, end int, source string, confidence double")
    verdicts = spark.createDataFrame([(1, ["签约", "丙丁"], {"甲乙公司": " 河北甲乙公司 ", "丙丁": "河北", "签约": "签"})], "doc_id int, reject array<string>, calibrate map<string,string>")
    got = {(r.doc_id, r.ord): (r.text, r.start, r.end, r.source, r.confidence) for r in aliases.apply_verdicts(docs, cands, verdicts).collect()}
    better = ("河北甲乙公司", 5, 11, "linear_llm_calibrated", 0.95)
    assert got[1, 0] == got[1, 4] == better and (1, 1) not in got and (1, 2) not in got
    assert got[2, 0] == ("甲乙公司", 0, 4, "rule", 0.5) and {k for k in got if k[0] == 2} == {k for k in {(2, 0), (2, 1), (2, 2), (2, 3), (2, 4)} if k in got}
    assert (2, 2) in got and (3, 0) in got


def test_bodies_with_spaces_keep_their_places(spark):
    rows = spark.createDataFrame([("甲乙 丙丁科技",), ("北京 华清科技",), ("北京华清科技",), ("中国华清",)], "b string")
    assert [r[0] for r in rows.select(companies.without_leading_place(F.col("b"))).collect()] == ["甲乙 丙丁科技", "北京 华清科技", "华清科技", "中国华清"]


def test_places_that_hold_two_sampled_names_across_blocks(spark):
    text = "字" * 60 + "河北甲乙丙丁戊己区" + "。甲乙，" + "字" * 70 + "丙丁戊"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    rows = [(0, "location", "河北甲乙丙丁戊己区", "rule"), (1, "person", "甲乙", P.SAMPLED + "x"), (2, "person", "丙丁", P.SAMPLED + "x"), (3, "location", "己区", "rule")]
    maps = spark.createDataFrame([(*r[:3], "m", r[3]) for r in rows], "ord int, type string, original string, masked string, source string")
    assert {r.original for r in P.inside_trusted_samples(docs, maps).collect()} == {"河北甲乙丙丁戊己区"}


def test_verdicts_in_a_long_text_across_its_pieces(spark):
    """Places are what a search in the whole text gives, wherever the text is cut and whatever a character's size."""
    text = "".join(("𠮷" if i % 3 else "。") * (i % 97) + "甲乙" + ("丙" if i % 2 else "丁") for i in range(600))
    starts = [i for i in range(len(text)) if text.startswith("甲乙", i)]
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    cands = spark.createDataFrame([(1, s, "organization", "甲乙", s, s + 2, "rule", 0.5) for s in starts], "doc_id int, ord int, type string, text string, start int, end int, source string, confidence double")
    verdicts = spark.createDataFrame([(1, [], {"甲乙": "甲乙丙"})], "doc_id int, reject array<string>, calibrate map<string,string>")
    got = {r.ord: r.start for r in aliases.apply_verdicts(docs, cands, verdicts).collect()}
    want = {s: max(0, s - 80) + text[max(0, s - 80) : s + 82].find("甲乙丙") if "甲乙丙" in text[max(0, s - 80) : s + 82] else s for s in starts}
    assert got == want
    for overlapping in (True, False):  # more places than running sums are appended for
        found = docs.select(occurrences(F.col("text"), F.lit("甲乙"), overlapping)).first()[0]
        assert found == starts and len(starts) > FEW


def test_places_are_found_once_for_verdicts(spark):
    """No filter repeats the search for the places that are then exploded."""
    plan = QUERIES["recogniser_verdicts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter " in line and "split(" in line]
