"""Masks of organizations and places, and the tests of proposed names, on literal texts."""

import pytest
from pyspark.sql import functions as F

from inkveil.functions import cleaners, noise, rejects
from inkveil.operators import companies, pseudonyms


def masks(spark, text, names, source="linear_llm_exact", entities=None, places=()):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    rows = [(1, i, n, source, (entities or {}).get(n)) for i, n in enumerate(names)]
    found = spark.createDataFrame(rows, "doc_id bigint, ord int, text string, source string, entity string")
    known = spark.createDataFrame([(1, a, b) for a, b in places], "doc_id bigint, original string, masked string")
    return {r.original: r.masked for r in companies.mask_organizations(found, docs, known).collect()}


def test_a_leading_city_is_no_part_of_the_mask(spark):
    names = ["石家庄融创贵和房地产开发有限公司", "中国建筑第二工程局有限公司"]
    got = masks(spark, "石家庄融创贵和房地产开发有限公司与中国建筑第二工程局有限公司签订合同。", names)
    assert got == {names[0]: "甲房地产开发公司", names[1]: "乙公司"}


def test_one_brand_under_two_places(spark):
    text = "原告江苏载道电力工程有限公司，后更名为淮安载道电力工程有限公司。载道公司亦参与诉讼。"
    got = masks(spark, text, ["江苏载道电力工程有限公司", "淮安载道电力工程有限公司", "载道公司", "载道电力工程有限公司"])
    assert (got["江苏载道电力工程有限公司"], got["淮安载道电力工程有限公司"], got["载道公司"]) == ("甲电力工程公司", "甲电力工程公司", "甲公司")


def test_short_names_before_full_ones(spark):
    text = "河北云厚建筑装饰工程有限公司（以下简称云厚公司）与河北兴代建筑安装工程有限公司（以下简称兴代公司）及石家庄方卫信息系统技术有限公司（以下简称方卫公司）签订合同。"
    names = ["云厚公司", "兴代公司", "方卫公司", "河北云厚建筑装饰工程有限公司", "河北兴代建筑安装工程有限公司", "石家庄方卫信息系统技术有限公司"]
    got = masks(spark, text, names)
    assert [got[n] for n in names] == ["甲公司", "乙公司", "丙公司", "甲装饰工程公司", "乙公司", "丙公司"]


def test_companies_that_share_a_brand_stay_apart(spark):
    text = "河北星河建设有限公司与北京星河科技有限公司签订合同。星河建设公司提交说明，星河科技公司提交说明。"
    got = masks(spark, text, ["河北星河建设有限公司", "北京星河科技有限公司", "星河建设公司", "星河科技公司"])
    assert got["星河建设公司"] == "甲公司" and got["星河科技公司"] == "乙公司"


def test_stated_aliases_outlets_institutions_and_entities(spark):
    got = masks(spark, "河北豪木山运输有限公司（以下简称豪木山）签订合同。豪木山负责运输。", ["河北豪木山运输有限公司"], "linear_full_org")
    assert got["豪木山"] == "甲运输公司" and got["河北豪木山运输有限公司"] == "甲运输公司"
    assert "石家庄誉烁" not in masks(spark, "石家庄誉烁建筑工程有限公司签订合同。", ["石家庄誉烁建筑工程有限公司"], "linear_full_org")
    assert masks(spark, "", ["高新区泽行机械设备安装队", "泽新经销处"], "full_document_llm") == {"高新区泽行机械设备安装队": "甲安装队", "泽新经销处": "乙经销处"}
    place = (("河北省", "甲省"), ("河北", "甲省"))
    assert masks(spark, "", ["中国建设银行河北省分行", "金杜律师事务所", "河北省星河建设有限公司"], places=place) == {"中国建设银行河北省分行": "中国建设银行甲省分行", "金杜律师事务所": "金某律师事务所", "河北省星河建设有限公司": "甲省甲公司"}
    assert masks(spark, "", ["甲乙科技有限公司", "丙丁有限公司"], entities={"甲乙科技有限公司": "e1", "丙丁有限公司": "e1"}) == {"甲乙科技有限公司": "甲科技公司", "丙丁有限公司": "甲科技公司"}
    assert masks(spark, "", ["严重违反公司", "我公司"], "regex") == {}


def test_places_and_paths(spark):
    rows = [(1, 0, "河北省石家庄市长安区"), (1, 1, "石家庄市"), (1, 2, "河北省"), (1, 3, "某小镇"), (1, 4, "县城"), (2, 0, "广东省")]
    got = {(r.doc_id, r.original): r.masked for r in pseudonyms.mask_locations(spark.createDataFrame(rows, "doc_id bigint, ord int, text string")).collect()}
    assert got[1, "河北省石家庄市长安区"] == "甲省乙市丙区" and got[1, "石家庄市"] == "乙市" and got[1, "石家庄"] == "乙市"
    assert got[1, "河北省"] == "甲省" and got[1, "河北"] == "甲省" and got[2, "广东"] == "甲省" and got[1, "县城"] == "戊地"


@pytest.mark.parametrize(
    ("name", "entity", "project", "variant"),
    [
        ("", True, True, False), ("甲乙公司", False, True, True), ("3号判决书", True, True, False), ("某人无权代表星河公司", True, True, False), ("合同一", True, True, False), ("长江花园", False, False, True),
        ("二期装修工程", False, True, True), ("工程", False, True, True), ("否认其与甲公司系关联公司", True, True, False), ("张三提交甲公司", True, True, False), ("红星砖厂", False, True, True),
        ("华夏银行石家庄中山东路营业部支行", False, True, True), ("原告甲乙公司", False, True, False), ("本工程", False, False, False), ("12#综合楼项目", True, True, False), ("大江大河大楼大厦", False, False, True),
        ("河北甲乙科技有限公司", False, True, True), ("（甲乙公司", False, True, False), ("工程报价单项目", False, True, True),
    ],
)
def test_proposed_names(spark, name, entity, project, variant):
    row = spark.range(1).select(noise.is_noise_entity(F.lit(name)), noise.is_noise_project(F.lit(name)), noise.is_company_variant(F.lit(name))).first()
    assert tuple(row) == (entity, project, variant)


def test_surfaces_and_cleaning(spark):
    proposed = {"“由河北甲乙科技有限公司”": "河北甲乙科技有限公司", "本院委托大华事务所": "大华事务所", "与华泰公司（华泰建设集团有限公司": "华泰建设集团有限公司", "甲乙": "甲乙", "": ""}
    got = spark.createDataFrame([(k,) for k in proposed], "t string").select("t", noise.recognised_surface(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in got} == proposed
    people = {"（张三及": "张三", "王五辩称": "王五", "和": "和", "【李四": "李四", "李·四）": "李·四"}
    got = spark.createDataFrame([(k,) for k in people], "t string").select("t", cleaners.clean_person(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got} == people


def test_a_part_of_a_name_is_worked_out_once(spark):
    """The size of the expressions is what a name costs; their parts are bound, not written out at each use."""
    count = lambda c: c._jc.toString().count("regexp_extract")
    assert count(rejects.is_false_organization(F.col("name"))) == 2
    texts = [F.col(c) for c in ("name", "source", "text")]
    assert count(companies.analysed(*texts, F.col("places"))) < 60


def test_verbs_and_narrative_by_their_places(spark):
    """Verbs that are trades count unless they end a core of some length; narrative goes again and again."""
    names = ["星河建设公司", "建设公司", "建设星河公司", "星河开发", "甲开发", "张三与李四与设立河北星河建设有限公司", "原河北星河建设有限公司", "张三与河北星河建设有限公司", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [tuple(r) for r in df.select(rejects.is_false_organization(F.col("name")), cleaners.clean_organization(F.col("name"))).collect()]
    assert got == [
        (True, "星河建设公司"), (True, "建设公司"), (False, "建设星河公司"), (False, "星河开发"), (False, "甲开发"), (True, "河北星河建设有限公司"),
        (False, "河北星河建设有限公司"), (False, "河北星河建设有限公司"), (None, None),
    ]
