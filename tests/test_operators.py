"""Candidates, gazetteer, pseudonyms, evaluation, registry, samples, files and streams on small tables."""

import random

from pyspark.sql import functions as F

from inkveil.functions.organizations import alias_cores
from inkveil.operators import audit, candidates, companies, components, evaluation, gazetteer, postprocess, pseudonyms, registry, reports, samples
from inkveil.plans import fixtures
from inkveil.plans.queries import QUERIES
from inkveil.sources import files
from inkveil.streaming.drops import redact_drops

CANDIDATE = "doc_id bigint, ord int, type string, text string, start int, end int, source string, confidence double, needs_review boolean, metadata map<string,string>, provenance array<string>"


def spans(spark, *rows):
    full = [(0, i, *r, False, None, None) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CANDIDATE)


def texts(df):
    return [r.text for r in candidates.resolve_overlaps(df).orderBy("rank").collect()]


def test_better_sources_win_overlaps(spark):
    assert texts(spans(spark, ("location", "石家庄", 0, 3, "regex", 0.9), ("location", "石家庄市", 0, 4, "china_admin_db", 0.5), ("person", "张三", 6, 8, "regex", 0.5))) == ["石家庄市", "张三"]


def test_nested_recognised_person_replaces_the_outer(spark):
    assert texts(spans(spark, ("person", "张三说", 0, 3, "china_admin_db", 0.9), ("person", "张三", 0, 2, "full_document_llm", 0.9))) == ["张三"]


def test_noisy_organization_gives_way_to_its_tail(spark):
    assert texts(spans(spark, ("organization", "未找甲公司", 0, 5, "full_document_llm", 0.9), ("organization", "甲公司", 2, 5, "regex", 0.2))) == ["甲公司"]


def test_equal_candidates_keep_their_order(spark):
    assert texts(spans(spark, ("person", "ab", 0, 2, "x", 0.5), ("person", "bc", 1, 3, "x", 0.5))) == ["ab"]


def test_deduplication_merges(spark):
    rows = [(0, 0, "person", "a", 0, 1, "s1", 0.5, False, {"k": "1", "x": "y"}, ["s1"]), (0, 1, "person", "a", 0, 1, "s2", 0.9, True, {"k": "2"}, ["s2", "s1"]), (0, 2, "person", "a", 0, 1, "s3", 0.9, False, None, None)]
    r = candidates.deduplicate(spark.createDataFrame(rows, CANDIDATE)).first()
    assert (r.source, r.confidence, r.needs_review, r.metadata, r.provenance) == ("s2", 0.9, True, {"k": "2", "x": "y"}, ["s1", "s2"])


def test_review_list_is_bounded(spark):
    rows = [(0, i, "person", f"p{i % 100}", 0, 1, "s", 0.5, True, None, None) for i in range(200)]
    assert candidates.review_list(spark.createDataFrame(rows, CANDIDATE)).count() == 80


def test_dictionary_finds_nested_and_overlapping_terms(spark):
    docs = spark.createDataFrame([(1, "河北省石家庄市"), (2, None), (3, "😀石家庄石家庄")], "doc_id bigint, text string")
    table = gazetteer.divisions(fixtures.division_rows(spark))
    want = {(1, 0, "河北省"), (1, 0, "河北"), (1, 3, "石家庄市"), (1, 3, "石家庄"), (3, 1, "石家庄"), (3, 4, "石家庄")}
    words = gazetteer.terms(table)
    for most in (1000, 1):
        found = gazetteer.find_terms(docs, words, most=most)
        assert {(r.doc_id, r.start, r.term) for r in found.collect()} == want
    kept = gazetteer.resolve_places(found)
    assert {(r.doc_id, r.start, r.term) for r in kept.collect()} == {(1, 0, "河北省"), (1, 3, "石家庄市"), (3, 1, "石家庄"), (3, 4, "石家庄")}
    names = {r.code: r.full_name for r in gazetteer.full_names(table).collect()}
    assert names["130102001001"] == "河北省石家庄市长安区建北街道棉一社区居委会" and names["440300000000"] == "广东省深圳市"


def test_masks_follow_first_appearance(spark):
    rows = spark.createDataFrame([(1, 0, "张三", "e1"), (1, 1, "张四", "e2"), (1, 2, "张老三", "e1"), (1, 3, "李五", None), (2, 0, "张四", None), (1, 4, "bad name", None)], "doc_id bigint, ord int, text string, entity string")
    got = {(r.doc_id, r.original): r.masked for r in pseudonyms.mask_persons(rows).collect()}
    assert got == {(1, "张三"): "张某甲", (1, "张四"): "张某乙", (1, "张老三"): "张某甲", (1, "李五"): "李某甲", (2, "张四"): "张某甲"}
    places = spark.createDataFrame([(1, 0, "石家庄市"), (1, 1, "石家庄"), (1, 2, "河北省")], "doc_id bigint, ord int, text string")
    assert {r.original: r.masked for r in pseudonyms.mask_locations(places).collect()} == {"石家庄市": "甲市", "石家庄": "甲市", "河北省": "乙省", "河北": "乙省"}
    orgs = spark.createDataFrame([(1, 0, "甲乙集团", None), (1, 1, "丙丁有限公司", None)], "doc_id bigint, ord int, text string, entity string")
    assert [r.masked for r in companies.mask_organizations(orgs).orderBy("ord").collect()] == ["甲集团", "乙公司"]
    projects = spark.createDataFrame([(1, 0, "大桥工程")], "doc_id bigint, ord int, text string")
    assert pseudonyms.mask_projects(projects).first().masked == "甲工程"


def test_first_mapping_wins(spark):
    rows = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "b", "b"), (1, 3, "c", "")], "doc_id bigint, ord int, original string, masked string")
    assert [(r.original, r.masked) for r in pseudonyms.first_wins(rows).collect()] == [("a", "x")]


def test_containment_needs_every_occurrence(spark):
    docs = spark.createDataFrame([(1, "北京公司"), (2, "北京公司 北京"), (3, "x")], "doc_id bigint, text string")
    m = spark.createDataFrame([(0, "organization", "北京公司", ""), (1, "location", "北京", "")], "ord int, type string, original string, masked string")
    assert [tuple(r) for r in postprocess.locations_inside_organizations(docs, m).collect()] == [(1, "北京")]
    assert [tuple(r) for r in postprocess.fragments_inside_longer(docs, m, most=2).collect()] == [(1, "北京")]
    rows = spark.createDataFrame([("m", "organization", "华为"), ("m", "location", "深圳"), ("m", "location", "华为深圳")], "map_id string, type string, original string")
    assert {r.original for r in postprocess.alias_prefixed_locations(rows).collect()} == {"华为", "深圳"}


def test_components_stay_within_maps(spark):
    got = {(r.map_id, r.node): r.component for r in components.alias_components(fixtures.alias_edges(spark)).collect()}
    assert got["m1", "c"] == "a" and got["m1", "e"] == "d" and got["m2", "d"] == "a" and {got["m2", n] for n in "vwxyz"} == {"v"} and got["m3", "k2"] == "k"


def test_metrics_conventions(spark):
    schema = "case_id string, original string, type string, masked string"
    expected = spark.createDataFrame([("c", "a", "person", "x"), ("c", "b", "person", "y"), ("d", "a", None, None)], schema)
    actual = spark.createDataFrame([("c", "a", "person", "x"), ("c", "z", "location", "w"), ("d", "a", None, None)], schema)
    rows = {r.type: r for r in evaluation.metrics_by_type(evaluation.match_entities(expected, actual)).collect()}
    assert (rows[None].tp, rows[None].fp, rows[None].fn) == (2, 1, 1) and rows[None].f1 == 0.666667
    assert rows["location"].recall == 1.0 and rows["location"].precision == 0 and rows["location"].f1 == 0 and rows["unknown"].f1 == 1
    assert {r.case_id: r.tp for r in evaluation.case_report(evaluation.match_entities(expected, actual)).collect()} == {"c": 1, "d": 1}


def test_audit_categories(spark):
    schema = "doc_id bigint, start int, end int, text string, type string"
    left = spark.createDataFrame([(1, 0, 2, "ab", "p"), (1, 5, 7, "cd", "p"), (1, 10, 12, "ef", "p"), (1, 200, 300, "long", "p")], schema)
    right = spark.createDataFrame([(1, 0, 2, "ab", "p"), (1, 5, 7, "cd", "l"), (1, 11, 13, "fg", "p"), (1, 30, 31, "z", "p")], schema)
    assert {r.category: r.n for r in audit.category_counts(audit.audit(left, right)).collect()} == {"agreed": 1, "type_conflict": 1, "boundary_conflict": 2, "detector_only": 1, "registry_only": 1}


def test_json_repair_and_registry(spark):
    raw = ['x {"persons": ["a", "b"]} tail {', '{"persons": ["a", "b', '{"persons": [', "no json", None, '{"a": "}\\""}', '{"a": ]}', '{"persons": ["a", {"b": [1, 2']
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(raw)], "i int, t string").orderBy("i").select(registry.complete_object("t")).collect()]
    assert got == ['{"persons": ["a", "b"]}', '{"persons": ["a"]}', None, None, None, '{"a": "}\\""}', None, '{"persons": ["a", {"b": [1]}]}']
    payloads = spark.createDataFrame([(1, '{"persons": [" 张三 ", "张三", ""], "organizations": ["甲公司", "张三"], "same_entities": [["甲公司", "甲", "甲司"], ["x"]]}')], "doc_id bigint, payload string")
    names = registry.parse_payloads(payloads)
    assert {(r.type, r.name) for r in names.collect()} == {("person", "张三"), ("organization", "甲公司"), ("organization", "张三")}
    assert [r.name for r in registry.conflicting_names(names).collect()] == ["张三"]
    assert {(r.a, r.b) for r in registry.same_entity_edges(payloads).collect()} == {("甲公司", "甲"), ("甲公司", "甲司")}
    docs = spark.createDataFrame([(1, "😀张三和张三")], "doc_id bigint, text string")
    assert sorted((r.name, r.start) for r in registry.materialise(docs, names.where("type = 'person'")).collect()) == [("张三", 1), ("张三", 4)]
    members = spark.createDataFrame([("g", f"n{i:02d}" + "x" * (i % 3), i) for i in range(21)], "g string, name string, nth int")
    kept = registry.primary_names(members, ["g"]).collect()
    assert len(kept) == 16 and {r.primary_name for r in kept} == {"n02xx"}


def test_reports(spark):
    sizes = spark.createDataFrame([(n,) for n in (9_999, 10_000, 29_999, 30_000, 59_999, 60_000)], "n int")
    assert {r.stratum: r.n for r in reports.strata_counts(sizes, F.col("n")).collect()} == {"lt_10k": 1, "10k_30k": 2, "30k_60k": 2, "gte_60k": 1}
    times = spark.sql("SELECT timestamp'2024-01-01 00:00:00' a, timestamp'2024-01-01 00:00:01.25' b UNION ALL SELECT timestamp'2024-01-02', timestamp'2024-01-01' UNION ALL SELECT NULL, timestamp'2024-01-01'")
    assert {tuple(r) for r in times.select(*(c.alias(n) for n, c in reports.elapsed(F.col("a"), F.col("b")).items())).collect()} == {(1250, None), (None, "order"), (None, "missing")}
    counts = spark.createDataFrame([({"a": 1, "b": -5},), ({"a": 2},)], "c map<string,int>")
    assert {r.category: r.n for r in reports.sum_category_counts(counts, "c").collect()} == {"a": 3, "b": 0}
    stats = spark.createDataFrame([("m", "x", "ok", 1, 5, None), ("m", "y", "ok", 2, 5, None)], "mode string, model_id string, status string, call_count int, duration_ms bigint, total_token_count bigint")
    r = reports.run_statistics(stats).first()
    assert (r.mode, r.model_id, r.call_count, r.total_token_count) == ("m", "mixed", 3, None)


def test_samples(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "x")], "original string, t int, masked string")
    assert {(r.original, r.masked, r.first_seen_at) for r in samples.upsert_latest(rows, "original", [F.col("t")], "t").collect()} == {("a", "new", 1), ("b", "x", 1)}
    bound = spark.createDataFrame([("t1", "d1"), ("t1", "d1"), ("t2", "d1"), ("t2", "d2"), ("t3", None)], "thread string, folder string")
    assert {tuple(r) for r in samples.binding(bound, "thread", "folder").collect()} == {("t1", "unique", "d1"), ("t2", "ambiguous", None), ("t3", "missing", None)}
    used = spark.createDataFrame([("张", 1), ("张", 3), ("李", 1)], "surname string, ordinal int")
    assert {tuple(r) for r in samples.next_ordinals(used, "surname", "ordinal").collect()} == {("张", 4), ("李", 2)}


def test_files_and_encryption(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿中文".encode())
    (tmp_path / "b.MD").write_bytes("国标".encode("gb18030"))
    (tmp_path / "c.bin").write_bytes(b"no")
    assert {(r.source_file, r.text) for r in files.read_texts(spark, str(tmp_path)).collect()} == {("a.txt", "中文"), ("b.MD", "国标")}
    key = F.lit("0123456789abcdef").cast("binary")
    r = spark.range(1).select(files.encrypt(F.lit("秘密"), key).alias("e")).select("e", files.decrypt(F.col("e"), key).alias("d")).first()
    assert r.d == "秘密" and "秘密" not in r.e
    maps = tmp_path / "maps"
    maps.mkdir()
    (maps / "m.json").write_text('{"version": "1", "mappings": [{"ord": 0, "type": "person", "original": "张三", "masked": "张某甲"}]}')
    m = files.read_maps(spark, str(maps))
    assert (m.first().map_id, m.first().original) == ("m.json", "张三") and '"original":"张三"' in files.map_json(m).first().json


def test_dropped_files_are_redacted_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.cc"), (2, "none")], "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        redact_drops(spark, f"{tmp_path}/in", "doc_id bigint, text string", f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination(120)
    assert {(r.doc_id, r.redacted) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, "mail ***"), (2, "none")}


def test_rejects(spark):
    from inkveil.functions import rejects

    people = {"张三": False, "欧阳娜娜": False, "杨利进": False, "被告人": True, "张3": True, "罗某手": True, "李某": False, "一二三四五": True, "买买提·艾力江": False, "河北张": True, "的人": True, "施工队": True}
    got = spark.createDataFrame([(k,) for k in people], "t string").select("t", rejects.is_false_person(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == people
    orgs = {"有限公司": True, "家具有限公司": True, "合同一": True, "严重违反公司": True, "华为技术有限公司": False, "张三公司": True, "我公司": True, "石家庄市公司": True, "甲乙丙运输有限公司": False, "甲乙运输有限公司": True, "某某（abc": True}
    got = spark.createDataFrame([(k,) for k in orgs], "t string").select("t", rejects.is_false_organization(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == orgs
    places = {("石家庄市", "住"): False, ("石家庄市", "在"): True, ("案涉小区", ""): True, ("各县市", ""): True, ("某省", ""): True, ("工程区", ""): True, ("棉一社区居委会", ""): False, ("社区居委会", ""): True, ("县", ""): True}
    got = spark.createDataFrame(list(places), "t string, b string").select("t", "b", rejects.is_false_place(F.col("t"), F.col("b")).alias("f")).collect()
    assert {(r.t, r.b): r.f for r in got} == places


def test_organization_algebra(spark):
    from inkveil.functions import organizations as O

    names = spark.createDataFrame([("河北甲乙科技有限公司",), ("石家庄市甲乙科技（北京）有限公司",), ("中国银行北京分行",), ("金杜律师事务所",)], "t string")
    rows = {r.t: r for r in names.select("t", O.brand(F.col("t")).alias("b"), O.industry(O.company_body(F.col("t"))).alias("i"), O.legal_suffix(F.col("t")).alias("s"), O.institution_mask(F.col("t")).alias("m")).collect()}
    assert (rows["河北甲乙科技有限公司"].b, rows["河北甲乙科技有限公司"].i, rows["河北甲乙科技有限公司"].s) == ("甲乙", "科技", "有限公司")
    assert rows["石家庄市甲乙科技（北京）有限公司"].b == "甲乙"
    assert rows["中国银行北京分行"].m == "中某分行" and rows["金杜律师事务所"].m == "金某律师事务所" and rows["河北甲乙科技有限公司"].m is None
    text = F.lit("河北甲乙科技有限公司（以下简称“甲乙公司”）与丙公司。原名另说。")
    assert spark.range(1).select(O.explicit_aliases(text, F.lit("河北甲乙科技有限公司"))).first()[0] == ["甲乙公司"]


def test_noise_and_alias_merges(spark):
    rows = [("m", 0, "organization", "河北甲乙科技有限公司", "甲科技公司", "e1", None), ("m", 1, "organization", "甲乙公司", "乙公司", "e2", None), ("m", 2, "organization", "丙丁有限公司", "丙公司", "e3", ["e4"]), ("m", 3, "organization", "丙丁集团", "丁集团", "e4", None), ("m", 4, "person", "被告人", "x", None, None)]
    m = spark.createDataFrame(rows, "map_id string, ord int, type string, original string, masked string, entity_id string, do_not_merge array<string>")
    assert {r.original for r in postprocess.without_noise(m).collect()} == {r[3] for r in rows[:4]}
    got = {r.original: r.masked for r in postprocess.merge_aliases(m).collect()}
    assert got["甲乙公司"] == "甲科技公司" and got["河北甲乙科技有限公司"] == "甲科技公司" and got["丙丁有限公司"] == "丙公司" and got["丙丁集团"] == "丁集团"


def test_trusted_samples_and_noise_names(spark):
    docs = spark.createDataFrame([(1, "河北甲乙科技有限公司与张三，丙丁公司、丙丁在石家庄"), (2, "张三")], "doc_id bigint, text string")
    rows = [(0, "organization", "河北甲乙科技有限公司", "sample_library:x"), (1, "location", "河北", "db"), (2, "organization", "甲乙", "llm"), (3, "person", "张三", "llm"), (4, "organization", "丙丁公司", "sample_library:x"), (5, "organization", "丙丁", "llm"), (6, "location", "石家庄", "db")]
    m = spark.createDataFrame(rows, "ord int, type string, original string, source string").withColumn("masked", F.lit("x"))
    assert {(r.doc_id, r.original) for r in postprocess.inside_trusted_samples(docs, m).collect()} == {(1, "河北"), (1, "甲乙")}
    names = [("organization", "3号判决书"), ("organization", "甲乙公司"), ("organization", "原告甲乙公司"), ("project", "二期装修工程"), ("project", "长江花园"), ("person", "被告人"), ("person", "")]
    table = spark.createDataFrame([("m", t, o) for t, o in names], "map_id string, type string, original string")
    assert {r.original for r in postprocess.without_noise_names(table).collect()} == {"甲乙公司", "长江花园", "被告人"}


def test_sample_library(spark):
    schema = "ord int, action string, type string, original string, masked string, old_original string, new_original string, new_masked string"
    rows = [(0, "keep", "organization", "甲乙公司", "甲公司", None, None, None), (1, "delete", "person", "张三", None, None, None, None), (2, "delete", "phone", "李四", None, None, None, None), (3, "modify", "location", None, None, "旧地", "新地", "甲市"),
            (4, "add", "manual", "王小明", "王某甲", None, None, None), (5, "add", "manual", "短语一", "什么", None, None, None), (6, None, None, "甲乙公司", "乙公司", None, None, None), (7, "delete", "person", "欧阳修", None, None, None, None)]
    table = spark.createDataFrame(rows, schema)
    assert {(r.ord, r.type, r.original, r.masked, r.source) for r in samples.trusted_mappings(table).collect()} == {(0, "organization", "甲乙公司", "甲公司", "sample_library:keep"), (3, "location", "新地", "甲市", "sample_library:modify"), (4, "person", "王小明", "王某甲", "sample_library:add")}
    assert {tuple(r) for r in samples.sample_lookup(table).collect()} == {("甲乙公司", "乙公司"), ("新地", "甲市"), ("王小明", "王某甲"), ("短语一", "什么")}
    assert {r.original for r in samples.sample_blacklist(table, "张李欧").collect()} == {"李四", "旧地"}
    docs = spark.createDataFrame([(1, "甲乙公司在新地，短语一"), (2, None)], "doc_id bigint, text string")
    assert {(r.start, r.original) for r in samples.detect_samples(docs, table).collect()} == {(0, "甲乙公司"), (5, "新地"), (8, "短语一")}


def test_registry_against_the_text(spark):
    docs = spark.createDataFrame([(1, "张三又名张老三，李四。王五和王小五")], "doc_id bigint, text string")
    rows = [(1, "p1", "person", "张三", 0), (1, "p1", "person", "张老三", 1), (1, "p1", "person", "不在", 2), (1, "p2", "person", "李四", 1), (1, "p3", "person", "李四", 0), (1, "p4", "person", "王五", 0), (1, "p4", "person", "王小五", 1), (1, "o1", "organization", "李四", 0)]
    names = spark.createDataFrame(rows, "doc_id bigint, entity_id string, type string, name string, nth int")
    got = {(r.entity_id, r.name): (r.conflict, r.primary_name) for r in registry.validated(docs, names).collect()}
    assert ("p1", "不在") not in got and got["p1", "张老三"] == (False, "张三") and got["p2", "李四"] == (True, "李四") and got["o1", "李四"] == (False, "李四")
    parts = {(r.entity_id, r.name): r.part for r in registry.person_groups(docs, names).collect()}
    assert parts["p1", "张三"] == parts["p1", "张老三"] == 0 and parts["p1", "不在"] == 1 and (parts["p4", "王五"], parts["p4", "王小五"]) == (0, 1)


def test_masks_made_by_hand(spark):
    from inkveil.operators import review

    m = spark.createDataFrame([("m", "person", "张某甲"), ("m", "person", "张某3"), ("m", "individual_business", "甲店"), ("m", "person", "自然人乙"), ("n", "location", "癸市")], "map_id string, type string, masked string")
    asked = [("m", 0, "张三", "person"), ("m", 1, "张四", "person"), ("m", 2, "欧阳 x", "person"), ("m", 3, "甲乙股份有限公司", "organization"), ("m", 4, "某单位", "organization"), ("n", 0, "棉一村民委员会", "location"), ("n", 1, "别处", "location"), ("m", 5, "x", "phone")]
    got = [r.masked for r in review.suggest_masks(spark.createDataFrame(asked, "map_id string, nth int, original string, type string"), m).orderBy("map_id", "nth").collect()]
    assert got == ["张某丁", "张某戊", "自然人丙", "乙公司", "丙机构", "敏感信息甲", "11村民委员会", "12地"]


def test_gazetteer_admission(spark):
    rows = [("110000000000", "北京市", "province", 0), ("110101000000", "东城区", "county", 1), ("130183000000", "晋州市", "county", 2), ("130183101001", "大庄", "village", 3), ("130183101000", "市辖区", "township", 4), ("130183102000", "桃园镇", "township", 5)]
    table = spark.createDataFrame(rows, "code string, name string, level string, ord int").withColumn("full_name", F.concat(F.lit("河北省"), "name"))
    aliases = spark.createDataFrame([("晋州市桃园镇", "河北省/晋州市/桃园镇", "130183102000", 0.8), ("桃园", "河北省/桃园镇", "130183102000", 0.7), ("某处", "x", "999", 0.5)], "alias string, canonical_name string, division_code string, confidence double")
    got = {r.term: (r.level, r.entity_type, r.confidence) for r in gazetteer.terms(table, aliases).collect()}
    assert got["河北省东城区"] == ("county", "location", 0.98) and got["东城区"][2] == 0.92 and got["东城"] == ("county", "location", 0.9) and got["大庄"] == ("village", "grassroots_org", 0.92)
    assert "河北省桃园镇" not in got and "市辖区" not in got and "晋州市桃园镇" not in got and got["桃园"][2] == 0.7 and got["某处"][0] == "unknown"
    assert set(got) - set(r.term for r in gazetteer.terms(table, aliases, deepest="township").collect()) == {"大庄", "河北省大庄", "某处"}
    docs = spark.createDataFrame([(1, "他去东城玩"), (2, "住东城大庄"), (3, "晋州市桃园镇某村的大庄")], "doc_id bigint, text string")
    found = gazetteer.find_terms(docs, gazetteer.terms(table, aliases))
    kept = gazetteer.resolve_places(gazetteer.admitted(found, docs))
    assert {(r.doc_id, r.term) for r in kept.collect()} == {(2, "东城"), (2, "大庄"), (3, "晋州市"), (3, "桃园镇"), (3, "大庄")}


def test_review_edits(spark):
    from inkveil.operators import review

    m = spark.createDataFrame([("m", 0, "person", "a", "A", None), ("m", 1, "person", "b", "B", None), ("m", 2, "person", "c", "B", None)], "map_id string, ord int, type string, original string, masked string, entity_id string")
    e = spark.createDataFrame([("m", 0, "delete", "a", None, None), ("m", 1, "keep", "a", None, None), ("m", 2, "modify", "b", "BB", None), ("m", 3, "add", "d", "D", "person"), ("m", 4, "delete", "c", None, None), ("m", 5, "add", "b2", "x", "person")], "map_id string, nth int, action string, original string, masked string, type string")
    assert {(r.original, r.masked) for r in review.apply_edits(m, e).collect()} == {("a", "A"), ("b", "BB"), ("d", "D"), ("b2", "x")}
    assert [(r.masked, r.originals) for r in review.ambiguous_masks(m).collect()] == [("B", ["b", "c"])]
    assert {r.masked for r in review.rename_group(m, spark.createDataFrame([("m", "B", "Z")], "map_id string, masked string, new_mask string")).collect()} == {"A", "Z"}
    batch = spark.createDataFrame([(1, 0, "a", "late"), (0, 5, "a", "early")], "batch_ord int, ord int, original string, masked string")
    assert review.merge_batch_maps(batch).first().masked == "early"


def test_report_privacy_and_context(spark):
    r = spark.createDataFrame([(1, '{"gold": {"Text": "x", "n": 1}, "list": [{"path":"p"}]}'), (2, '{"n": "text: no"}')], "id int, report string")
    assert {tuple(x) for x in reports.unsafe_keys(r, "id", "report").collect()} == {(1, "Text"), (1, "path")}
    runs = spark.createDataFrame([("a", "g1", 1, 5), ("b", "g2", None, 4), ("c", "g1", 1, 6)], "run string, gold string, f1 int, ms int")
    assert [(x.run, x.fields) for x in reports.context_mismatches(runs, "a", "run", ["gold", "f1"]).collect()] == [("b", ["gold", "f1"])]
    assert reports.missing_evidence(runs, ["ms", "f1"]).first().missing == ["f1"]
    one, two = (reports.stable_hash(runs.orderBy(o), ["gold"], ["run"]).orderBy("gold").collect() for o in ("run", F.desc("run")))
    assert one == two


def test_large_dictionary_keeps_one_character_terms(spark):
    docs = spark.createDataFrame([(1, "京A京"), (2, None), (3, "😀北京"), (4, "京")], "doc_id bigint, text string")
    words = spark.createDataFrame([("京",), ("北京",), ("😀",), ("",)], "term string")
    for most in (1000, 1):
        found = gazetteer.find_terms(docs, words, most=most).collect()
        assert sorted((r.doc_id, r.start, r.end, r.term) for r in found) == [(1, 0, 1, "京"), (1, 2, 3, "京"), (3, 0, 1, "😀"), (3, 1, 3, "北京"), (3, 2, 3, "京"), (4, 0, 1, "京")]


def test_alias_links_connect_what_all_unblocked_pairs_do(spark):
    rng = random.Random(2)
    names = ["丙丁有限公司", "丙丁集团", "丙丁科技有限公司", "河北丙丁有限公司", "丙丁实业集团"]
    maps = [("parent", [("丙丁有限公司", ["e1", "e2"]), ("丙丁集团", []), ("河北丙丁有限公司", [])])]
    maps += [(f"m{i}", [(n, rng.sample([f"e{k}" for k in range(5)], rng.choice((0, 1, 2, 3)))) for n in names]) for i in range(30)]
    rows = [(m, n, "organization", f"e{i}", b) for m, group in maps for i, (n, b) in enumerate(group)]
    table = spark.createDataFrame(rows, "map_id string, original string, type string, entity_id string, do_not_merge array<string>").persist()
    cores = {(r.map_id, r.original): set(r.c) for r in table.select("map_id", "original", alias_cores(F.col("original")).alias("c")).collect()}
    edges = {(r.map_id, r.a, r.b) for r in postprocess.alias_edges(table).collect()}

    def groups(pairs, group):
        label = {n: n for n, _ in group}
        for a, b in pairs:
            old, new = label[a], label[b]
            label = {n: new if x == old else x for n, x in label.items()}
        return {frozenset(n for n in label if label[n] == x) for x in label.values()}

    for m, group in maps:
        at = {n: (f"e{i}", b) for i, (n, b) in enumerate(group)}
        free = [(x, y) for x in at for y in at if x < y and cores[m, x] & cores[m, y] and at[x][0] not in at[y][1] and at[y][0] not in at[x][1]]
        got = [(a, b) for k, a, b in edges if k == m]
        assert {tuple(sorted(p)) for p in got} <= set(free) and groups(got, group) == groups(free, group)
    assert groups([(a, b) for k, a, b in edges if k == "parent"], maps[0][1]) == {frozenset({"丙丁有限公司"}), frozenset({"丙丁集团", "河北丙丁有限公司"})}


def test_texts_are_not_broadcast_to_their_names(spark):
    plan = QUERIES["validated_names"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("MergeJoin") == 1


def test_audit_takes_one_shuffle_and_any_text(spark):
    schema = "doc_id bigint, start int, end int, text string, type string"
    left = spark.createDataFrame([(1, 0, 4, None, "a"), (1, 6, 9, "x", "a"), (1, 20, 22, "y", "a"), (None, 1, 2, "z", "a")], schema)
    right = spark.createDataFrame([(1, 0, 4, None, "a"), (1, 8, 12, "w", "a"), (2, 20, 22, "y", "a"), (None, 1, 2, "z", "b")], schema)
    found = audit.audit(left, right)
    got = {(r.doc_id, r.start, r.text): r.category for r in found.collect()}
    assert got == {(1, 0, None): "agreed", (1, 6, "x"): "boundary_conflict", (1, 8, "w"): "boundary_conflict", (1, 20, "y"): "detector_only", (2, 20, "y"): "registry_only", (None, 1, "z"): "type_conflict"}
    assert found._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
