"""Office files, listings, detailed payloads, samples, cases and review on small tables."""

import io
import zipfile

from pyspark.sql import functions as F

from inkveil.operators import registry, reports, review, samples
from inkveil.sources import office

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/") + ".xml", text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    (tmp_path / "a.docx").write_bytes(packed(word__document=f"<w:document {W}><w:body>{p('一')}<w:tbl><w:tr><w:tc>{p('格')}</w:tc></w:tr></w:tbl>{p('二')}</w:body></w:document>"))
    sheet = f'<worksheet {S}><sheetData><row><c t="s"><v>0</v></c><c><f>A1</f><v>5</v></c><c t="inlineStr"><is><t>inline</t></is></c><c><v>7</v></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(packed(xl__sharedStrings=f"<sst {S}><si><t>共享</t></si></sst>", xl__worksheets__sheet1=sheet))
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "._d.docx").write_bytes(b"")
    got = {r.source_file: (r.text, r.error) for r in office.read_office(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("一\n二\n格", None), "b.xlsx": ("共享\ninline", None), "c.docx": (None, "BadZipFile")}


def test_listings_and_html(spark):
    d = spark.createDataFrame([("130102001001 111 棉一社区居委会\n 130102001002 棉二社区\nother",)], "text string")
    assert [tuple(r) for r in office.listed_divisions(d).collect()] == [("130102001001", "111", "棉一社区居委会"), ("130102001002", None, "棉二社区")]
    page = F.lit("<html><style>x{}</style><p>a &amp; b</p><script>var t='</p>'</script><td>c</td>  d</html>")
    assert spark.range(1).select(office.html_text(page)).first()[0] == "a & b\nc d"


def test_detailed_payloads_and_passes(spark):
    one = '{"entities": [{"entity_id": "p1", "entity_type": "person", "primary_text": "张三", "variants": ["张老三", "张三"], "confidence": 7}, {"entity_id": "p1", "entity_type": "person", "primary_text": "dup"}], "do_not_merge": [{"left_id": "p2", "right_id": "p1"}]}'
    rows = registry.parse_detailed(spark.createDataFrame([(1, one), (2, None)], "doc_id bigint, payload string")).collect()
    assert {(r.entity_id, r.name, r.confidence, tuple(r.blocked)) for r in rows} == {("p1", "张三", 1.0, ("p2",)), ("p1", "张老三", 1.0, ("p2",))}
    schema = "doc_id bigint, entity_id string, type string, name string"
    first = spark.createDataFrame([(1, "a", "person", "x"), (1, "b", "person", "y")], schema)
    second = spark.createDataFrame([(1, "q", "person", "y"), (1, "q", "person", "z"), (1, "r", "person", "w"), (1, "s", "location", "x")], schema)
    got = {(r.type, r.name): r.entity_id for r in registry.merge_passes(first, second).collect()}
    assert got == {("person", "x"): "a", ("person", "y"): "b", ("person", "z"): "b", ("person", "w"): "second-r", ("location", "x"): "second-s"}
    same = lambda t: spark.range(1).select(registry.identity_evidence(F.lit(t), F.lit("张三"), F.lit("张小三"))).first()[0]
    assert same("张三（曾用名张小三）") and same("张小三，又名张三") and not same("张三。又名张小三") and not same("张三和张小三")


def test_samples_and_cases(spark):
    old = spark.createDataFrame([("a", "A"), ("b", "B")], "original string, masked string")
    new = spark.createDataFrame([("a", "A", 0), ("b", "x", 0), ("b", "C", 1), ("c", "C", 0)], "original string, masked string, nth int")
    assert {r.state: r.n for r in samples.effective_delta(old, new, "original", ["masked"]).collect()} == {"unchanged": 1, "updated": 1, "created": 1}
    many = spark.createDataFrame([("add", f"o{i:02d}", f"{i:02d}") for i in range(20)] + [("delete", "d", "00")], "action string, original string, updated_at string")
    kept = samples.few_shot(many).collect()
    assert len(kept) == 9 and {r.original for r in kept if r.action == "add"} == {f"o{i}" for i in range(12, 20)}
    names = spark.createDataFrame([("案件1",), ("..",), ("a/b",), (" a",), ("",)], "n string")
    assert [r[0] for r in names.select(samples.valid_case_name(F.col("n"))).collect()] == [True, False, False, False, False]
    urls = spark.createDataFrame([("https://h/channels/1/1234567",), ("https://h/x",)], "u string")
    assert [r[0] for r in urls.select(samples.thread_id(F.col("u"))).collect()] == ["1234567", None]
    found = spark.createDataFrame([("d1", "x"), ("d1", "y"), ("d2", "x"), ("d2", "z")], "folder string, name string")
    want = spark.createDataFrame([("x",), ("y",), ("w",)], "name string")
    assert [tuple(r) for r in samples.suggest_locations(found, want).collect()] == [("d1", 2, 0.67, "unique")]
    assert {r.state for r in samples.suggest_locations(found, want.where("name = 'x'")).collect()} == {"ambiguous"}


def test_renumber_and_classify(spark):
    rows = [("m", 0, "person", "张三", "张某丙"), ("m", 1, "person", "张四", "张某甲"), ("m", 2, "organization", "x", "丁公司"), ("m", 3, "organization", "y", "12公司"), ("m", 4, "organization", "x2", "丁公司"), ("m", 5, "id", "z", "***")]
    m = spark.createDataFrame(rows, "map_id string, ord int, type string, original string, masked string")
    assert [r.masked for r in review.renumber(m).orderBy("ord").collect()] == ["张某甲", "张某乙", "甲公司", "乙公司", "甲公司", "***"]
    e = m.where("original <> 'z'").withColumn("masked", F.when(F.col("original") == "x", "new").otherwise(F.col("masked")))
    assert {r.state for r in review.classify_rows(e, m).where("original IN ('x', 'z')").collect()} == {"modified", "deleted"}


def test_values_that_reports_must_not_carry(spark):
    r = spark.createDataFrame([(1, '{"a": "张三", "b": "/root/x", "c": "ok"}'), (2, '{"a": "fine"}')], "id int, report string")
    assert {tuple(x) for x in reports.unsafe_values(r, "id", "report").collect()} == {(1, "chinese_text"), (1, "absolute_path")}
