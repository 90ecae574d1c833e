"""Office files rewritten in tasks: formatting and all other bytes stay."""

import io
import re
import time
import zipfile
from unittest import mock
from xml.etree import ElementTree
from xml.parsers import expat

import pytest
from pyspark.sql import functions as F

from inkveil.sources import office, office_write

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:x="urn:x"'
MAP = "ord int, type string, original string, masked string, restore_original string"


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, raw in parts.items():
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 2, 3, 4, 6)), raw, zipfile.ZIP_DEFLATED if name.endswith("xml") else zipfile.ZIP_STORED)
    return out.getvalue()


def parts_of(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


def r(text, style=""):
    return f"<w:r>{style}<w:t>{text}</w:t></w:r>"


BOLD = "<w:rPr><w:b/></w:rPr>"


def test_word_files_keep_formatting_and_other_parts(spark):
    cell = f"<w:tc><w:p>{r('cell 甲公')}{r('司', BOLD)}</w:p><w:tbl><w:tr><w:tc><w:p>{r('甲某')}</w:p></w:tc></w:tr></w:tbl></w:tc>"
    body = (
        f'<?xml version="1.0" encoding="UTF-8"?><w:document {W}><w:body><!-- 甲某 --><w:p x:a="甲某>"><w:pPr><w:tabs><w:tab w:pos="1"/></w:tabs></w:pPr>{r("甲")}{r("某 and ", BOLD)}{r("甲某甲某")}</w:p>'
        f"<w:tbl><w:tr>{cell}</w:tr></w:tbl><w:p><w:hyperlink>{r('甲某')}</w:hyperlink><w:r><w:t>a&amp;b</w:t><w:tab/><w:t>&lt;甲公司&gt;</w:t><w:br/><w:drawing/></w:r></w:p>"
        f"<w:p><w:r><w:pict><w:txbxContent><w:p>{r('甲某')}</w:p></w:txbxContent></w:pict></w:r></w:p><w:p/><w:p>{r('')}</w:p></w:body></w:document>"
    )
    header = f"<w:hdr {W}><w:p>{r('甲某')}</w:p></w:hdr>"
    data = package({"word/document.xml": body, "word/header1.xml": header, "word/footnotes.xml": header, "media/甲某.bin": b"\x00\xff", "[Content_Types].xml": "<Types/>"})
    maps = spark.createDataFrame([(0, "person", "欧阳\n锋 & co", "甲某", None), (1, "organization", "星河", "甲公司", "星河建设有限公司"), (2, "organization", "星", "甲公司", None), (3, "person", "x", "", None)], MAP)
    files = spark.createDataFrame([(1, data), (2, b"no zip"), (3, None), (4, package({"word/document.xml": "<w:broken"}))], "id int, content binary")
    rows = {x.id: x for x in office_write.restore_word_files(files, maps).collect()}
    assert (rows[2].restored, rows[2].error, rows[3].error, rows[4].error) == (None, "BadZipFile", "no content", "ExpatError")
    new, old = parts_of(bytes(rows[1].restored)), parts_of(data)
    assert list(new) == list(old) and all(new[n] == old[n] for n in old if n not in ("word/document.xml", "word/header1.xml"))
    name = '<w:t xml:space="preserve">欧阳</w:t><w:br/><w:t xml:space="preserve">锋 &amp; co</w:t>'
    done = new["word/document.xml"].decode()
    assert done.startswith(body[: body.index(r("甲"))]) and rows[1].n_restored == 7
    assert f'<w:r>{name}</w:r><w:r>{BOLD}<w:t xml:space="preserve"> and </w:t></w:r><w:r><w:t xml:space="preserve">欧阳</w:t><w:br/><w:t xml:space="preserve">锋 &amp; co欧阳</w:t><w:br/>' in done
    assert '<w:t xml:space="preserve">cell 星河建设有限公司</w:t></w:r><w:r><w:rPr><w:b/></w:rPr></w:r>' in done
    assert "<w:hyperlink>" + r("甲某") in done and f"<w:txbxContent><w:p>{r('甲某')}" in done
    assert '<w:t>a&amp;b</w:t><w:tab/><w:t xml:space="preserve">&lt;星河建设有限公司&gt;</w:t><w:br/><w:drawing/>' in done
    assert "欧阳" in new["word/header1.xml"].decode()
    keyed = maps.withColumn("id", F.lit(9))
    assert {x.id: x.n_restored for x in office_write.restore_word_files(files.where("id = 1"), keyed, on="id").collect()} == {1: 0}


def test_word_writer_and_reader_agree(spark):
    texts = ["a\tb\nc", "", "x & <y>", "bad \x01 char", None, "one\rtwo", "長い" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, redacted string")
    rows = office_write.word_files(docs, run_chars=3).withColumn("t", office.office_text("content", F.lit("docx"))).collect()
    for x in rows:
        assert x.t.text == (None if x.redacted is None else x.redacted.replace("\x01", "�"))


MASKS = [{"k": "[A]", "v": "tion"}, {"k": "[B]", "v": "a\tb & \x7f"}, {"k": "[BB]", "v": ""}]


def test_a_long_line_is_restored_in_time_in_proportion_to_it():
    line = "na[A] [B]c word " * 5000
    data = office_write.word_file(line, 7)
    start = time.process_time()
    done, n = office_write.restored_word_file(data, MASKS)
    assert time.process_time() - start < 8  # 20 s and more when every run was held against every mask of its line
    assert n == 10000 and office._docx(done) == line.replace("[A]", "tion").replace("[B]", "a\tb & \x7f")


def test_empty_elements_end_with_their_tags():
    body = f"<w:document {W}><w:body>\n<w:p/>\n<w:p><w:r><w:t>[</w:t><w:t/></w:r>\n<w:r><w:t>A]</w:t><w:tab/>\n<w:t>[A</w:t><w:br/></w:r>{r(']')}</w:p></w:body></w:document>"
    done, n = office_write.restored_word_file(package({"word/document.xml": body}), [{"k": "[A]", "v": "tion"}, {"k": "[A\n]", "v": "x"}])
    assert n == 2 and office._docx(done) == "\ntion\tx"
    assert parts_of(done)["word/document.xml"].decode().endswith('\n<w:r><w:tab/>\n<w:t xml:space="preserve">x</w:t></w:r><w:r></w:r></w:p></w:body></w:document>')


JOINT = '</w:t></w:r><w:r><w:t xml:space="preserve">'
JOINED = {
    "masks cut by joints": f"<w:p><w:r><w:t>x[{JOINT}A{JOINT}]y{JOINT}&quot;{JOINT}[B{JOINT}]</w:t></w:r></w:p>",
    "empty runs": f"<w:p><w:r><w:t>{JOINT}[A{JOINT}{JOINT}]{JOINT}{JOINT}[BB]{JOINT}</w:t></w:r><w:r><w:t/></w:r></w:p>",
    "tabs and formatted runs between": f"<w:p>{r(f'[{JOINT}')}{r('A', BOLD)}<w:r><w:t>]{JOINT}[B</w:t><w:tab/><w:t>]{JOINT}[B]</w:t></w:r></w:p>",
    "links and text boxes": f"<w:p><w:hyperlink>{r(f'[A{JOINT}]')}</w:hyperlink><w:r><w:pict><w:p>{r(f'a{JOINT}[A]')}</w:p></w:pict></w:r>{r(f'[B{JOINT}]')}</w:p>",
    "tables": f"<w:tbl><w:tr><w:tc><w:p>{r(f'[A{JOINT}]')}</w:p></w:tc></w:tr></w:tbl><w:p>{r(f'b{JOINT}c')}</w:p>",
    "the mark itself": f"<w:p>{r(f'x{chr(127)}[A{JOINT}]')}</w:p>",
    "the mark as a reference": f"<w:p>{r(f'x&#127;[A{JOINT}]')}</w:p>",
    "a reference besides a mark astray": f"<w:p>{r(f'&#x07F;<w:x></w:x>{JOINT}[A{JOINT}]')}</w:p>",
    "all marks": f"<w:p>{r(f'{chr(127)}{chr(0x1FFFE)}{chr(0x2FFFE)}[A{JOINT}]')}</w:p>",
    "no tags but their letters": f"<w:p><w:r><w:t><![CDATA[[A{JOINT}]]]></w:t></w:r></w:p>",
    "a comment": f"<w:p><!--{JOINT}-->{r(f'[A{JOINT}]')}</w:p>",
    "an instruction": f"<w:p><?x {JOINT}?>{r(f'[A{JOINT}]')}</w:p>",
    "an element in a text": f"<w:p>{r(f'[A<w:x/>{JOINT}]<w:x/>[A]')}</w:p>",
    "a run in a text": f"<w:p>{r(f'[<w:r><w:t>A{JOINT}]</w:t></w:r>A{JOINT}]')}</w:p>",
    "a prefix of two meanings": f'<w:p><w:r xmlns:w="urn:y"><w:t>[A{JOINT}]</w:t></w:r></w:p>',
    "other elements": f"<w:p><x:r><x:t>{JOINT}</x:t></x:r></w:p>",
    "texts outside runs": f"<w:p><w:t>[A{JOINT}]</w:t></w:p>",
    "a broken element": f"<w:p><w:b>{JOINT}</w:b></w:p>",
    "a broken reference": f"<w:p>{r(f'&am{JOINT}p;')}</w:p>",
    "a value that is tags": f'<w:p x:a="{JOINT}">{r("[A]")}</w:p>',
}


def test_a_pattern_replaces_as_places_do():
    maps = [[{"k": "[A]", "v": "tion"}, {"k": "[BB]", "v": "乙"}, {"k": "[B", "v": ""}, {"k": "[A]", "v": "no"}], [{"k": "aa", "v": "b"}, {"k": "xa", "v": "c"}]]
    for k, rows in enumerate(maps):
        for text in ("[A]y[BB]z[B]", "[[A]][A", "xaaaa", "[A]", "no masks", "é[BB]é"):
            data = office_write.word_file(text, 2)
            joined = office_write.restored_word_file(data, rows)
            with mock.patch.object(office_write, "_swap", lambda *x: None):
                assert (parts_of(joined[0]), joined[1]) == (lambda d, n: (parts_of(d), n))(*office_write.restored_word_file(data, rows)), (k, text)


@pytest.mark.parametrize("name", JOINED)
def test_joined_runs_are_as_those_parsed_one_by_one(name):
    data = package({"word/document.xml": f"<w:document {W}><w:body>{JOINED[name]}</w:body></w:document>"})

    def outcome(work):
        try:
            return work()
        except (expat.ExpatError, ElementTree.ParseError) as e:
            return type(e)

    both = lambda: (outcome(lambda: office._docx(data)), outcome(lambda: office_write.restored_word_file(data, MASKS)))
    joined = both()
    with mock.patch.object(office, "joined_runs", lambda raw: (raw, "", 0)), mock.patch.object(office_write, "joined_runs", lambda raw: (raw, "", 0)):
        assert both() == joined


NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def book(formula="1+1", sheet_two=""):
    return package({
        "[Content_Types].xml": '<Types><Override PartName="/xl/workbook.xml" ContentType="application/vnd.ms-excel.sheet.macroEnabled.main+xml"/><Override PartName="/xl/vbaProject.bin" ContentType="application/vnd.ms-office.vbaProject"/></Types>',
        "xl/workbook.xml": f'<workbook {NS}><sheets><sheet name="First" sheetId="1" r:id="rId2"/><sheet name="二" sheetId="2" r:id="rId1"/></sheets><calcPr calcId="5"/><extLst/></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Target="/xl/worksheets/b.xml"/><Relationship Id="rId2" Target="worksheets/sheet1.xml"/><Relationship Id="rId9" Type="http://schemas.microsoft.com/office/2006/relationships/vbaProject" Target="vbaProject.bin"/></Relationships>',
        "xl/vbaProject.bin": "张三".encode(),
        "xl/worksheets/sheet1.xml": f'<worksheet {NS}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1"><f>{formula}</f><v>2</v></c><c r="D1" t="str"><f>A1</f><v>张三</v></c><c r="E1" t="inlineStr"><is><r><t>李</t></r><r><t>四 x</t></r></is></c><c r="F1" t="str"><v>张三 &amp; y</v></c><c r="G1" t="s" s="3"/></row></sheetData></worksheet>',
        "xl/worksheets/b.xml": f'<worksheet {NS}><sheetData>{sheet_two}<row><c r="A9" t="s"><v>0</v></c></row></sheetData></worksheet>',
        "xl/sharedStrings.xml": f'<sst {NS}><si><r><t>张</t></r><r><rPr><b/></rPr><t>三</t></r><rPh><t>zhang</t></rPh></si><si><t>plain 张</t></si></sst>',
        "xl/comments1.xml": "<c>张三</c>",
    })


def test_workbooks(spark):
    maps = spark.createDataFrame([(0, "person", "张三", "甲某", None), (1, "person", "李四", "<乙>", None)], MAP)
    shared = '<row><c r="A1"><f t="shared" si="0" ref="A1:A2">"张三"&amp;B1</f></c><c r="A2"><f t="shared" si="0"/></c><c r="A3"><f>"fine"</f></c></row>'
    files = spark.createDataFrame([(1, book()), (2, book(formula="IF(A1=&quot;李四&quot;,1,2)", sheet_two=shared)), (3, b"x"), (4, None)], "id int, content binary")
    rows = {x.id: x for x in office_write.redact_workbooks(files, maps).collect()}
    assert rows[2].formula_locations == ["First!C1", "二!A1", "二!A2"] and rows[2].redacted is None and rows[2].error is None
    assert rows[3].error == "BadZipFile" and rows[4].error == "no content"
    done, old = parts_of(bytes(rows[1].redacted)), parts_of(book())
    assert rows[1].n_cells == 4 and "xl/vbaProject.bin" not in done
    assert b"macroEnabled" not in done["[Content_Types].xml"] and b"vba" not in done["[Content_Types].xml"] + done["xl/_rels/workbook.xml.rels"]
    sheet = done["xl/worksheets/sheet1.xml"].decode()
    assert '<is><t xml:space="preserve">&lt;乙&gt; x</t></is>' in sheet and "<v>甲某 &amp; y</v>" in sheet and '<c r="D1" t="str"><f>A1</f></c>' in sheet and '<c r="C1"><f>1+1</f><v>2</v></c>' in sheet
    assert done["xl/sharedStrings.xml"].decode() == f'<sst {NS}><si><t xml:space="preserve">甲某</t></si><si><t>plain 张</t></si></sst>'
    assert done["xl/comments1.xml"] == old["xl/comments1.xml"] and done["xl/worksheets/b.xml"] == old["xl/worksheets/b.xml"]
    assert re.findall(rb"<calcPr[^>]*/><extLst/>", done["xl/workbook.xml"]) == [b'<calcPr calcMode="auto" fullCalcOnLoad="1" forceFullCalc="1" calcCompleted="0"/><extLst/>']
    keyed = maps.withColumn("id", F.lit(2))
    assert {x.id: (x.n_cells, len(x.formula_locations)) for x in office_write.redact_workbooks(files.where("id < 3"), keyed, on="id").collect()} == {1: (0, 0), 2: (0, 3)}
    assert office_write.redact_workbooks(files.limit(0), maps).count() == 0
