"""Text of office files, and gazetteer rows from plain listings."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkveil.functions.pieces import each_row

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
#: From the text of a plain run to that of the next.
BETWEEN_RUNS = b'</w:t></w:r><w:r><w:t xml:space="preserve">'
_MARKS = ("\x7f", "\U0001fffe", "\U0002fffe")
#: What keeps runs apart: a place that only looks like tags, runs or texts of other names, a second meaning of the prefix.
_APART = re.compile(rb"<(?:!|(?!w:)(?:[^\s<>/]*:)?[rt][\s/>])")
_PREFIX_BOUND = re.compile(rb"xmlns:w\b")
_REFERENCE = re.compile(rb"&#(?:x0*([0-9a-fA-F]{1,6})|0*([0-9]{1,7}));")


def joined_runs(raw: bytes) -> tuple[bytes, str, int]:
    """A Word part with plain runs that follow one another as one, a mark at each joint; the mark, and how many there are.

    It is right only if it can be parsed and all marks are in texts of runs: then the part itself can be, with the same
    elements, texts cut at the marks. Else it is not to be used.
    """
    mark = next((m for m in _MARKS if m.encode() not in raw), None)
    joined = raw.replace(BETWEEN_RUNS, mark.encode()) if mark else raw
    if len(joined) == len(raw) or _APART.search(joined) or len(_PREFIX_BOUND.findall(joined)) > 1:
        return raw, "", 0
    if any(ord(mark) == (int(a, 16) if a else int(b)) for a, b in _REFERENCE.findall(joined)):
        return raw, "", 0
    return joined, mark, joined.count(mark.encode())


def _document(raw: bytes) -> tuple[ElementTree.Element, str]:
    """A Word part parsed, and the mark that is to be taken out of its texts."""
    joined, mark, n = joined_runs(raw)
    if n:
        try:
            whole = ElementTree.fromstring(joined)
        except ElementTree.ParseError:
            return ElementTree.fromstring(raw), ""
        if sum((t.text or "").count(mark) for r in whole.iter(f"{_WORD}r") for t in r if t.tag == f"{_WORD}t") == n:
            return whole, mark
    return ElementTree.fromstring(raw), ""


def _docx(data: bytes) -> str:
    """Paragraphs outside tables, then those of the tables' cells."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, mark = _document(z.read("word/document.xml"))
    inside = {p for table in body.iter(f"{_WORD}tbl") for p in table.iter(f"{_WORD}p")}
    signs = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}
    line = lambda p: "".join(t.text or "" if t.tag == f"{_WORD}t" else signs.get(t.tag, "") for r in p.iter(f"{_WORD}r") for t in r)
    every = list(body.iter(f"{_WORD}p"))
    text = "\n".join([line(p) for p in every if p not in inside] + [line(p) for p in every if p in inside])
    return text.replace(mark, "") if mark else text


def _xlsx(data: bytes) -> str:
    """Text cells that are no formulas, sheet by sheet, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        out = []
        for name in sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1])):
            for cell in ElementTree.fromstring(z.read(name)).iter(f"{_SHEET}c"):
                value = cell.find(f"{_SHEET}v")
                if cell.find(f"{_SHEET}f") is not None:
                    continue
                if cell.get("t") == "s" and value is not None:
                    out.append(shared[int(value.text)])
                elif cell.get("t") == "inlineStr":
                    out.append("".join(t.text or "" for t in cell.iter(f"{_SHEET}t")))
    return "\n".join(x for x in out if x)


def _office_row(data: bytes | None, suffix: str | None) -> dict:
    reader = {"docx": _docx, "xlsx": _xlsx, "xlsm": _xlsx}.get(suffix)
    try:
        return {"text": reader(data), "error": None} if reader and data is not None else {"text": None, "error": "unsupported"}
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError, IndexError) as e:
        return {"text": None, "error": type(e).__name__}


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())]))
def office_text(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """The text of docx, xlsx and xlsm files, or why there is none."""
    yield from each_row(batches, _office_row, pa.struct([("text", pa.string()), ("error", pa.string())]))


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, suffix, text, error) of office files; hidden copies (._name) are skipped."""
    files = spark.read.format("binaryFile").load(path).withColumns({"source_file": F.regexp_extract("path", "([^/]+)$", 1), "suffix": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})
    wanted = files.where(F.col("suffix").isin("docx", "xlsx", "xlsm") & ~F.col("source_file").startswith("._"))
    return wanted.select("source_file", "suffix", office_text("content", "suffix").alias("t")).select("source_file", "suffix", "t.text", "t.error")


def listed_divisions(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, urban_rural_code, name) from lines of a twelve-digit code, an optional three-digit class and a name."""
    line = r"(?m)^\s*(\d{12})\s+(?:(\d{3})\s+)?([^\s<]{1,40})"
    column = lambda k: F.regexp_extract_all(F.col(text_col), F.lit(line), F.lit(k))
    rows = pages.select(F.explode(F.arrays_zip(column(1).alias("code"), column(2).alias("kind"), column(3).alias("name"))).alias("r"))
    return rows.select("r.code", F.nullif(F.col("r.kind"), F.lit("")).alias("urban_rural_code"), "r.name")


def html_text(html: Column) -> Column:
    """The text of a page: scripts, styles and tags taken out, the common entities resolved, spaces run together."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)<(?:br|/p|/tr|/div|/li|/h[1-6])\b[^>]*>", "\n"), "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(F.regexp_replace(bare, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
