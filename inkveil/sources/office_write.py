"""Writing office files: masks restored in Word files, entities masked in workbooks, all within tasks, bytes in and out.

Parts of a file are spliced in place: an XML part is scanned once for the byte ranges of its texts, and only ranges whose
text changes are written anew. Every other byte of a part, and every other part, stays as it is.
"""

from __future__ import annotations

import io
import re
import zipfile
from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate
from xml.parsers import expat
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkveil.functions.pieces import each_row, pieces
from inkveil.operators.replace import mapping_rows, replaced_places, restore_lookup, splice, with_entries
from inkveil.sources.office import BETWEEN_RUNS, joined_runs

_TAG = re.compile(rb"""<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")
_PREFIX = re.compile(rb"<([\w.-]+:)?")
_WORD_PART = re.compile(r"word/(?:document|header\d*|footer\d*)\.xml")
_SHEET_PART = re.compile(r"xl/worksheets/[^/]+\.xml")
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
#: What is no text of a single element as it is.
_NOT_PLAIN = re.compile("[\x00-\x1f&<>\ufffe\uffff]")
_HEAD = b'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_OFFICE, _PACKAGE = b"http://schemas.openxmlformats.org/", b"application/vnd.openxmlformats-officedocument."
#: Parents of paragraphs, and of the tables that lead to them.
_HOLDERS = {"body", "tc", "hdr", "ftr"}
_CHARACTERS = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
#: What may follow calcPr in a workbook part.
_AFTER_CALC = rb"<(?:\w+:)?(?:oleSize|customWorkbookViews|pivotCaches|smartTagPr|smartTagTypes|webPublishing|fileRecoveryPr|webPublishObjects|extLst)\b|</(?:\w+:)?workbook>"
_CALC = b'calcMode="auto" fullCalcOnLoad="1" forceFullCalc="1" calcCompleted="0"/>'

_TEXT, _TEXT_END = b'<w:t xml:space="preserve">', b"</w:t>"
#: Half the time of zlib's own choice, for files a tenth larger.
LEVEL = 3
#: A larger map is searched mask by mask.
SWAP_ENTRIES = 64

Edit = tuple[int, int, bytes]


def _scan(raw: bytes, opened: Callable, closed: Callable) -> None:
    """``opened(name, attributes, at, path)`` and ``closed(name, text, at, end, path)`` for every element: local names, byte
    places, the names of its ancestors, and the text directly in it."""
    parser, path, texts, starts = expat.ParserCreate(), [], [], []
    parser.buffer_text = True

    def start(name: str, attributes: dict) -> None:
        at, name = parser.CurrentByteIndex, name.rsplit(":", 1)[-1]
        opened(name, attributes, at, path)
        path.append(name), texts.append([]), starts.append(at)

    def end(name: str) -> None:
        at, begin = parser.CurrentByteIndex, starts.pop()
        empty = raw.endswith(b"/>", begin, at) and _TAG.match(raw, begin).end() == at  # an empty element ends where its tag does
        closed(path.pop(), "".join(texts.pop()), begin, at if empty else _TAG.match(raw, at).end(), path)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda s: texts[-1].append(s)
    parser.Parse(raw, True)


def _xml(text: str) -> bytes:
    """Text for XML; characters that XML cannot hold become the replacement character."""
    return escape(_NO_XML.sub("\ufffd", text), {"\r": "&#13;"}).encode()


def _spliced(raw: bytes, edits: list[Edit], kept: Callable[[bytes], bytes] = lambda x: x) -> bytes:
    """Bytes with ranges written anew; ``kept`` is applied to what stands between them."""
    out, at = [], 0
    for start, end, new in sorted(edits):
        out += [kept(raw[at:start]), new]
        at = end
    return b"".join([*out, kept(raw[at:])])


def _prefix(raw: bytes, at: int) -> bytes:
    return _PREFIX.match(raw, at)[1] or b""


def _rewritten(data: bytes, change: Callable[[str, bytes], bytes | None]) -> bytes:
    """The zip file with each part as ``change`` gives it (None: left out)."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as source, zipfile.ZipFile(out, "w") as target:
        for info in source.infolist():
            part = change(info.filename, source.read(info))
            if part is not None:
                target.writestr(info, part, info.compress_type, LEVEL)
    return out.getvalue()


def _run_text(prefix: bytes, text: str) -> bytes:
    """Content of a run: text with line breaks and tabs as elements."""
    if text and not _NOT_PLAIN.search(text):
        return b"<" + prefix + b't xml:space="preserve">' + text.encode() + b"</" + prefix + b"t>"
    out = []
    for piece in re.split("([\t\n])", text):
        if piece in ("\t", "\n"):
            out.append(b"<" + prefix + (b"tab/>" if piece == "\t" else b"br/>"))
        elif piece:
            out.append(b"<" + prefix + b't xml:space="preserve">' + _xml(piece) + b"</" + prefix + b"t>")
    return b"".join(out)


class _MarksAstray(Exception):
    """A mark of joined runs stands elsewhere than in the text of a run."""


def _edited(raw: bytes, start: int, stop: int, mark: bytes, n: int, edits: dict[int, bytes]) -> bytes:
    """The text element at a range, of ``n`` runs joined by marks, as an element of each run, some of which are given."""
    inner, close = _TAG.match(raw, start).end(), raw.rindex(b"</", start, stop)
    held = raw[inner:close].split(mark)
    whole = [_TEXT + x + _TEXT_END for x in held]
    if len(held) != n:
        raise _MarksAstray
    whole[0], whole[-1] = raw[start:inner] + held[0] + _TEXT_END, whole[-1].removesuffix(_TEXT_END) + raw[close:stop]
    for i, new in edits.items():
        whole[i] = new
    return b"</w:r><w:r>".join(whole)


def _restored_part(raw: bytes, rows: list[dict]) -> tuple[bytes, int]:
    """A Word part with the masks of its paragraphs' texts replaced, and how many there were.

    A paragraph's text is that of its runs; what a place replaces goes to the run where the place begins, with that run's
    formatting, and the rest of the place is taken out of the runs after it. Plain runs are parsed as one where they can be.
    """
    joined, mark, n = joined_runs(raw)
    if n:
        try:
            return _restored_runs(joined, rows, mark, n)
        except (_MarksAstray, expat.ExpatError):
            pass
    return _restored_runs(raw, rows)


@lru_cache(8)
def _swap(entries: tuple[tuple[str, str], ...], mark: str) -> Callable[[str], tuple[str, int]] | None:
    """A function that replaces the masks (key, value) of a small map in a text of joined runs, as _leftmost chooses them, and counts
    them; a value goes where its mask begins, joints within the mask behind it. None if masks may overlap themselves, or if
    values are no plain text."""
    values = dict(reversed(entries))
    if not values or len(values) > SWAP_ENTRIES or any(k.startswith(k[i:]) for k in values for i in range(1, len(k))):
        return None
    if any(mark in x or _NOT_PLAIN.search(x) for e in values.items() for x in e):
        return None
    pattern = re.compile("|".join(f"{mark}*".join(map(re.escape, k)) for k in sorted(values, key=len, reverse=True)))

    @lru_cache(1 << 12)
    def value(found: str) -> str:
        return values[found.replace(mark, "")] + mark * found.count(mark)

    return lambda text: pattern.subn(lambda m: value(m[0]), text)


def _restored_runs(raw: bytes, rows: list[dict], mark: str = "", n_marks: int = 0) -> tuple[bytes, int]:
    """:func:`_restored_part` of a part in which each of ``n_marks`` marks stands for the end of a plain run and the next one's beginning."""
    edits: list[Edit] = []
    found = seen = 0
    swap = _swap(tuple((r["k"], r["v"] or "") for r in rows if r["k"]), mark) if n_marks else None
    open_paragraphs: list[tuple[int, list[tuple[int, int, str]]]] = []  # depth, and (start, end, text) of the runs' pieces

    def opened(name: str, attributes: dict, at: int, path: list[str]) -> None:
        if name == "p" and path and path[-1] in _HOLDERS and all(x in _HOLDERS or x in ("document", "tbl", "tr") for x in path):
            open_paragraphs.append((len(path), []))

    def closed(name: str, text: str, at: int, end: int, path: list[str]) -> None:
        nonlocal found, seen
        if n_marks and name == "t" and path and path[-1] == "r" and mark in text:
            seen += text.count(mark)
        if not open_paragraphs:
            return
        depth, pieces = open_paragraphs[-1]
        if len(path) == depth + 2 and path[-1] == "r" and (name == "t" or name in _CHARACTERS):
            pieces.append((at, end, text if name == "t" else _CHARACTERS[name]))
        elif len(path) == depth and name == "p":
            open_paragraphs.pop()
            found += replaced(pieces)

    def swapped(start: int, stop: int, text: str) -> int | None:
        """:func:`replaced` of a paragraph of plain runs, all written as here, if none is left empty; else None."""
        begin, end = start + len(_TEXT), stop - len(_TEXT_END)
        if not swap or not raw.startswith(_TEXT, start) or _NOT_PLAIN.search(text) or raw[begin:stop] != text.encode() + _TEXT_END:
            return None
        new, n = swap(text)
        if n and (new[:1] in ("", mark) or new[-1] == mark or mark * 2 in new):
            return None
        if n:
            edits.append((begin, end, new.encode().replace(mark.encode(), BETWEEN_RUNS)))
        return n

    def replaced(pieces: list[tuple[int, int, str]]) -> int:
        if len(pieces) == 1 and (n := swapped(*pieces[0])) is not None:
            return n
        texts = [t.split(mark) if n_marks and mark in t else [t] for _, _, t in pieces]
        runs = [x for own in texts for x in own]
        chosen = _leftmost("".join(runs), rows)
        ends = list(accumulate(map(len, runs)))
        cut: dict[int, list[tuple[int, int, str]]] = {}
        for a, b, value in chosen:
            k = bisect_right(ends, a)
            begin = ends[k] - len(runs[k])
            while begin < b:
                cut.setdefault(k, []).append((max(a - begin, 0), min(b, ends[k]) - begin, value if begin <= a else ""))
                begin, k = ends[k], k + 1
                if k == len(runs):
                    break
        left, first = deque(cut), 0
        for (start, stop, _), own in zip(pieces, texts, strict=True):
            new = {}
            while left and left[0] < first + len(own):
                k = left.popleft()
                new[k - first] = _run_text(_prefix(raw, start), splice(runs[k], cut[k]))
            if new:
                edits.append((start, stop, new[0] if len(own) == 1 else _edited(raw, start, stop, mark.encode(), len(own), new)))
            if not left:
                break
            first += len(own)
        return len(chosen)

    _scan(raw, opened, closed)
    if seen != n_marks:
        raise _MarksAstray
    return _spliced(raw, edits, (lambda x: x.replace(mark.encode(), BETWEEN_RUNS)) if n_marks else (lambda x: x)), found


def _leftmost(text: str, rows: list[dict]) -> list[tuple[int, int, str]]:
    """Places of masks from the left, at each place the longest."""
    found = []
    for r in rows:
        at = text.find(r["k"]) if r["k"] else -1
        while at >= 0:
            found.append((at, -len(r["k"]), r["v"] or ""))
            at = text.find(r["k"], at + len(r["k"]))
    out, end = [], 0
    for at, size, value in sorted(found, key=lambda x: x[:2]):
        if at >= end:
            out.append((at, at - size, value))
            end = at - size
    return out


def restored_word_file(data: bytes, rows: list[dict]) -> tuple[bytes, int]:
    """A Word file with the masks (k) of a lookup restored (v) in its body, tables, headers and footers, and how many."""
    total = 0

    def change(name: str, raw: bytes) -> bytes:
        nonlocal total
        if not _WORD_PART.fullmatch(name):
            return raw
        part, n = _restored_part(raw, rows)
        total += n
        return part

    return _rewritten(data, change), total


def _sheet_names(parts: zipfile.ZipFile) -> dict[str, str]:
    """Titles of the worksheets' parts."""
    targets, titles = {}, {}
    ids = lambda n, a, at, path: targets.update({a["Id"]: a["Target"]}) if n == "Relationship" else None
    _scan(parts.read("xl/_rels/workbook.xml.rels"), ids, lambda *x: None)

    def sheet(name: str, attributes: dict, at: int, path: list[str]) -> None:
        if name == "sheet":
            target = targets.get(next((v for k, v in attributes.items() if k.endswith(":id")), None), "")
            titles[target.lstrip("/") if target.startswith("/") else "xl/" + target] = attributes.get("name", "")

    _scan(parts.read("xl/workbook.xml"), sheet, lambda *x: None)
    return titles


def _cells(raw: bytes) -> list[dict]:
    """Cells of a sheet: reference, type, formula, and the ranges and texts of what they show."""
    cells: list[dict] = []
    group = None

    def opened(name: str, attributes: dict, at: int, path: list[str]) -> None:
        nonlocal group
        if name == "c":
            cells.append({"ref": attributes.get("r", ""), "type": attributes.get("t", "n"), "formula": None, "group": None, "value": None, "inline": None, "runs": []})
        elif name == "f" and cells:
            group = attributes.get("si") if attributes.get("t") == "shared" else None
            cells[-1]["formula"], cells[-1]["group"] = "", group

    def closed(name: str, text: str, at: int, end: int, path: list[str]) -> None:
        if not cells or "c" not in path:
            return
        if name == "f":
            cells[-1]["formula"] = text
        elif name == "v":
            cells[-1]["value"] = (at, end, text)
        elif name == "t" and "rPh" not in path:
            cells[-1]["runs"].append(text)
        elif name == "is":
            cells[-1]["inline"] = (at, end)

    _scan(raw, opened, closed)
    return cells


def _redacted_sheet(raw: bytes, redact: Callable[[str], str]) -> tuple[bytes, int]:
    edits, changed = [], 0
    for cell in _cells(raw):
        if cell["formula"] is not None:
            if cell["value"] and cell["type"] == "str":  # the result is computed anew when the file is opened
                edits.append((*cell["value"][:2], b""))
        elif cell["type"] == "str" and cell["value"]:
            at, end, text = cell["value"]
            if redact(text) != text:
                prefix = _prefix(raw, at)
                edits.append((at, end, b"<" + prefix + b"v>" + _xml(redact(text)) + b"</" + prefix + b"v>"))
                changed += 1
        elif cell["inline"]:
            at, end = cell["inline"]
            text = "".join(cell["runs"])
            if redact(text) != text:
                prefix = _prefix(raw, at)
                edits.append((at, end, b"<" + prefix + b'is><' + prefix + b't xml:space="preserve">' + _xml(redact(text)) + b"</" + prefix + b"t></" + prefix + b"is>"))
                changed += 1
    return (_spliced(raw, edits) if edits else raw), changed


def _redacted_strings(raw: bytes, redact: Callable[[str], str]) -> tuple[bytes, set[int]]:
    """The shared strings, and the numbers of those that changed; a formatted one becomes plain."""
    edits, changed, runs = [], set(), []
    n = 0

    def closed(name: str, text: str, at: int, end: int, path: list[str]) -> None:
        nonlocal n
        if name == "t" and "rPh" not in path:
            runs.append(text)
        elif name == "si":
            whole = "".join(runs)
            runs.clear()
            new = redact(whole)
            if new != whole:
                prefix = _prefix(raw, at)
                edits.append((at, end, b"<" + prefix + b"si><" + prefix + b't xml:space="preserve">' + _xml(new) + b"</" + prefix + b"t></" + prefix + b"si>"))
                changed.add(n)
            n += 1

    _scan(raw, lambda *x: None, closed)
    return (_spliced(raw, edits) if edits else raw), changed


def _recalculating(raw: bytes) -> bytes:
    """The workbook part with everything computed anew on opening."""
    bare = re.sub(rb"<(?:\w+:)?calcPr\b[^>]*?(?:/>|>\s*</(?:\w+:)?calcPr>)", b"", raw)
    at = re.search(_AFTER_CALC, bare).start()
    return bare[:at] + b"<" + _prefix(raw, re.search(rb"<(?:\w+:)?workbook\b", raw).start()) + b"calcPr " + _CALC + bare[at:]


def formula_locations(data: bytes, originals: list[str]) -> list[str]:
    """``title!cell`` of formulas that hold one of the originals; cells of a shared formula are held to its text."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        names = set(parts.namelist())
        for part, title in _sheet_names(parts).items():
            shared: dict[str, str] = {}
            for cell in _cells(parts.read(part)) if part in names and _SHEET_PART.fullmatch(part) else ():
                text = cell["formula"]
                if text is None:
                    continue
                text = shared.setdefault(cell["group"], text) if cell["group"] is not None else text
                if any(o in "=" + text for o in originals):
                    out.append(f"{title}!{cell['ref']}")
    return out


def redacted_workbook(data: bytes, rows: list[dict]) -> tuple[bytes | None, list[str], int]:
    """(file, places of formulas that hold an original, changed cells); no file where there are such formulas.

    Text cells are redacted, cached texts of formulas and macros taken out.
    """
    places = formula_locations(data, [r["k"] for r in rows if r["k"]])
    if places:
        return None, places, 0
    redact = lambda t: splice(t, replaced_places(t, rows))
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        strings = _redacted_strings(parts.read("xl/sharedStrings.xml"), redact) if "xl/sharedStrings.xml" in parts.namelist() else (b"", set())
    changed = 0

    def change(name: str, raw: bytes) -> bytes | None:
        nonlocal changed
        if name == "xl/sharedStrings.xml":
            return strings[0]
        if name == "xl/vbaProject.bin":
            return None
        if name == "[Content_Types].xml":
            return re.sub(rb'<Override\b[^>]*PartName="/xl/vbaProject.bin"[^>]*/>', b"", raw).replace(b"application/vnd.ms-excel.sheet.macroEnabled.main+xml", b"application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml")
        if name == "xl/_rels/workbook.xml.rels":
            return re.sub(rb'<Relationship\b[^>]*vbaProject[^>]*/>', b"", raw)
        if name == "xl/workbook.xml":
            return _recalculating(raw)
        if _SHEET_PART.fullmatch(name):
            changed += sum(c["type"] == "s" and c["formula"] is None and c["value"] is not None and int(c["value"][2]) in strings[1] for c in _cells(raw))
            raw, n = _redacted_sheet(raw, redact)
            changed += n
        return raw

    return _rewritten(data, change), [], changed


def _package(parts: dict[str, bytes], types: dict[str, bytes], root: str) -> bytes:
    """A zip file of parts with their content types; ``root`` is the part that is opened."""
    overrides = b"".join(b'<Override PartName="/%s" ContentType="%s"/>' % (n.encode(), _PACKAGE + t) for n, t in types.items())
    head = {
        "[Content_Types].xml": _HEAD + b'<Types xmlns="%spackage/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>%s</Types>' % (_OFFICE, overrides),
        "_rels/.rels": _HEAD + _relations({"rId1": ("officeDocument", root)}),
    }
    out = io.BytesIO(_zipped(tuple(head.items())))
    with zipfile.ZipFile(out, "a") as target:
        for name, raw in parts.items():
            target.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_DEFLATED, LEVEL)
    return out.getvalue()


@lru_cache(8)
def _zipped(parts: tuple[tuple[str, bytes], ...]) -> bytes:
    """A zip file of the parts that many files share."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as target:
        for name, raw in parts:
            target.writestr(zipfile.ZipInfo(name), raw, zipfile.ZIP_DEFLATED, LEVEL)
    return out.getvalue()


def _relations(targets: dict[str, tuple[str, str]]) -> bytes:
    rows = b"".join(b'<Relationship Id="%s" Type="%sofficeDocument/2006/relationships/%s" Target="%s"/>' % (i.encode(), _OFFICE, kind.encode(), target.encode()) for i, (kind, target) in targets.items())
    return b'<Relationships xmlns="%spackage/2006/relationships">%s</Relationships>' % (_OFFICE, rows)


def _runs(line: str, texts: list[str]) -> bytes:
    """A plain run for each of the texts that a line is cut into."""
    if line and not _NOT_PLAIN.search(line):
        return b"<w:r>" + _TEXT + BETWEEN_RUNS.decode().join(texts).encode() + _TEXT_END + b"</w:r>"
    return b"".join(b"<w:r>" + _run_text(b"w:", x) + b"</w:r>" for x in texts)


def word_file(text: str, run_chars: int = 0) -> bytes:
    """A Word file with a paragraph for each line, in runs of ``run_chars`` characters (0: one run)."""
    cut = re.compile(f".{{1,{run_chars}}}", re.S).findall if run_chars else lambda line: [line]
    paragraphs = b"".join(b"<w:p>" + _runs(line, cut(line)) + b"</w:p>" for line in text.split("\n"))
    body = _HEAD + b'<w:document xmlns:w="%swordprocessingml/2006/main"><w:body>%s</w:body></w:document>' % (_OFFICE, paragraphs)
    return _package({"word/document.xml": body}, {"word/document.xml": b"wordprocessingml.document.main+xml"}, "word/document.xml")


def workbook_file(cells: list[str], formulas: list[str] = ()) -> bytes:
    """A workbook of one sheet: shared strings down column A, formulas down column B."""
    rows = []
    for i in range(max(len(cells), len(formulas))):
        text = b'<c r="A%d" t="s"><v>%d</v></c>' % (i + 1, i) if i < len(cells) else b""
        formula = b'<c r="B%d" t="str"><f>%s</f><v>old</v></c>' % (i + 1, _xml(formulas[i])) if i < len(formulas) else b""
        rows.append(b'<row r="%d">%s%s</row>' % (i + 1, text, formula))
    ns = b'xmlns="%sspreadsheetml/2006/main"' % _OFFICE
    parts = {
        "xl/workbook.xml": _HEAD + b'<workbook %s xmlns:r="%sofficeDocument/2006/relationships"><sheets><sheet name="Sheet1" sheetId="1" r:id="rId1"/></sheets></workbook>' % (ns, _OFFICE),
        "xl/_rels/workbook.xml.rels": _HEAD + _relations({"rId1": ("worksheet", "worksheets/sheet1.xml"), "rId2": ("sharedStrings", "sharedStrings.xml")}),
        "xl/worksheets/sheet1.xml": _HEAD + b"<worksheet %s><sheetData>%s</sheetData></worksheet>" % (ns, b"".join(rows)),
        "xl/sharedStrings.xml": _HEAD + b"<sst %s>%s</sst>" % (ns, b"".join(b'<si><t xml:space="preserve">%s</t></si>' % _xml(c) for c in cells)),
    }
    kinds = {"xl/workbook.xml": b"spreadsheetml.sheet.main+xml", "xl/worksheets/sheet1.xml": b"spreadsheetml.worksheet+xml", "xl/sharedStrings.xml": b"spreadsheetml.sharedStrings+xml"}
    return _package(parts, kinds, "xl/workbook.xml")


def word_files(docs: DataFrame, text_col: str = "redacted", out: str = "content", run_chars: int = 0) -> DataFrame:
    """``docs`` with each text as a Word file; a null text has none."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from each_row(((texts,) for texts in batches), lambda t: None if t is None else word_file(t, run_chars), pa.binary())

    return docs.withColumn(out, run(F.col(text_col)))


def workbook_files(rows: DataFrame, cells: str = "cells", formulas: str = "formulas", out: str = "content") -> DataFrame:
    """``rows`` with their arrays of texts and formulas as a workbook each; null arrays are empty."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from each_row(batches, lambda a, b: workbook_file([x or "" for x in a or ()], [x or "" for x in b or ()]), pa.binary())

    return rows.withColumn(out, run(F.col(cells), F.col(formulas)))


_BROKEN = (zipfile.BadZipFile, KeyError, ValueError, IndexError, AttributeError, expat.ExpatError, NotImplementedError, RuntimeError)


def _each_file(files: DataFrame, entries: DataFrame | None, rows: list[dict], content: str, on: str | None, made: str, work: Callable[[bytes, list[dict]], tuple]) -> DataFrame:
    """``files`` with the columns ``made`` (DDL), which ``work`` gives for a file and its map's rows, and ``error``."""
    joined, own_columns = with_entries(files, entries, on) if on else files, files.columns
    new = T.StructType.fromDDL(f"{made}, error string").fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (None,) * (len(new) - 1)
        for whole in batches:
            for batch in (whole.slice(lo, n) for lo, n in pieces(whole.column(content))):
                out = []
                for i, data in enumerate(batch.column(content)):
                    try:
                        own = (batch.column("__entries")[i].as_py() or []) if on else rows
                        out.append((*work(data.as_py(), own), None) if data.is_valid else (*nothing, "no content"))
                    except _BROKEN as e:
                        out.append((*nothing, type(e).__name__))
                columns = [pa.array([row[k] for row in out], to_arrow_type(f.dataType)) for k, f in enumerate(new)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own_columns), *columns], names=[*own_columns, *(f.name for f in new)])

    schema = T.StructType([*files.schema.fields, *new])
    return joined.mapInArrow(run, schema)


def restore_word_files(files: DataFrame, mappings: DataFrame, content: str = "content", on: str | None = None) -> DataFrame:
    """``files`` with ``restored`` (the Word file) and ``n_restored``, or ``error``. Mappings are those of ``restore``.

    Null contents and what is no Word file have an ``error`` and nothing else."""
    slim, rows = mapping_rows(restore_lookup(mappings, *([on] if on else [])), on, False, "masked", "original")
    return _each_file(files, slim, rows, content, on, "restored binary, n_restored bigint", restored_word_file)


def redact_workbooks(files: DataFrame, mappings: DataFrame, content: str = "content", on: str | None = None, guard: bool = True) -> DataFrame:
    """``files`` with ``redacted`` (the workbook), ``formula_locations``, ``n_cells`` and ``error``.

    A workbook whose formulas hold an original is refused: it has no ``redacted`` and the places in ``formula_locations``.
    Null contents and what is no workbook have an ``error`` and nothing else. Mappings are those of ``apply_mappings``.
    """
    slim, rows = mapping_rows(mappings, on, guard, "original", "masked")
    return _each_file(files, slim, rows, content, on, "redacted binary, formula_locations array<string>, n_cells bigint", redacted_workbook)
