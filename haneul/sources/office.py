"""Sheets and paragraphs of office files (zip with XML). Spark deals the files; a task opens one at a time."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

CELLS = "path string, sheet string, row int, col int, value string"
PARAGRAPHS = "path string, section int, k int, text string"
TABLES = "path string, section int, tab int, row int, col int, value string"


def _events(file) -> Iterator[tuple[str, str, ElementTree.Element]]:
    """(start or end, name without its namespace, element) in document order; ended elements keep no children."""
    for what, e in ElementTree.iterparse(file, ("start", "end")):
        yield what, e.tag.rpartition("}")[2], e


def _attribute(e: ElementTree.Element, name: str) -> str | None:
    """An attribute whatever its namespace."""
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _shown(e: ElementTree.Element) -> str:
    """The text of a string item or an inline string: of its own and its runs, not of its readings."""
    parts = [t for x in e for t in ([x] if x.tag.endswith("}t") or x.tag == "t" else list(x) if x.tag.rpartition("}")[2] == "r" else [])]
    return "".join(t.text or "" for t in parts if t.tag.rpartition("}")[2] == "t")


def _sheet_files(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, file) of the sheets in the workbook's order. The workbook names a relationship for each sheet, and
    that names the file; only a workbook without relationships leaves the files' numbers."""
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        for e in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            where = e.get("Target", "")
            targets[e.get("Id")] = where.lstrip("/") if where.startswith("/") else posixpath.normpath(f"xl/{where}")
    sheets = [e for what, name, e in _events(z.open("xl/workbook.xml")) if what == "end" and name == "sheet"]
    return [(e.get("name"), targets.get(_attribute(e, "id"), f"xl/worksheets/sheet{i}.xml")) for i, e in enumerate(sheets, 1)]


def place(ref: str) -> tuple[int, int]:
    """(row counted from 1, column counted from 0) of a cell's reference: C7 is (7, 2)."""
    letters = ref.rstrip("0123456789")
    return int(ref[len(letters) :]), sum((ord(c) - 64) * 26**i for i, c in enumerate(reversed(letters))) - 1


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in z.namelist():
        return []
    return [_shown(e) for what, name, e in _events(z.open("xl/sharedStrings.xml")) if what == "end" and name == "si"]


def cells_of(z: zipfile.ZipFile, file: str, strings: list[str]) -> Iterator[tuple[int, int, str]]:
    """(row, column, text) of one sheet's cells that aren't blank."""
    value = inline = ""
    for what, name, e in _events(z.open(file)):
        if what == "start":
            continue
        if name == "v":
            value = e.text or ""
        elif name == "is":
            inline = _shown(e)
        elif name == "c":
            text = strings[int(value)] if e.get("t") == "s" and value else inline or value
            if text:
                yield *place(e.get("r")), text
            value = inline = ""
        elif name == "row":
            e.clear()


def sheet_cells(data: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of a workbook's cells that aren't blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        strings = shared_strings(z)
        for sheet, file in _sheet_files(z):
            yield from ((sheet, *cell) for cell in cells_of(z, file, strings))


def _walk(file) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, str]]]:
    """(paragraphs, cells) of a section in one pass. Frames of open paragraphs, tables and cells are kept; text
    belongs to the innermost one, so a paragraph that holds a table has none of the table's text, and a table
    inside a cell is one of its own. A cell's paragraphs are joined by a space; paragraphs of cells are paragraphs too."""
    paragraphs, cells, open_ = [], [], []
    n_paragraphs = n_tables = 0
    for what, name, e in _events(file):
        if what == "start":
            if name == "p":
                open_.append({"kind": "p", "at": n_paragraphs, "text": []})
                n_paragraphs += 1
            elif name == "tbl":
                open_.append({"kind": "tbl", "at": n_tables, "row": -1, "col": -1})
                n_tables += 1
            elif name == "tr" and open_:
                open_[-1]["row"], open_[-1]["col"] = open_[-1].get("row", -1) + 1, -1
            elif name == "tc" and open_:
                open_[-1]["col"] = open_[-1].get("col", -1) + 1
                open_.append({"kind": "tc", "text": [], "paragraphs": []})
        elif name == "t" and open_ and "text" in open_[-1]:
            open_[-1]["text"].append(e.text or "")
        elif name in ("p", "tbl", "tc") and open_:
            own = open_.pop()
            if name == "p" and (text := " ".join("".join(own["text"]).split())):
                paragraphs.append((own["at"], text))
                if open_ and open_[-1]["kind"] == "tc":
                    open_[-1]["paragraphs"].append(text)
            elif name == "tc" and open_:
                table = open_[-1]
                cells.append((table["at"], table["row"], table["col"], " ".join(" ".join(own["paragraphs"] or own["text"]).split())))
    return sorted(paragraphs), cells


_HEAD, _TAIL = "Contents/section", ".xml"


def section_numbers(z: zipfile.ZipFile) -> list[int]:
    numbers = [n[len(_HEAD) : -len(_TAIL)] for n in z.namelist() if n.startswith(_HEAD) and n.endswith(_TAIL)]
    return sorted(int(n) for n in numbers if n.isdecimal())


def section_of(z: zipfile.ZipFile, number: int) -> tuple[list, list]:
    """(paragraphs, cells) of one section."""
    with z.open(f"{_HEAD}{number}{_TAIL}") as f:
        return _walk(f)


def _sections(data: bytes) -> Iterator[tuple[int, list, list]]:
    """(number, paragraphs, cells) of a document's sections, by number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for number in section_numbers(z):
            yield number, *section_of(z, number)


def paragraphs(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(section, place, text) of a document's paragraphs that aren't blank, in document order, those of tables too."""
    for number, found, _ in _sections(data):
        yield from ((number, k, text) for k, (_, text) in enumerate(found))


def tables(data: bytes) -> Iterator[tuple[int, int, int, int, str]]:
    """(section, table, row, column, text) of a document's tables; a table inside a cell is a table of its own."""
    for number, _, cells in _sections(data):
        yield from ((number, *cell) for cell in cells)


def _read(spark: SparkSession, path, of, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"]):
                yield pd.DataFrame([(p, *row) for row in of(bytes(data))], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_sheets(spark: SparkSession, path) -> DataFrame:
    return _read(spark, path, sheet_cells, CELLS)


def read_paragraphs(spark: SparkSession, path) -> DataFrame:
    return _read(spark, path, paragraphs, PARAGRAPHS)


def read_document_tables(spark: SparkSession, path) -> DataFrame:
    return _read(spark, path, tables, TABLES)
