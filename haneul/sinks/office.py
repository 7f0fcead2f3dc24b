"""Writing workbooks and documents: a file per group of rows, made whole in the task that has the group."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from ..sources.office_source import _system

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def _column(i: int) -> str:
    """0 is A, 26 is AA."""
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def workbook(cells: pd.DataFrame) -> bytes:
    """A workbook of cells (sheet, row from 1, col from 0, value); sheets in order of their names."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        sheets = list(cells.groupby("sheet"))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        for i, (_, own) in enumerate(sheets, 1):
            rows = "".join(f'<row r="{r}">' + "".join(f'<c r="{_column(c)}{r}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for c, v in sorted(zip(x["col"], x["value"]))) + "</row>" for r, x in own.groupby("row"))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def document(cells: pd.DataFrame) -> bytes:
    """A document of sections: in each a heading paragraph (row 0), then a table of cells (section, row from 1, col from 0, value)."""
    p = lambda t: f"<p><run><t>{escape(t)}</t></run></p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, own in cells.groupby("section"):
            heads = "".join(p(v) for v in own[own["row"] == 0]["value"])
            rows = "".join("<tr>" + "".join(f"<tc>{p(v)}</tc>" for _, v in sorted(zip(x["col"], x["value"]))) + "</tr>" for r, x in own.groupby("row") if r)
            z.writestr(f"Contents/section{n}.xml", f'<sec xmlns="h">{heads}<p><run><tbl>{rows}</tbl></run></p></sec>')
    return out.getvalue()


def write_files(df: DataFrame, file: str, folder: str, make: Callable[[pd.DataFrame], bytes], suffix: str) -> DataFrame:
    """Write one file per value of `file` into a folder that all executors share; returns (file, bytes). A file is
    put in its place by a rename, so a task that is run again leaves one whole file."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import uuid

        name, data = str(rows[file].iloc[0]), make(rows)
        system, where = _system(folder)
        system.create_dir(where, recursive=True)
        part = f"{where}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(data)
        system.move(part, f"{where}/{name}{suffix}")
        return pd.DataFrame([(name, len(data))], columns=["file", "bytes"])

    return df.groupBy(file).applyInPandas(run, "file string, bytes long")
