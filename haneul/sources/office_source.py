"""Office files as a Spark data source: `spark.read.format("office").option("kind", ...).load(path)`.

kind is cells (of workbooks), paragraphs or tables (of documents). Every sheet and every section is a
partition of its own, so a workbook of many sheets is read by many tasks, and each task opens only
its own part of the zip file; planning reads each file's directory alone. A filter on the sheet's name (equal, or one of several) is pushed down to the
partitions: other sheets aren't opened. As a stream, the source yields the files that were added
since its last offset - the time and path of the newest file - so files must be put there whole, by a
rename, and with times that don't go back.

The path is a file or a folder (read whole, below it too) that Python's Arrow file systems reach: local
or mounted, hdfs://, s3:// and so on. For stores that only Spark reads there is office.read_sheets().
A file that isn't a zip file fails the read; a folder without such files is an empty table.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from . import office

KINDS = {"cells": (office.CELLS, (".xlsx", ".xlsm")), "paragraphs": (office.PARAGRAPHS, (".hwpx",)), "tables": (office.TABLES, (".hwpx",))}


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def listed(path: str, kind: str) -> list[tuple[int, str]]:
    """(time in nanoseconds, path) of the files below a path, by time."""
    system, where = _system(path)
    info = system.get_file_info(where)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns, f.path) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(KINDS[kind][1]))


@dataclass
class Part(InputPartition):
    """A sheet (name and file in the zip) or a section (number) of a file."""

    path: str
    name: str
    at: str


def parts_of(root: str, path: str, kind: str, sheets: set[str] | None = None) -> list[Part]:
    """The parts of a file, from its zip directory and, of a workbook, from its list of sheets."""
    with _system(root)[0].open_input_file(path) as f, zipfile.ZipFile(f) as z:
        if kind == "cells":
            return [Part(path, name, at) for name, at in office._sheet_files(z) if sheets is None or name in sheets]
        return [Part(path, "", str(n)) for n in office.section_numbers(z)]


def read_part(root: str, part: InputPartition | None, kind: str) -> Iterator[tuple]:
    if not isinstance(part, Part):
        return  # Spark's one empty partition, where there is none
    with _system(root)[0].open_input_file(part.path) as f, zipfile.ZipFile(f) as z:
        if kind == "cells":
            yield from ((part.path, part.name, *cell) for cell in office.cells_of(z, part.at, office.shared_strings(z)))
            return
        paragraphs, cells = office.section_of(z, int(part.at))
        rows = cells if kind == "tables" else ((k, text) for k, (_, text) in enumerate(paragraphs))
        yield from ((part.path, int(part.at), *row) for row in rows)


def _planned(root: str, paths: list[str], kind: str, sheets: set[str] | None) -> list[Part]:
    return [part for path in paths for part in parts_of(root, path, kind, sheets)]


class OfficeReader(DataSourceReader):
    def __init__(self, root: str, kind: str) -> None:
        self.root, self.kind, self.sheets = root, kind, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            named = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if self.kind == "cells" and named is not None and f.attribute == ("sheet",):
                self.sheets = named if self.sheets is None else self.sheets & named
            else:
                yield f

    def partitions(self) -> list[Part]:
        return _planned(self.root, [p for _, p in listed(self.root, self.kind)], self.kind, self.sheets)

    def read(self, partition: Part) -> Iterator[tuple]:
        return read_part(self.root, partition, self.kind)


class OfficeStream(DataSourceStreamReader):
    def __init__(self, root: str, kind: str) -> None:
        self.root, self.kind = root, kind

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.root, self.kind)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Part]:
        after, until = ((x["time"], x["path"]) for x in (start, end))
        return _planned(self.root, [p for t, p in listed(self.root, self.kind) if after < (t, p) <= until], self.kind, None)

    def read(self, partition: Part) -> Iterator[tuple]:
        return read_part(self.root, partition, self.kind)

    def commit(self, end: dict) -> None:
        pass


class OfficeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "office"

    def _kind(self) -> str:
        kind = self.options.get("kind", "cells")
        if kind not in KINDS:
            raise ValueError(f"kind is one of {', '.join(KINDS)}")
        return kind

    def schema(self) -> str:
        return KINDS[self._kind()][0]

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(self.options["path"], self._kind())

    def streamReader(self, schema) -> OfficeStream:
        return OfficeStream(self.options["path"], self._kind())


def register(spark: SparkSession) -> None:
    """Make the source known to a session, with filters pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(OfficeSource)
