"""Workbooks (.xlsx, .xlsm) as a Python data source: one row for each row of each sheet.

    spark.dataSource.register(WorkbookSource)
    spark.read.format("workbook").load("/folder")   # sheet, sheet_pos, row, cells

Each workbook is one partition; its sheets are streamed, so a large one is read
once and in bounded memory.
"""

from __future__ import annotations

import datetime
import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {14, 15, 16, 17, 22}


def column_number(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def cell_text(raw: str, kind: str, shared: list[str], is_date: bool) -> str:
    """Trimmed text; whole numbers without .0, dates as ISO days."""
    if kind == "s":
        return shared[int(raw)].strip()
    if kind in ("str", "inlineStr"):
        return raw.strip()
    if kind == "b":
        return "True" if raw == "1" else "False"
    if is_date:
        try:
            return (datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(raw))).strftime("%Y-%m-%d")
        except (ValueError, OverflowError):
            return raw
    try:
        number = float(raw)
    except ValueError:
        return raw.strip()
    return str(int(number)) if number.is_integer() else str(number)


def read_workbook(path: str) -> Iterator[tuple[str, int, int, list[str]]]:
    """(sheet, sheet_pos, row, cells) of every row with a cell."""
    with zipfile.ZipFile(path) as book:
        names = set(book.namelist())
        text = lambda node: "".join(t.text or "" for t in node.iter(f"{MAIN}t"))
        shared = [text(si) for si in ElementTree.parse(book.open("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in names else []
        date_styles = set()
        if "xl/styles.xml" in names:
            styles = ElementTree.parse(book.open("xl/styles.xml")).getroot()
            own = {int(f.get("numFmtId")) for f in styles.iter(f"{MAIN}numFmt") if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
            cells = styles.find(f"{MAIN}cellXfs")
            date_styles = {i for i, xf in enumerate(cells if cells is not None else []) if int(xf.get("numFmtId", 0)) in DATE_FORMATS | own}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
        for at, sheet in enumerate(ElementTree.parse(book.open("xl/workbook.xml")).iter(f"{MAIN}sheet")):
            target = targets[sheet.get(RELATION)].lstrip("/")
            with book.open(target if target.startswith("xl/") else f"xl/{target}") as stream:
                number = 0
                for _, node in ElementTree.iterparse(stream):
                    if node.tag != f"{MAIN}row":
                        continue
                    number = int(node.get("r", number + 1))
                    cells: list[str] = []
                    for c in node.iter(f"{MAIN}c"):
                        place = column_number(c.get("r")) if c.get("r") else len(cells) + 1
                        cells += [""] * (place - 1 - len(cells))
                        value = c.find(f"{MAIN}v")
                        raw = text(c) if c.get("t") == "inlineStr" else (value.text or "" if value is not None else "")
                        cells.append(cell_text(raw, c.get("t", "n"), shared, int(c.get("s", -1)) in date_styles) if raw else "")
                    if cells:
                        yield sheet.get("name"), at, number, cells
                    node.clear()


class WorkbookPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[WorkbookPartition]:
        found = [self.path] if os.path.isfile(self.path) else sorted(glob.glob(f"{glob.escape(self.path)}/**/*.xls[xm]", recursive=True))
        return [WorkbookPartition(p) for p in found if not os.path.basename(p).startswith(("~$", "."))]

    def read(self, partition: WorkbookPartition | None) -> Iterator[tuple]:
        if partition is None:  # a folder without workbooks
            return
        try:
            for sheet, at, row, cells in read_workbook(partition.path):
                yield partition.path, sheet, at, row, cells, None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as error:
            yield partition.path, None, None, None, None, f"The checklist workbook could not be parsed safely ({type(error).__name__})."


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, sheet string, sheet_pos int, row int, cells array<string>, error string"

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader(self.options["path"])
