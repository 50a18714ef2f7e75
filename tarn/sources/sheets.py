"""Spreadsheets (zipped XML) as a data source: spark.dataSource.register(SheetSource), then spark.read.format("xlsx").load(path)."""

from __future__ import annotations

import glob
import os
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_index(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in re.match("[A-Z]*", reference).group():
        n = 26 * n + ord(c) - 64
    return n - 1


def rich_text(node: ElementTree.Element) -> str:
    """The text of a string without its phonetic hints."""
    own = [node.findtext(f"{MAIN}t") or ""] if node.find(f"{MAIN}t") is not None else []
    return "".join(own + [run.findtext(f"{MAIN}t") or "" for run in node.findall(f"{MAIN}r")])


def shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    with book.open("xl/sharedStrings.xml") as f:
        out = []
        for _, node in ElementTree.iterparse(f):
            if node.tag == f"{MAIN}si":
                out.append(rich_text(node))
                node.clear()
        return out


def sheet_file(book: zipfile.ZipFile, sheet: str | None) -> str:
    """The part that holds a sheet, by its name; the first one if None."""
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    found = [s for s in sheets if sheet is None or s.get("name") == sheet]
    if not found:
        raise ValueError(f"No sheet {sheet!r}, but {[s.get('name') for s in sheets]}")
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    target = links[found[0].get(LINK)]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def sheet_rows(path: str, sheet: str | None = None) -> Iterator[list[str | None]]:
    """The cells of each row as text, null where there is none; rows without a cell are left out. Dates are numbers, as stored."""
    with zipfile.ZipFile(path) as book:
        texts = shared_strings(book)
        with book.open(sheet_file(book, sheet)) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in node.findall(f"{MAIN}c"):
                    at = column_index(c.get("r", "")) if c.get("r") else len(cells)
                    kind, value, inline = c.get("t"), c.findtext(f"{MAIN}v"), c.find(f"{MAIN}is")
                    text = rich_text(inline) if inline is not None else texts[int(value)] if kind == "s" and value is not None else value
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = {"0": "false", "1": "true"}.get(text, text) if kind == "b" else text
                node.clear()
                if any(v is not None for v in cells):
                    yield cells


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class SheetReader(DataSourceReader):
    def __init__(self, files: list[str], sheet: str | None, names: list[str]):
        self.files, self.sheet, self.names = files, sheet, names

    def partitions(self) -> list[File]:
        return [File(f) for f in self.files]

    def read(self, partition: File) -> Iterator[tuple]:
        rows = sheet_rows(partition.path, self.sheet)
        header = next(rows, [])
        at = [header.index(n) if n in header else None for n in self.names]
        for r in rows:
            yield tuple(r[i] if i is not None and i < len(r) else None for i in at)


class SheetSource(DataSource):
    """Workbooks of a path (a file, a folder or a pattern that all workers see); option sheet names the sheet, the first one otherwise.

    The first row of the first workbook names the columns, all of them text; a null or repeated name is left out. A workbook is a
    partition, its rows are streamed; the strings that it shares are in memory, and bounded by the format's 1,048,576 rows.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        found = sorted(glob.glob(os.path.join(path, "*.xlsx")) if os.path.isdir(path) else glob.glob(path))
        if not found:
            raise FileNotFoundError(path)
        return found

    def schema(self) -> StructType:
        header = next(sheet_rows(self.files()[0], self.options.get("sheet")), [])
        return StructType([StructField(n, StringType()) for n in dict.fromkeys(header) if n])

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(self.files(), self.options.get("sheet"), schema.names)
