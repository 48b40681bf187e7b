"""Workbooks as a source: zipped sheets of any store that Spark reads, one file a task at a time.

Files come as bytes from Spark's own reader, so no path is opened by Python.
The header row is the first that holds all expected names; blank rows and
columns before it don't matter. Cells come as text, as they are stored: numbers
in full, booleans as 0 and 1, dates as their day number. Of merged cells the
first has the value and the others are null, as blank cells are.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"^\{[^}]*\}")


def _name(element: ElementTree.Element) -> str:
    return _TAG.sub("", element.tag)


def _text(element: ElementTree.Element) -> str:
    """All runs of a shared or inline string, without its reading aids."""
    out = []
    for child in element:
        if _name(child) == "t":
            out.append(child.text or "")
        elif _name(child) == "r":
            out += [t.text or "" for t in child if _name(t) == "t"]
    return "".join(out)


def column_number(reference: str) -> int:
    """0 for A1, 26 for AA7."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of the sheets and of their parts, in order."""
    links = {}
    for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        target = r.attrib["Target"]
        links[r.attrib["Id"]] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
    out = []
    for e in ElementTree.fromstring(book.read("xl/workbook.xml")).iter():
        if _name(e) == "sheet":
            link = next(v for k, v in e.attrib.items() if _TAG.sub("", k) == "id")
            out.append((e.attrib["name"], links[link]))
    return out


def rows_of(book: zipfile.ZipFile, part: str, shared: Sequence[str]) -> Iterator[tuple[int, dict[int, str]]]:
    """Number and cells (by column) of each row that has any; rows are freed as they are read."""
    at = 0
    with book.open(part) as stream:
        for _, e in ElementTree.iterparse(stream):
            if _name(e) != "row":
                continue
            at = int(e.attrib.get("r", at + 1))
            cells, column = {}, -1
            for c in e:
                if _name(c) != "c":
                    continue
                column = column_number(c.attrib["r"]) if "r" in c.attrib else column + 1
                kind, value = c.attrib.get("t", "n"), None
                for x in c:
                    if _name(x) == "v":
                        value = x.text
                    elif _name(x) == "is":
                        value = _text(x)
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                if kind != "e" and value is not None and value.strip():
                    cells[column] = value
            e.clear()
            if cells:
                yield at, cells


def scan(data: bytes, expected: Sequence[str], sheet: str | None = None) -> Iterator[tuple[str, int, list[str | None]]]:
    """Sheet, row number and the expected columns of every row below a sheet's header; sheets without the header give nothing."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(e) for e in ElementTree.fromstring(book.read("xl/sharedStrings.xml")) if _name(e) == "si"]
        for name, part in _sheets(book):
            if sheet is not None and name != sheet:
                continue
            places: list[int] | None = None
            for number, cells in rows_of(book, part, shared):
                if places is None:
                    named = {}
                    for column, value in sorted(cells.items()):
                        named.setdefault(value.strip(), column)
                    if set(expected) <= set(named):
                        places = [named[c] for c in expected]
                else:
                    yield name, number, [cells.get(p) for p in places]


def read_sheets(spark: SparkSession, path: str | Sequence[str], expected: Sequence[str], sheet: str | None = None) -> DataFrame:
    """file, sheet, row and the expected columns, as text, of all workbooks at path; of one sheet or of each that has the header. A file that is no workbook fails the job with its name."""
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "sheet", "row", *expected]
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    found = list(scan(data, expected, sheet))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    raise ValueError(f"{file} is no workbook") from e
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    columns = [pa.array([file] * len(part)), pa.array([x[0] for x in part]), pa.array([x[1] for x in part], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[2][i] for x in part], pa.string()) for i in range(len(expected)))], names=names)

    kinds = ", ".join(f"`{c}` string" for c in expected)
    return files.mapInArrow(run, f"file string, sheet string, row long, {kinds}").select(*[F.col(f"`{c}`") for c in ("file", "sheet", "row", *expected)])
