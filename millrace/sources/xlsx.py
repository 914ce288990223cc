"""Excel workbooks (.xlsx) as a Spark data source over the standard library, a partition a sheet."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from millrace.sources.files import write_bytes
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _open(path: str) -> zipfile.ZipFile:
    """The workbook through Arrow's file systems, which know remote schemes and local paths (S3 by s3, not by Hadoop's s3a)."""
    from pyarrow import fs

    path = "s3" + path[3:] if path.startswith("s3a:") else path
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    with system.open_input_file(inner) as f:
        return zipfile.ZipFile(io.BytesIO(f.read()))


def sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, member) of each sheet in order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet"):
        target = links[s.get(_LINK)].lstrip("/")
        out.append((s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    return ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")]


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def rows(book: zipfile.ZipFile, member: str, shared: list[str]) -> Iterator[list[str | None]]:
    """Cell texts of each row, streamed."""
    with book.open(member) as f:
        for _, row in ElementTree.iterparse(f):
            if row.tag != f"{_MAIN}row":
                continue
            out: list[str | None] = []
            for cell in row.iter(f"{_MAIN}c"):
                at = _column(cell.get("r")) if cell.get("r") else len(out)
                out += [None] * (at - len(out))
                value, kind = cell.find(f"{_MAIN}v"), cell.get("t")
                if kind == "inlineStr":
                    out.append("".join(t.text or "" for t in cell.iter(f"{_MAIN}t")))
                elif value is None or value.text is None:
                    out.append(None)
                else:
                    out.append(shared[int(value.text)] if kind == "s" else value.text)
            yield out
            row.clear()


def header(first: list[str | None]) -> list[str]:
    """The names of a sheet's first row; a lacking one by its place, one that repeats with a number."""
    out: list[str] = []
    for i, name in enumerate(first):
        name = name if name is not None else f"col_{i}"
        again, k = name, 0
        while again in out:
            k += 1
            again = f"{name}.{k}"
        out.append(again)
    return out


class SheetPartition(InputPartition):
    def __init__(self, member: str):
        self.member = member


class WorkbookSource(DataSource):
    """format("workbook"): the union of all sheets' columns, each sheet's first row its header."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        names: dict[str, None] = {}
        with _open(self.options["path"]) as book:
            shared = _strings(book)
            for _, member in sheets(book):
                names |= dict.fromkeys(header(next(rows(book, member, shared), [])))
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], schema.names)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as book:
            return [SheetPartition(member) for _, member in sheets(book)]

    def read(self, partition: SheetPartition) -> Iterator[tuple]:
        with _open(self.path) as book:
            lines = rows(book, partition.member, _strings(book))
            own = header(next(lines, []))
            for line in lines:
                cells = dict(zip(own, line, strict=False))
                if any(v is not None for v in cells.values()):
                    yield tuple(cells.get(n) for n in self.names)


#: Rows of a sheet, a fixed value of the format; a workbook is written by the driver.
LIMIT = 1_048_576


def write_workbook(df: DataFrame, path: str) -> None:
    """A table of at most LIMIT rows as a workbook of one sheet, through Spark's file systems; a larger one is an error."""
    found = df.limit(LIMIT).collect()
    if len(found) == LIMIT:
        raise ValueError(f"a sheet holds {LIMIT - 1} rows and a header: write .parquet or .csv")

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        main, office = _MAIN.strip("{}"), _LINK[1 : _LINK.index("}")]
        package = "http://schemas.openxmlformats.org/package/2006"
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        book.writestr("[Content_Types].xml", f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/></Types>')
        book.writestr("_rels/.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with book.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'<worksheet xmlns="{main}"><sheetData>'.encode())
            for row in [df.columns, *found]:
                f.write(("<row>" + "".join(map(cell, row)) + "</row>").encode())
            f.write(b"</sheetData></worksheet>")
    write_bytes(df.sparkSession, path, buffer.getvalue())
