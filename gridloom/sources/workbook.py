"""Workbooks to grids: sheets of many files in one plan, each sheet streamed by one task.

``read_workbooks`` lists the sheets of each file (from the end of the file, a few
small parts), deals (file, sheet) to tasks, and opens the file there at the
sheet's place: a large book is never in memory, and its sheets are read side by
side. ``scan_workbooks`` reads contents that are a column already, a book a task.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

# Number formats of the file format that mean dates or times.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

SCHEMA = "file_id bigint, sheet string, row_no bigint, cells array<struct<kind:string,num:double,txt:string>>, error string"
_ARROW = pa.schema(
    [
        ("file_id", pa.int64()), ("sheet", pa.string()), ("row_no", pa.int64()),
        ("cells", pa.list_(pa.struct([("kind", pa.string()), ("num", pa.float64()), ("txt", pa.string())]))),
        ("error", pa.string()),
    ]
)
_BATCH = 2000
_BLANK = {"kind": "blank", "num": None, "txt": ""}


def _tag(element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _column(reference: str) -> int:
    n = 0
    for letter in re.match(r"[A-Z]*", reference).group():
        n = n * 26 + ord(letter) - 64
    return n


def _text(element) -> str:
    """Text of a string item, without phonetic hints."""
    return "".join(t.text or "" for run in element if _tag(run) != "rPh" for t in run.iter() if _tag(t) == "t")


class _Book:
    """An open workbook: its sheets, styles and epoch; rows and texts are streamed."""

    def __init__(self, source):
        self.zip = zipfile.ZipFile(source)
        names = set(self.zip.namelist())
        if "xl/workbook.bin" in names:
            raise ValueError("binary workbook (xlsb): no reader")
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.epoch = datetime(1899, 12, 30)
        self.sheets = []
        for e in book.iter():
            if _tag(e) == "workbookPr" and e.get("date1904") in ("1", "true"):
                self.epoch = datetime(1904, 1, 1)
            if _tag(e) == "sheet":
                target = links[next(v for k, v in e.attrib.items() if k.endswith("}id"))]
                path = target.lstrip("/") if target.startswith("/") else "xl/" + target
                if "worksheets/" in path and path in names:
                    self.sheets.append((e.get("name"), path))
        self.strings: dict[int, str] = {}
        self.shared = "xl/sharedStrings.xml" in names
        self.dates = self._date_styles(names)

    def _parts(self, path: str, wanted: str, inside: str) -> Iterator[ElementTree.Element]:
        """Elements of a part as they end; the ones read are dropped, so that a part is never whole in memory."""
        holder = None
        with self.zip.open(path) as source:
            for event, e in ElementTree.iterparse(source, ("start", "end")):
                tag = _tag(e)
                if event == "start":
                    holder = e if tag == inside else holder
                elif tag == wanted:
                    yield e
                    holder.clear()
                elif tag == "dimension":
                    yield e

    def load_strings(self, path: str) -> None:
        """The shared texts that a sheet uses, and no others."""
        self.strings = {}
        if not self.shared:
            return
        used = set()
        for row in self._parts(path, "row", "sheetData"):
            used.update(int(v.text) for c in row if c.get("t") == "s" for v in c if _tag(v) == "v" and v.text)
        if used:
            for i, item in enumerate(self._parts("xl/sharedStrings.xml", "si", "sst")):
                if i in used:
                    self.strings[i] = _text(item)

    def _date_styles(self, names: set[str]) -> set[int]:
        if "xl/styles.xml" not in names:
            return set()
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        dated = set(DATE_FORMATS)
        for e in root.iter():
            if _tag(e) == "numFmt":
                code = re.sub(r'"[^"]*"|\\.|_.|\[[^\]]*\]', "", e.get("formatCode", ""))
                if re.search("[dmyhs]", code, re.I):
                    dated.add(int(e.get("numFmtId")))
        formats = [x for e in root if _tag(e) == "cellXfs" for x in e]
        return {i for i, x in enumerate(formats) if int(x.get("numFmtId", 0)) in dated}

    def _cell(self, c) -> dict:
        kind, value = c.get("t", "n"), None
        for child in c:
            if _tag(child) == "v":
                value = child.text
            elif _tag(child) == "is":
                return {"kind": "text", "num": None, "txt": _text(child)}
        if value is None:
            return _BLANK
        if kind == "s":
            return {"kind": "text", "num": None, "txt": self.strings[int(value)]}
        if kind == "b":
            return {"kind": "bool", "num": float(value), "txt": "True" if int(value) else "False"}
        if kind == "d":
            return {"kind": "date", "num": None, "txt": value[:10]}
        if kind != "n":
            return {"kind": "text", "num": None, "txt": value}
        whole = not re.search("[.eE]", value)
        number = int(value) if whole else float(value)
        if int(c.get("s", 0)) in self.dates:
            return self._moment(number)
        return {"kind": "number", "num": float(number), "txt": str(number)}

    def _moment(self, number: float) -> dict:
        span = timedelta(days=number)
        if 0 <= number < 1:  # a time of day
            seconds = round(span.total_seconds())
            return {"kind": "text", "num": None, "txt": f"{seconds // 3600:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"}
        if number < 60 and self.epoch.year == 1899:  # the format's 29 February 1900
            span += timedelta(days=1)
        return {"kind": "date", "num": None, "txt": (self.epoch + span).strftime("%Y-%m-%d")}

    def rows(self, path: str) -> Iterator[list[dict]]:
        """Rows in order; missing ones are empty, all are as wide as the sheet says it is."""
        self.load_strings(path)
        width, count = 0, 0
        for e in self._parts(path, "row", "sheetData"):
            if _tag(e) == "dimension":
                width = _column((e.get("ref") or "").split(":")[-1]) if ":" in (e.get("ref") or "") else 0
                continue
            number = int(e.get("r") or count + 1)
            for _ in range(count + 1, number):
                yield [_BLANK] * width
            cells = []
            for c in e:
                at = _column(c.get("r") or "") or len(cells) + 1
                cells += [_BLANK] * (at - 1 - len(cells))
                cells.append(self._cell(c))
            yield cells + [_BLANK] * (width - len(cells))  # the declared size may be wrong: it pads, it never cuts
            count = number


def _problem(e: Exception) -> str:
    return str(e) or type(e).__name__


def _batches(file_id: int, opened, chosen: str | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a book, or of its one sheet ``chosen``; a failure ends it with an error row."""
    out = []
    sheet = chosen
    try:
        with opened() as source:
            book = _Book(source)
            for sheet, path in book.sheets:
                if chosen is None or sheet == chosen:
                    for row_no, cells in enumerate(book.rows(path), start=1):
                        out.append({"file_id": file_id, "sheet": sheet, "row_no": row_no, "cells": cells, "error": None})
                        if len(out) >= _BATCH:
                            yield pa.RecordBatch.from_pylist(out, _ARROW)
                            out = []
    except Exception as problem:  # an unreadable file is a result, not the end of the job
        out.append({"file_id": file_id, "sheet": sheet, "row_no": None, "cells": None, "error": _problem(problem)})
    if out:
        yield pa.RecordBatch.from_pylist(out, _ARROW)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file_id, content in zip(batch["file_id"].to_pylist(), batch["content"]):
            yield from _batches(file_id, lambda c=content: io.BytesIO(c.as_py()))


def _opened(path: str):
    """A file by the path that Spark gives it; local and mounted folders by name, others through Arrow."""
    scheme, _, rest = path.rpartition("://") if "://" in path else path.rpartition("file:")
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(rest)
    host, _, name = rest.partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme.replace('s3a', 's3')}://{host}/")
    return system.open_input_file(f"{base.rstrip('/')}/{name}")


def _list_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for file_id, path in zip(batch["file_id"].to_pylist(), batch["path"].to_pylist()):
            try:
                with _opened(path) as source:
                    out += [(file_id, path, sheet, None) for sheet, _ in _Book(source).sheets]
            except Exception as problem:
                out.append((file_id, path, None, _problem(problem)))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], ["file_id", "path", "sheet", "error"])


def _read_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            if r["error"]:
                yield pa.RecordBatch.from_pylist([{"file_id": r["file_id"], "sheet": None, "row_no": None, "cells": None, "error": r["error"]}], _ARROW)
            else:
                yield from _batches(r["file_id"], lambda p=r["path"]: _opened(p), r["sheet"])


def scan_workbooks(files: DataFrame) -> DataFrame:
    """``file_id, content`` to ``file_id, sheet, row_no, cells, error``; one row with ``error`` per unreadable file.

    A file that fails half-way has both rows and an error; ``good_rows`` drops them.
    """
    return files.select(F.col("file_id").cast("bigint").alias("file_id"), "content").mapInArrow(_scan, SCHEMA)


def failed_files(scan: DataFrame) -> DataFrame:
    """One row a file that failed, whatever number of its sheets did."""
    return scan.filter("error is not null").groupBy("file_id").agg(F.min("error").alias("error"))


def good_rows(scan: DataFrame) -> DataFrame:
    """Grid of the files that could be read whole."""
    return scan.filter("error is null").drop("error").join(failed_files(scan).select("file_id"), "file_id", "left_anti")


def read_workbooks(spark: SparkSession, folder: str, manifest: DataFrame, direct: bool = True) -> DataFrame:
    """Scan the workbooks below a folder that the manifest knows: ``file_id, sheet, row_no, cells, error``.

    A task reads one sheet at a time, from the file itself. ``direct=False`` has
    Spark read the files instead, for a file system that only it can open: a book
    is then one value (2 GB at most) in one task. Binary workbooks are an error row.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[xX][lL][sS][xXmMbB]").load(folder)
    )
    known = manifest.select("path", F.col("file_id").cast("bigint").alias("file_id"))
    if not direct:
        return scan_workbooks(files.select("path", "content").join(known, "path"))
    sheets = files.select("path").join(known, "path").mapInArrow(_list_sheets, "file_id bigint, path string, sheet string, error string")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return sheets.repartition(tasks, "file_id", "sheet").mapInArrow(_read_sheets, SCHEMA)
