"""XLSX, XLSM, XLTX and XLTM workbooks into long rows: one task reads a file, and files are spread over tasks."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The largest file, largest sum of parts and largest ratio of a part to its packed size.
MAX_BYTES, MAX_UNPACKED, MAX_RATIO = 100 * 2**20, 2 * 2**30, 100
# Number formats by their built-in ids.
BUILT_IN = {
    1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "mm/dd/yyyy", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "m/d/yy h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)", 45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
FIRST_CUSTOM = 164
#: kind is sheet, cell, merge or error; r1, c1 and fmt are a merge's last row and column and its place among the sheet's merges, date_system is on sheet rows.
ROWS = "kind string, file string, sheet string, sheet_idx int, row_idx long, col_idx int, r1 long, c1 int, value string, tag string, fmt string, date_system string, severity string"
_NAMES = [c.split()[0] for c in ROWS.split(", ")]
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Bytes of an Arrow batch: a task holds about this and one file.
BATCH_BYTES = 16 * 2**20


def suspicious(parts: list[tuple[str, int, int]]) -> str | None:
    """Why a workbook of these parts (name, size, packed size) isn't opened, or None."""
    if sum(size for _, size, _ in parts) > MAX_UNPACKED or any(size > MAX_RATIO * max(1, few) for _, size, few in parts):
        return "suspicious compression"
    return None if any(name == "xl/workbook.xml" for name, _, _ in parts) else "no workbook part"


def guard(raw: bytes) -> str | None:
    """Why a file isn't opened, or None."""
    try:
        return suspicious([(p.filename, p.file_size, p.compress_size) for p in zipfile.ZipFile(io.BytesIO(raw)).infolist()])
    except zipfile.BadZipFile:
        return "not a workbook"


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter() if _local(t) == "t")


def place(reference: str) -> tuple[int, int]:
    """0-based row and column of an A1 reference."""
    letters, number = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", reference.upper()).groups()
    column = 0
    for c in letters:
        column = column * 26 + ord(c) - 64
    return int(number) - 1, column - 1


class Book:
    """One workbook's parts, from a file that can seek; ``parts`` False is for the names of its sheets alone."""

    def __init__(self, file, parts: bool = True):
        self.zip = zipfile.ZipFile(file)
        root = self._root("xl/workbook.xml")
        targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in self._root("xl/_rels/workbook.xml.rels")}
        self.sheets = [(n.get("name"), f"xl/{targets[n.get(_REL)]}") for n in root.iter() if _local(n) == "sheet"]
        flag = next((n.get("date1904") for n in root.iter() if _local(n) == "workbookPr"), None)
        self.date_system = "1904" if (flag or "").lower() in ("1", "true", "on") else "1900"
        self.shared = list(self._shared()) if parts else []
        self.formats = list(self._formats()) if parts else []

    def _root(self, name: str):
        return ElementTree.fromstring(self.zip.read(name))

    def _shared(self) -> Iterator[str]:
        if "xl/sharedStrings.xml" in self.zip.namelist():
            with self.zip.open("xl/sharedStrings.xml") as part:
                for _, node in ElementTree.iterparse(part):
                    if _local(node) == "si":
                        yield _text(node)
                        node.clear()

    def _formats(self) -> Iterator[str | None]:
        """Number format of each style."""
        if "xl/styles.xml" in self.zip.namelist():
            root = self._root("xl/styles.xml")
            custom = {int(n.get("numFmtId")): n.get("formatCode") for n in root.iter() if _local(n) == "numFmt"}
            for styles in (n for n in root if _local(n) == "cellXfs"):
                for n in styles:
                    at = int(n.get("numFmtId", 0))
                    yield BUILT_IN.get(at) if at < FIRST_CUSTOM else custom.get(at)

    def rows(self, name: str, part_name: str, keep=None, last: int | None = None) -> Iterator[tuple]:
        """(kind, row, column, last row, last column, value, tag, fmt, severity) of a sheet's cells and merges.

        Cells that ``keep`` (of row and column) doesn't want are not decoded, their value is null; rows behind ``last`` are not read, nor is what follows them.
        """
        row, column, merges = -1, -1, 0
        with self.zip.open(part_name) as part:
            for event, node in ElementTree.iterparse(part, events=("start", "end")):
                kind = _local(node)
                if event == "start":
                    if kind == "row":
                        row = int(node.get("r")) - 1 if node.get("r") else row + 1
                        column = -1
                        if last is not None and row > last:
                            return
                elif kind == "c":
                    # A cell without a reference stands after the one before.
                    at = place(node.get("r")) if node.get("r") else (row, column + 1)
                    column = at[1]
                    if keep and not keep(*at):
                        yield ("cell", *at, None, None, None, None, None, None)
                        continue
                    style = int(node.get("s", -1))
                    yield ("cell", *at, None, None, *self.decoded(node), self.formats[style] if 0 <= style < len(self.formats) else None, None)
                elif kind == "row":
                    node.clear()
                elif kind == "mergeCell":
                    yield self._merge(name, node.get("ref") or "", merges)
                    merges += 1

    def _merge(self, sheet: str, reference: str, order: int) -> tuple:
        try:
            (r0, c0), (r1, c1) = map(place, reference.split(":"))
        except (AttributeError, ValueError):
            return ("error", None, None, None, None, f"{sheet}: {reference} is no range", None, None, "Warning")
        if r1 < r0 or c1 < c0:
            return ("error", None, None, None, None, f"{sheet}: {reference} ends before it begins", None, None, "Warning")
        return ("merge", r0, c0, r1, c1, reference, None, str(order), None)

    def decoded(self, node) -> tuple[str, str]:
        """Text and tag of a cell: texts stay texts, whole numbers are Integer, a date is DateTime."""
        kind, value = node.get("t", "n"), next((v.text for v in node if _local(v) == "v"), None)
        if kind == "inlineStr":
            return _text(node), "Text"
        if value is None:
            return "", "Empty"
        if kind == "s":
            at = int(value) if value.strip().isdigit() else -1
            return (self.shared[at], "Text") if 0 <= at < len(self.shared) else (f"[Invalid SST ref: {value}]", "Text")
        if kind == "b":
            return ("TRUE" if value == "1" else "FALSE"), "Boolean"
        if kind == "e":
            return f"#ERROR: {value}", "Text"
        if kind == "d":
            return value, "DateTime"
        if kind == "n":
            try:
                number = float(value)
            except ValueError:
                return value, "Text"
            if number.is_integer() and abs(number) < 2**63:
                return str(int(number)), "Integer"
            return value, "FloatingPoint"
        return value, "Text"


def rows_of(file: str, raw: bytes) -> Iterator[tuple]:
    """All rows of one file; whatever goes wrong is a row of kind error."""
    why = guard(raw)
    try:
        if why is None:
            book = Book(io.BytesIO(raw))
            for i, (sheet, part) in enumerate(book.sheets):
                filled = False
                for kind, r, c, r1, c1, value, tag, fmt, severity in book.rows(sheet, part):
                    filled = filled or kind == "cell"
                    yield (kind, file, sheet, i, r, c, r1, c1, value, tag, fmt, None, severity)
                if filled:
                    yield ("sheet", file, sheet, i, None, None, None, None, None, None, None, book.date_system, None)
                else:
                    yield ("error", file, sheet, i, None, None, None, None, f"{sheet} is empty", None, None, None, "Info")
    except Exception as e:  # noqa: BLE001  one broken file is a row, never a failed job
        why = f"broken workbook: {type(e).__name__}: {e}"
    if why:
        yield ("error", file, None, None, None, None, None, None, why, None, None, None, "Critical")


def packed(rows: Iterator[tuple], size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of ``ROWS`` in Arrow batches."""
    kinds = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[k]) for n, k in (c.split() for c in ROWS.split(", "))])
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Rows (see ``ROWS``) of all workbooks under ``path``. Files above MAX_BYTES are not fetched; their rows say so."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from packed(rows_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sStT][xXmM]").option("recursiveFileLookup", "true").load(path)
    fits = files.filter(F.col("length") <= MAX_BYTES).select("path", "content").mapInArrow(run, ROWS)
    large = files.filter(F.col("length") > MAX_BYTES).select(F.lit("error").alias("kind"), F.col("path").alias("file"), F.lit("file too large").alias("value"), F.lit("Critical").alias("severity"))
    return fits.unionByName(large, allowMissingColumns=True)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """Long cells (file, sheet, row_idx, col_idx, value, tag, error) under file names; a file that can't be read gives one row with its error and no cell."""
    rows = read_workbooks(spark, path).filter("kind = 'cell' AND tag <> 'Empty' OR kind = 'error' AND severity = 'Critical'")
    error = F.col("kind") == "error"
    return rows.select(F.regexp_extract("file", "([^/]*)$", 1).alias("file"), "sheet", "row_idx", "col_idx", F.when(~error, F.col("value")).alias("value"), "tag", F.when(error, F.col("value")).alias("error"))


def merged_ranges(rows: DataFrame) -> DataFrame:
    """Ranges (file, sheet, ord, r0, c0, r1, c1) of ``read_workbooks``; ord is their order in the file."""
    return rows.filter("kind = 'merge'").select("file", "sheet", F.col("fmt").cast("long").alias("ord"), F.col("row_idx").alias("r0"), F.col("col_idx").alias("c0"), "r1", "c1")
