"""Tables as XLSX workbooks: every task writes its own rows, a sheet's limit at a time, so nothing meets in one place."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterable, Iterator, Mapping, Sequence
from datetime import date, datetime
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

# Rows of a sheet, length of a sheet's name, the first id of a number format of one's own.
MAX_ROWS, MAX_NAME, FIRST_FORMAT = 1_048_576, 31, 165
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def serial(value: date | datetime) -> float:
    """A date as the days since 1899-12-30."""
    at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
    return (at.replace(tzinfo=None) - datetime(1899, 12, 30)).total_seconds() / 86400


def letters(column: int) -> str:
    out = ""
    while column >= 0:
        out, column = chr(65 + column % 26) + out, column // 26 - 1
    return out


class Formats:
    """Number formats of a workbook: an index for each that occurs."""

    def __init__(self):
        self.index: dict[str, int] = {}

    def of(self, fmt: str | None) -> int:
        return 0 if not fmt else self.index.setdefault(fmt, len(self.index) + 1)

    def xml(self) -> str:
        own = "".join(f'<numFmt numFmtId="{FIRST_FORMAT + i}" formatCode="{escape(f, {chr(34): "&quot;"})}"/>' for i, f in enumerate(self.index))
        used = "".join(f'<xf numFmtId="{FIRST_FORMAT + i}" applyNumberFormat="1"/>' for i in range(len(self.index)))
        return f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="{len(self.index)}">{own}</numFmts><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(self.index) + 1}"><xf numFmtId="0"/>{used}</cellXfs></styleSheet>'


def cell(reference: str, value, fmt: str | None, formats: Formats, date_format: str) -> str:
    if value is None or value == "":
        return ""
    if isinstance(value, bool):
        return f'<c r="{reference}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (date, datetime)):
        return f'<c r="{reference}" s="{formats.of(fmt or date_format)}"><v>{serial(value)!r}</v></c>'
    if isinstance(value, (int, float)) and value == value and abs(value) != float("inf"):
        return f'<c r="{reference}" s="{formats.of(fmt)}"><v>{value!r}</v></c>'
    clean = "".join(c for c in str(value) if c >= " " or c in "\t\n\r")
    return f'<c r="{reference}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


class Frame:
    """What a workbook has besides the rows of its sheets."""

    TAIL = "</sheetData></worksheet>"

    @staticmethod
    def head(frozen: bool) -> str:
        """What a sheet begins with."""
        pane = '<sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews>' if frozen else ""
        return f'{_HEAD}<worksheet xmlns="{_MAIN}">{pane}<sheetData>'

    def __call__(self, sheets: Sequence[str], formats: Formats) -> dict[str, str]:
        """The other parts by name, for sheets of these names."""
        n = range(1, len(sheets) + 1)
        names = "".join(f'<sheet name="{escape(s[:MAX_NAME], {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, s in zip(n, sheets))
        links = "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in n)
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in n)
        return {
            "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{names}</sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">{links}<Relationship Id="rIdS" Type="{_OFFICE}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": formats.xml(),
            "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
        }


frame = Frame()


def workbook(sheets: Sequence[tuple[str, Sequence[str], Iterable[Sequence], Mapping[str, str]]], date_format: str = "yyyy-mm-dd", frozen: bool = False) -> bytes:
    """Bytes of a workbook of (name, header, rows, formats by header)."""
    out, formats = io.BytesIO(), Formats()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, (_, header, rows, by) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{k}.xml", "w") as part:
                part.write(frame.head(frozen).encode())
                columns = [letters(i) for i in range(len(header))]
                part.write(('<row r="1">' + "".join(cell(f"{c}1", h, None, formats, date_format) for c, h in zip(columns, header)) + "</row>").encode())
                for r, row in enumerate(rows, 2):
                    part.write((f'<row r="{r}">' + "".join(cell(f"{c}{r}", v, by.get(h), formats, date_format) for c, h, v in zip(columns, header, row)) + "</row>").encode())
                part.write(frame.TAIL.encode())
        for name, text in frame([n for n, *_ in sheets], formats).items():
            z.writestr(name, text)
    return out.getvalue()


def _store(path: str, raw: bytes) -> None:
    from pyarrow import fs

    place, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
    place.create_dir(inner.rpartition("/")[0], recursive=True)
    with place.open_output_stream(inner) as out:
        out.write(raw)


def write_xlsx(df: DataFrame, path: str, sheet: str = "Data", names: Mapping[str, str] | None = None, formats: Mapping[str, str] | None = None, date_format: str = "yyyy-mm-dd",
               frozen: bool = False, info: Sequence[tuple[str, str]] = (), rows_per_file: int = 100_000) -> DataFrame:
    """Workbooks under ``path``, each with up to ``rows_per_file`` rows of one partition: the manifest (path, rows, cells).

    Columns go under ``names``, with number formats by column; dates are serials.
    With ``info`` each workbook begins with a sheet of these pairs. A file counts
    only when the manifest names it, so repeated attempts leave nothing half-done.
    """
    if not 0 < rows_per_file < MAX_ROWS:
        raise ValueError(f"a sheet holds fewer than {MAX_ROWS} rows")
    columns = df.columns
    header = [(names or {}).get(c, c) for c in columns]
    by = {(names or {}).get(c, c): f for c, f in (formats or {}).items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            name = f"{path.rstrip('/')}/part-{uuid.uuid4().hex}.xlsx"
            sheets = ([("Info", ["Name", "Value"], info, {})] if info else []) + [(sheet, header, held, by)]
            _store(name, workbook(sheets, date_format, frozen))
            return pa.RecordBatch.from_pydict({"path": [name], "rows": [len(held)], "cells": [sum(v is not None and v != "" for row in held for v in row)]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == rows_per_file:
                    yield flush()
                    held = []
        if held:
            yield flush()

    return df.mapInArrow(run, "path string, rows long, cells long")


def comparison_info(terms: Sequence[str], files: Sequence[str], created: datetime, rows: int, name: str) -> list[tuple[str, str]]:
    return [("Terms", ", ".join(dict.fromkeys(terms))), ("Files", ", ".join(dict.fromkeys(files))), ("Created", f"{created:%Y-%m-%d %H:%M}"), ("Rows", str(rows)), ("Name", name)]
