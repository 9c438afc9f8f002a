"""Workbooks as a data source of their own: ``spark.read.format("gridwork").load(folder)`` after ``register(spark)``.

A file is never fetched whole. Its zip directory is read from its end, in less
than a megabyte, and refused there if it is a bomb; then only the parts that a
task needs are read, by ranges. A large file is one task a sheet, small ones
are packed together, and filters on file, sheet, kind, row and column go into the
reader: files and sheets that are not asked for are not planned, cells that are
not asked for are not decoded, and reading stops behind the last row asked for.

Files are opened through pyarrow's file systems, on the driver to plan and in
tasks to read. For a store that only Spark's own readers can open there is
``xlsx.read_workbooks``, which gives the same rows.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from gridwork.sources.xlsx import MAX_BYTES, ROWS, Book, packed, suspicious

#: Files above this are planned by sheet; smaller ones are packed into tasks of about so many bytes; of a zip's end and directory at most this is read.
SPLIT_BYTES, PACK_BYTES, TAIL_BYTES, DIRECTORY_BYTES = 8 * 2**20, 32 * 2**20, 65_557 + 20, 768 * 2**10
#: Files looked into at a time while planning.
THREADS = 32
# Marks of the zip format's end, of its large form, of that form's locator, and of an entry.
END, END64, LOCATOR, ENTRY = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2"
ENDINGS = (".xlsx", ".xlsm", ".xltx", ".xltm")


class Ranged(io.RawIOBase):
    """A file that is read by ranges; ``fetched`` counts the bytes."""

    def __init__(self, opened, size: int):
        self.opened, self.size, self.at, self.fetched = opened, size, 0, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = max(0, offset + (0, self.at, self.size)[whence])
        return self.at

    def readinto(self, into) -> int:
        n = min(len(into), max(0, self.size - self.at))
        if n:
            raw = self.opened.read_at(n, self.at)
            into[: len(raw)] = raw
            n = len(raw)
        self.at, self.fetched = self.at + n, self.fetched + n
        return n

    def close(self) -> None:
        if not self.closed:
            self.opened.close()
        super().close()


def directory(file, size: int) -> list[tuple[str, int, int]] | None:
    """(name, size, packed size) of the parts of a zip, from its end and its directory alone, also in the large form; None if it is none."""
    start = max(0, size - TAIL_BYTES)
    file.seek(start)
    tail = file.read(size - start)
    at = tail.rfind(END)
    if at < 0 or len(tail) < at + 22:
        return None
    length, place = struct.unpack_from("<II", tail, at + 12)
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
        file.seek(struct.unpack_from("<Q", tail, at - 12)[0])
        large = file.read(56)
        if len(large) < 56 or large[:4] != END64:
            return None
        length, place = struct.unpack_from("<QQ", large, 40)
    if length > DIRECTORY_BYTES:
        raise ValueError("its list of parts is too long")
    file.seek(place)
    raw, out, at = file.read(length), [], 0
    while at + 46 <= len(raw) and raw[at : at + 4] == ENTRY:
        few, many, name, more, note = struct.unpack_from("<IIHHH", raw, at + 20)
        extra, k = raw[at + 46 + name : at + 46 + name + more], 0
        while k + 4 <= len(extra):  # sizes that need eight bytes
            kind, n = struct.unpack_from("<HH", extra, k)
            if kind == 1:
                wide = struct.unpack_from(f"<{n // 8}Q", extra, k + 4)
                if many == 0xFFFFFFFF and wide:
                    many, wide = wide[0], wide[1:]
                if few == 0xFFFFFFFF and wide:
                    few = wide[0]
            k += 4 + n
        out.append((raw[at + 46 : at + 46 + name].decode("utf-8", "replace"), many, few))
        at += 46 + name + more + note
    return out


def refused(file, size: int) -> str | None:
    """Why a workbook isn't opened, or None, from its directory alone."""
    if size > MAX_BYTES:
        return "file too large"
    try:
        parts = directory(file, size)
    except (ValueError, struct.error, OSError) as e:
        return f"suspicious compression: {e}" if isinstance(e, ValueError) else "not a workbook"
    return "not a workbook" if parts is None else suspicious(parts)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Wanted:
    """What the filters ask for; None is all."""

    sets: dict = field(default_factory=dict)
    least: dict = field(default_factory=dict)
    most: dict = field(default_factory=dict)
    solid: set = field(default_factory=set)

    def add(self, f) -> bool:
        """Takes a filter over; False if it can't."""
        name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
        if name in ("file", "sheet", "kind", "row_idx", "col_idx") and isinstance(f, IsNotNull):
            self.solid.add(name)
        elif name in ("file", "sheet", "kind", "row_idx", "col_idx") and isinstance(f, (EqualTo, In)):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.sets[name] = self.sets.get(name, values) & values
        elif name in ("row_idx", "col_idx") and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.least[name] = max(self.least.get(name, f.value), f.value + isinstance(f, GreaterThan))
        elif name in ("row_idx", "col_idx") and isinstance(f, (LessThan, LessThanOrEqual)):
            self.most[name] = min(self.most.get(name, f.value), f.value - isinstance(f, LessThan))
        else:
            return False
        return True

    def has(self, name: str, value) -> bool:
        if value is None:  # a null is never asked for by these filters
            return not any(name in asked for asked in (self.sets, self.least, self.most, self.solid))
        return (name not in self.sets or value in self.sets[name]) and value >= self.least.get(name, value) and value <= self.most.get(name, value)

    def row(self, kind: str, file: str, sheet, row, column) -> bool:
        return self.has("kind", kind) and self.has("file", file) and self.has("sheet", sheet) and self.has("row_idx", row) and self.has("col_idx", column)

    def last_row(self) -> int | None:
        ends = [x for x in (self.most.get("row_idx"), max(self.sets["row_idx"]) if self.sets.get("row_idx") else None) if x is not None]
        return min(ends) if ends else None


class Part(InputPartition):
    """Whole files, or one sheet of one file."""

    def __init__(self, found: list[tuple[str, int]], sheet: int | None = None):
        self.found, self.sheet = found, sheet


def rows_of(file: str, opened: Ranged, wanted: Wanted, only: int | None = None) -> Iterator[tuple]:
    """Rows of ``xlsx.ROWS`` of a file, or of one sheet of it; whatever goes wrong is a row of kind error."""
    why = refused(opened, opened.size)
    try:
        if why is None:
            book = Book(io.BufferedReader(opened, 2**16))
            for i, (sheet, part) in enumerate(book.sheets):
                if only not in (None, i) or not wanted.has("sheet", sheet):
                    continue
                cells_alone = wanted.sets.get("kind") == {"cell"}
                last, filled = wanted.last_row() if cells_alone else None, False
                keep = lambda row, column: wanted.has("row_idx", row) and wanted.has("col_idx", column)
                for kind, r, c, r1, c1, value, tag, fmt, severity in book.rows(sheet, part, keep, last):
                    filled = filled or kind == "cell"
                    if filled and wanted.sets.get("kind") == {"sheet"}:
                        break
                    if value is not None and wanted.row(kind, file, sheet, r, c):
                        yield (kind, file, sheet, i, r, c, r1, c1, value, tag, fmt, None, severity)
                if filled and wanted.row("sheet", file, sheet, None, None):
                    yield ("sheet", file, sheet, i, None, None, None, None, None, None, None, book.date_system, None)
                elif not filled and last is None and wanted.row("error", file, sheet, None, None):
                    yield ("error", file, sheet, i, None, None, None, None, f"{sheet} is empty", None, None, None, "Info")
    except Exception as e:  # noqa: BLE001  one broken file is a row, never a failed job
        why = f"broken workbook: {type(e).__name__}: {e}"
    if why and wanted.row("error", file, None, None, None):
        yield ("error", file, None, None, None, None, None, None, why, None, None, None, "Critical")


class WorkbookReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split, self.pack = int(options.get("splitbytes", SPLIT_BYTES)), int(options.get("packbytes", PACK_BYTES))
        self.wanted = Wanted()

    def pushFilters(self, filters):
        return [f for f in filters if not self.wanted.add(f)]

    def _sheets(self, file: tuple[str, int]) -> list[Part]:
        store, _ = _store(self.path)
        with Ranged(store.open_input_file(file[0]), file[1]) as opened:
            if refused(opened, opened.size) is None:
                try:
                    names = Book(io.BufferedReader(opened, 2**16), parts=False).sheets
                    return [Part([file], i) for i, (name, _) in enumerate(names) if self.wanted.has("sheet", name)]
                except Exception:  # noqa: BLE001  the task says what is wrong
                    pass
        return [Part([file])]

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        store, base = _store(self.path)
        info = store.get_file_info(base)
        every = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
        files = sorted((f.path, f.size) for f in every if f.type == fs.FileType.File and f.base_name.lower().endswith(ENDINGS) and not f.base_name.startswith(("_", ".")) and self.wanted.has("file", f.path))
        with ThreadPoolExecutor(THREADS) as pool:
            out = [p for ps in pool.map(self._sheets, [f for f in files if f[1] > self.split]) for p in ps]
        held, size = [], 0
        for f in files:
            if f[1] <= self.split:
                if held and size + f[1] > self.pack:
                    out.append(Part(held))
                    held, size = [], 0
                held, size = [*held, f], size + f[1]
        return out + [Part(held)] * bool(held) or [Part([])]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)

        def rows() -> Iterator[tuple]:
            for path, size in part.found:
                with Ranged(store.open_input_file(path), size) as opened:
                    yield from rows_of(path, opened, self.wanted, part.sheet)

        yield from packed(rows())


class Workbooks(DataSource):
    """Workbooks under a path, in the rows of ``xlsx.ROWS``; options splitBytes and packBytes."""

    @classmethod
    def name(cls) -> str:
        return "gridwork"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> WorkbookReader:
        return WorkbookReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to a session and lets filters into Python readers."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Workbooks)
