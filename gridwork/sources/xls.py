"""XLS and XLT workbooks (BIFF8 and BIFF5 in an OLE2 container) into the rows of ``xlsx.ROWS``.

A container is a small file system: a table chains sectors of 512 or 4096 bytes,
a directory names streams, and streams of under 4096 bytes lie in a mini stream
that is cut once more. The workbook stream is a list of records; a record longer
than 8224 bytes goes on in CONTINUE records, and a text cut there begins again
with its own flag of one or two bytes a character.

What comes out: numbers are FloatingPoint, or DateTime (ISO) under a format of
dates; texts are Text, to be typed by ``infer_text``; Boolean; a formula is its
stored result. Blank and error cells are empty and rows that are wholly empty do not
count, so rows are numbered by those that hold something; every row is as wide as
the sheet, so each column has a name. Number formats and merged ranges are left
out. A broken container, chain or record, or an encrypted file, is one Critical
row of its file; a sheet that breaks off is an Error row beside the others.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.sources.xlsx import BATCH_BYTES, BUILT_IN, MAX_BYTES, ROWS, packed

# The file format's signature, marks and record numbers.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
LAST_SECTOR, HEADER_TABLE = 0xFFFFFFFA, 109
BOF, EOF, CONTINUE, FILEPASS, CODEPAGE, DATEMODE, BOUNDSHEET, FORMAT, XF, SST = 0x0809, 0x000A, 0x003C, 0x002F, 0x0042, 0x0022, 0x0085, 0x041E, 0x00E0, 0x00FC
NUMBER, RK, MULRK, LABELSST, LABEL, RSTRING, BOOLERR, FORMULA, STRING = 0x0203, 0x027E, 0x00BD, 0x00FD, 0x0204, 0x00D6, 0x0205, 0x0006, 0x0207
SHARED_FORMULAS = (0x04BC, 0x0221, 0x0236)
#: Built-in formats of dates and times.
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])


class Broken(ValueError):
    """The file is not what its format asks for."""


class Container:
    """Streams of an OLE2 file."""

    def __init__(self, raw: bytes):
        if raw[:8] != SIGNATURE or len(raw) < 512:
            raise Broken("not an OLE2 container")
        self.raw = raw
        shift, mini_shift = struct.unpack_from("<HH", raw, 30)
        if shift not in (9, 12) or not 4 <= mini_shift < shift:
            raise Broken("sector size")
        self.size, self.mini = 1 << shift, 1 << mini_shift
        self.first, self.cutoff, mini_first, _, table_first, tables = struct.unpack_from("<II", raw, 48)[0], *struct.unpack_from("<IIIII", raw, 56)
        ids = list(struct.unpack_from(f"<{HEADER_TABLE}I", raw, 76))
        seen = 0
        while table_first < LAST_SECTOR:  # the table's own sectors beyond those in the header
            more = struct.unpack(f"<{self.size // 4}I", self.sector(table_first))
            ids += more[:-1]
            table_first, seen = more[-1], seen + 1
            if seen > tables:
                raise Broken("the table of tables does not end")
        self.next: list[int] = []
        for i in ids:
            if i < LAST_SECTOR:
                self.next += struct.unpack(f"<{self.size // 4}I", self.sector(i))
        entries = self.chain(self.first)
        self.entries = [e for at in range(0, len(entries) - 127, 128) if (e := self._entry(entries[at : at + 128]))]
        root = next((e for e in self.entries if e[1] == 5), None)
        self.small = self.chain(root[2])[: root[3]] if root and root[2] < LAST_SECTOR else b""
        mini = self.chain(mini_first) if mini_first < LAST_SECTOR else b""
        self.mini_next = struct.unpack(f"<{len(mini) // 4}I", mini[: len(mini) // 4 * 4])

    @staticmethod
    def _entry(raw: bytes) -> tuple | None:
        length = struct.unpack_from("<H", raw, 64)[0]
        name = raw[: max(0, min(64, length) - 2)].decode("utf-16-le", "replace")
        return (name, raw[66], *struct.unpack_from("<II", raw, 116)) if raw[66] in (2, 5) else None

    def sector(self, i: int) -> bytes:
        at = (i + 1) * self.size
        if at >= len(self.raw):
            raise Broken(f"sector {i} lies beyond the end")
        return self.raw[at : at + self.size].ljust(self.size, b"\0")

    def chain(self, start: int) -> bytes:
        return self._follow(start, self.next, self.sector)

    @staticmethod
    def _follow(start: int, following, piece) -> bytes:
        out, i = [], start
        while i < LAST_SECTOR:
            if i >= len(following) or len(out) > len(following):
                raise Broken("a chain of sectors leaves the table or runs in a circle")
            out.append(piece(i))
            i = following[i]
        return b"".join(out)

    def stream(self, *names: str) -> bytes:
        for wanted in names:
            for name, kind, start, size in self.entries:
                if kind == 2 and name.lower() == wanted.lower():
                    whole = self.chain(start) if size >= self.cutoff else self._follow(start, self.mini_next, lambda i: self.small[i * self.mini : (i + 1) * self.mini])
                    if len(whole) < size:
                        raise Broken("a stream is shorter than it says")
                    return whole[:size]
        raise Broken("no workbook stream")


def records(raw: bytes, at: int = 0) -> Iterator[tuple[int, list[bytes]]]:
    """(number, parts) of each record up to the end of its substream: the record's own bytes and those of the CONTINUE records behind it."""
    depth, held = 0, None
    while at + 4 <= len(raw):
        number, size = struct.unpack_from("<HH", raw, at)
        part = raw[at + 4 : at + 4 + size]
        if len(part) < size:
            raise Broken("a record is cut off")
        at += 4 + size
        if number == CONTINUE and held:
            held[1].append(part)
            continue
        if held and depth == 1:  # what is embedded, such as a chart, is passed over
            yield held
        depth += number == BOF
        held = (number, [part])
        if number == EOF:
            depth -= 1
            if depth <= 0:
                return
    raise Broken("the records end without a mark")


class Parts:
    """Bytes of a record and its continuations; a text that crosses over starts again with a flag."""

    def __init__(self, parts: list[bytes], at: int = 0):
        self.parts, self.k, self.at = parts, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n:
            here = self.parts[self.k][self.at : self.at + n]
            out, n, self.at = out + here, n - len(here), self.at + len(here)
            if n:
                self._turn()
        return out

    def _turn(self) -> None:
        self.k, self.at = self.k + 1, 0
        if self.k >= len(self.parts):
            raise Broken("a text is cut off")

    def number(self, kind: str) -> int:
        return struct.unpack("<" + kind, self.take(struct.calcsize(kind)))[0]

    def characters(self, n: int, wide: int) -> str:
        out = []
        while n:
            if self.at >= len(self.parts[self.k]):
                self._turn()
                wide = self.take(1)[0] & 1
            size = 2 if wide else 1
            here = min(n, (len(self.parts[self.k]) - self.at) // size)
            if not here:
                raise Broken("a character is cut in two")
            out.append(self.take(here * size).decode("utf-16-le" if wide else "latin-1", "surrogatepass"))
            n -= here
        # Surrogates whose halves came in two parts meet here; lone ones become marks.
        return "".join(out).encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    def text(self, length: str = "H") -> str:
        """A text of BIFF8: length, flags, counts of what follows it, characters, runs of fonts, further data."""
        n, flags = self.number(length), self.number("B")
        runs = self.number("H") if flags & 8 else 0
        further = self.number("I") if flags & 4 else 0
        out = self.characters(n, flags & 1)
        self.take(4 * runs + further)
        return out


def number_of(rk: int) -> float:
    """A packed number: 30 bits of a double or a whole number, and whether a hundredth of it is meant."""
    value = float(struct.unpack("<i", struct.pack("<I", rk & 0xFFFFFFFC))[0] >> 2) if rk & 2 else struct.unpack("<d", struct.pack("<Q", (rk & 0xFFFFFFFC) << 32))[0]
    return value / 100 if rk & 1 else value


def is_date(code: int, text: str | None) -> bool:
    """Whether a number format shows dates or times."""
    if text is None:
        return code in DATE_FORMATS
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", text.lower())
    return bool(re.search("[ymdhs]", bare.split(";")[0])) and "general" not in bare


def moment(serial: float, since_1904: bool) -> str | None:
    """A serial number as ISO; None where there is no such date."""
    if not 0 <= serial < 2_958_466:
        return None
    # Day 60 of 1900 does not exist; before it the count is a day ahead.
    start = datetime(1904, 1, 1) if since_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    try:
        return (start + timedelta(milliseconds=round(serial * 86_400_000))).isoformat(timespec="seconds")
    except OverflowError:
        return None


class Book:
    """Globals of a workbook stream: sheets, texts, formats."""

    def __init__(self, raw: bytes):
        self.raw = Container(raw).stream("Workbook", "Book") if raw[:8] == SIGNATURE else raw
        if len(self.raw) < 8 or struct.unpack_from("<H", self.raw)[0] != BOF:
            raise Broken("no workbook")
        version = struct.unpack_from("<H", self.raw, 4)[0]
        if version not in (0x0500, 0x0600):
            raise Broken(f"version {version:#06x}")
        self.wide, self.encoding, self.since_1904 = version == 0x0600, "cp1252", False
        self.sheets, self.shared, self.formats, self.styles = [], [], {}, []
        for number, parts in records(self.raw):
            part = parts[0]
            if number == FILEPASS:
                raise Broken("encrypted")
            elif number == CODEPAGE:
                page = struct.unpack_from("<H", part)[0]
                self.encoding = {1200: "utf-16-le", 10000: "mac-roman", 32768: "mac-roman", 32769: "cp1252"}.get(page, f"cp{page}")
            elif number == DATEMODE:
                self.since_1904 = part[:1] == b"\1"
            elif number == BOUNDSHEET:
                place, _, kind = struct.unpack_from("<IBB", part)
                name = Parts(parts, 6).text("B") if self.wide else self.old(part[7 : 7 + part[6]])
                if kind == 0:
                    self.sheets.append((name, place))
            elif number == FORMAT:
                code = struct.unpack_from("<H", part)[0]
                self.formats[code] = Parts(parts, 2).text() if self.wide else self.old(part[3 : 3 + part[2]])
            elif number == XF:
                self.styles.append(struct.unpack_from("<H", part, 2)[0])
            elif number == SST:
                at = Parts(parts, 4)
                for _ in range(at.number("I")):
                    self.shared.append(at.text())
        dates = {s: is_date(s, self.formats.get(s, BUILT_IN.get(s))) for s in set(self.styles)}
        self.dated = [dates[s] for s in self.styles]

    def old(self, raw: bytes) -> str:
        try:
            return raw.decode(self.encoding, "replace")
        except LookupError:
            return raw.decode("cp1252", "replace")

    def number(self, value: float, style: int) -> tuple[str, str]:
        date = moment(value, self.since_1904) if style < len(self.dated) and self.dated[style] else None
        return (date, "DateTime") if date else (repr(value), "FloatingPoint")

    def cells(self, place: int) -> Iterator[tuple[int, int, str, str]]:
        """(row, column, text, tag) of the cells of a sheet that hold something, in the stream's order."""
        waiting = None  # the formula whose text follows
        for number, parts in records(self.raw, place):
            part = parts[0]
            if number == STRING and waiting:
                value = Parts(parts).text() if self.wide else self.old(part[2 : 2 + struct.unpack_from("<H", part)[0]])
                yield (*waiting, value, "Text")
            elif number == MULRK:
                row, column = struct.unpack_from("<HH", part)
                for k in range((len(part) - 6) // 6):
                    style, rk = struct.unpack_from("<HI", part, 4 + 6 * k)
                    yield (row, column + k, *self.number(number_of(rk), style))
            elif number in (NUMBER, RK, LABELSST, LABEL, RSTRING, BOOLERR, FORMULA):
                row, column, style = struct.unpack_from("<HHH", part)
                waiting = None
                if number == NUMBER:
                    yield (row, column, *self.number(struct.unpack_from("<d", part, 6)[0], style))
                elif number == RK:
                    yield (row, column, *self.number(number_of(struct.unpack_from("<I", part, 6)[0]), style))
                elif number == LABELSST:
                    i = struct.unpack_from("<I", part, 6)[0]
                    yield (row, column, self.shared[i] if i < len(self.shared) else f"[Invalid SST ref: {i}]", "Text")
                elif number == BOOLERR:
                    if not part[7]:
                        yield (row, column, "TRUE" if part[6] else "FALSE", "Boolean")
                elif number == FORMULA:
                    if part[12:14] != b"\xff\xff":
                        yield (row, column, *self.number(struct.unpack_from("<d", part, 6)[0], style))
                    elif part[6] == 0:
                        waiting = row, column
                    elif part[6] == 1:
                        yield (row, column, "TRUE" if part[8] else "FALSE", "Boolean")
                else:
                    yield (row, column, Parts(parts, 6).text() if self.wide else self.old(part[8 : 8 + struct.unpack_from("<H", part, 6)[0]]), "Text")
            elif number not in SHARED_FORMULAS:
                waiting = None


def _filled(cells: Iterator[tuple]) -> Iterator[tuple]:
    return (c for c in cells if c[2].strip())


def rows_of(file: str, raw: bytes) -> Iterator[tuple]:
    """All rows of one file; whatever goes wrong is a row of kind error."""
    error = lambda sheet, i, why, severity: ("error", file, sheet, i, None, None, None, None, why, None, None, None, severity)
    try:
        book = Book(raw)
    except Exception as e:  # noqa: BLE001  one broken file is a row, never a failed job
        yield error(None, None, f"broken workbook: {type(e).__name__}: {e}", "Critical")
        return
    if not book.sheets:
        yield error(None, None, "File contains no data sheets", "Warning")
    for i, (sheet, place) in enumerate(book.sheets):
        try:
            # A first pass finds which rows hold something and how wide the sheet is: at most 65,536 numbers.
            known, width = set(), 0
            for row, column, _, _ in _filled(book.cells(place)):
                known.add(row)
                width = max(width, column + 1)
            if not known:
                yield error(sheet, i, f"{sheet} is empty", "Info")
                continue
            order = {row: k for k, row in enumerate(sorted(known))}
            named = set()
            for row, column, value, tag in _filled(book.cells(place)):
                if order[row] == 0:
                    named.add(column)
                yield ("cell", file, sheet, i, order[row], column, None, None, value, tag, None, None, None)
            for column in range(width):
                if column not in named:
                    yield ("cell", file, sheet, i, 0, column, None, None, "", "Empty", None, None, None)
            yield ("sheet", file, sheet, i, None, None, None, None, None, None, None, "1904" if book.since_1904 else "1900", None)
        except Exception as e:  # noqa: BLE001
            yield error(sheet, i, f"{sheet}: {type(e).__name__}: {e}", "Error")


def read_xls(spark: SparkSession, path: str) -> DataFrame:
    """Rows (see ``xlsx.ROWS``) of all XLS and XLT files under ``path``. Files above MAX_BYTES are not fetched; their rows say so."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield from packed(rows_of(batch.column(0)[k].as_py(), batch.column(1)[k].as_py()))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sStT]").option("recursiveFileLookup", "true").load(path)
    fits = files.filter(F.col("length") <= MAX_BYTES).select("path", "content").mapInArrow(run, ROWS)
    large = files.filter(F.col("length") > MAX_BYTES).select(F.lit("error").alias("kind"), F.col("path").alias("file"), F.lit("file too large").alias("value"), F.lit("Critical").alias("severity"))
    return fits.unionByName(large, allowMissingColumns=True)
