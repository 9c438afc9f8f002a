"""Delimited text into rows of texts."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from itertools import accumulate, chain, groupby, islice
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Delimiters in the order in which ties are settled.
DELIMITERS = (",", ";", "\t", "|")


BOM = b"\xef\xbb\xbf"
#: Bytes of the longest record, and of an Arrow batch.
MAX_RECORD, BATCH_BYTES = 256 * 2**20, 16 * 2**20
CELLS = "kind string, file string, row_idx long, col_idx int, value string"


def delimiter_of(head: list[str]) -> str:
    """The delimiter that occurs equally often, and most often, in each of these lines; else a comma."""
    counts = {d: {line.count(d) for line in head} for d in DELIMITERS}
    even = [(c.copy().pop(), d) for d, c in counts.items() if len(c) == 1 and 0 not in c]
    return max(even, key=lambda x: x[0])[1] if even else ","


def detect_delimiter(spark: SparkSession, path: str, lines: int = 5) -> str:
    return delimiter_of([r.value for r in spark.read.text(path).limit(lines).collect()])


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "UTF-8", header: bool = True, line_breaks: bool = True) -> DataFrame:
    """Trimmed fields as texts under the header's names (without header Column_0 and so on); a file with a header alone gives no rows.

    Fields may hold line breaks, for which a file is read by one task; without
    ``line_breaks`` a large file is split among tasks.
    """
    rows = spark.read.csv(path, header=header, sep=delimiter or detect_delimiter(spark, path), quote='"', escape='"', encoding=encoding, multiLine=line_breaks, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    if not header:
        rows = rows.toDF(*[f"Column_{i}" for i in range(len(rows.columns))])
    return rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in rows.columns])


def ends_inside(line: bytes, inside: bool, delimiter: bytes) -> bool:
    """Whether a line that begins inside a quoted field, or at the start of a record, ends inside one."""
    at = 0
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == b'"':
                at += 2
                continue
            at, inside = at + 1, False  # what follows belongs to the field up to its delimiter
        elif line[at : at + 1] == b'"':
            at, inside = at + 1, True
            continue
        if line.find(b'"', at) < 0 or (at := line.find(delimiter, at) + 1) == 0:
            return False


def _inner_returns(line: bytes) -> bool:
    return 0 <= line.find(b"\r") < len(line) - 1


def records_in(line: bytes, inside: bool, delimiter: bytes) -> tuple[bool, int]:
    """Whether a line ends inside a quoted field, and how many records begin in it; a bare return ends a record, too."""
    begun = 0
    for part in line.split(b"\r") if _inner_returns(line) else (line,):
        begun += not inside and part.strip(b"\r") != b""
        inside = ends_inside(part, inside, delimiter) if b'"' in part else inside
    return inside, begun


class Split:
    """What one byte range of a file does to the state at its start: for each delimiter, and for a start outside and inside quotes, the state at its end and the records begun."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.size, self.head, self.width = file, start, 0, [], None
        self.ends, self.begun = [i % 2 == 1 for i in range(2 * len(DELIMITERS))], [0] * (2 * len(DELIMITERS))

    def add(self, lines: list[bytes]) -> None:
        lines = _bare(self.start, lines) if not self.size else lines
        if not self.start and self.width is None:
            self.head += lines
            self.width = _width(self.head)
        self.size += sum(map(len, lines)) + len(lines)
        odd = [i for i, x in enumerate(lines) if b'"' in x or _inner_returns(x)]
        filled = [0, *accumulate(1 if x.strip(b"\r") else 0 for x in lines)]
        for k in range(len(self.ends)):
            inside, begun, at = self.ends[k], 0, 0
            for i in odd:
                begun += 0 if inside else filled[i] - filled[at]
                inside, more = records_in(lines[i], inside, DELIMITERS[k // 2].encode())
                begun, at = begun + more, i + 1
            self.ends[k], self.begun[k] = inside, self.begun[k] + begun + (0 if inside else filled[-1] - filled[at])

    def row(self) -> tuple:
        return self.file, self.start, self.size, delimiter_of(_head(self.head)) if not self.start else None, self.width, self.ends, self.begun


def _head(lines: list[bytes]) -> list[str]:
    return b"\n".join(lines).decode("utf-8-sig", "replace")[:100_000].splitlines()[:5]


def _width(head: list[bytes]) -> int | None:
    """How many fields the first record has; None while it has not ended."""
    delimiter = delimiter_of(_head(head[:5]))
    inside, n = False, 0
    for n, line in enumerate(head, 1):
        inside, begun = records_in(line, inside, delimiter.encode())
        if not inside and (begun or n > 1 and head[0].strip(b"\r")):
            break
    else:
        return None
    return next((len(fields) for _, fields in Fields(delimiter, False, False).read(iter(head[:n]))), None)


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list[bytes]]]:
    """(file, start, whether the range is the whole file, lines) in order; a range may come in several pieces."""
    for batch in batches:
        path, start, whole = (batch.column(i).to_pylist() for i in range(3))
        lines = batch.column(3).to_pylist()
        at = 0
        for key, group in groupby(zip(path, start, whole)):
            n = sum(1 for _ in group)
            yield re.sub("^file:///", "file:/", unquote(key[0])), key[1], key[2], lines[at : at + n]
            at += n


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each byte range of files that have several."""
    held = None

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(held.row(), _SUMMARY)], schema=_SUMMARY)

    for file, start, whole, lines in _splits(batches):
        if whole:
            continue
        if held is None or (held.file, held.start) != (file, start):
            if held is not None:
                yield packed()
            held = Split(file, start)
        held.add(lines)
    if held is not None:
        yield packed()


_SUMMARY = pa.schema([("file", pa.string()), ("start", pa.int64()), ("size", pa.int64()), ("delimiter", pa.string()), ("width", pa.int64()), ("ends", pa.list_(pa.bool_())), ("begun", pa.list_(pa.int64()))])


def planned(summaries: list[tuple], most: int) -> tuple[dict, list[tuple]]:
    """Where each byte range begins: (file, start) to (inside, ends inside, records begun before, delimiter, width); and (file, records, what is wrong) of each file.

    States are combined from the first range on: the end of one is the start of the next.
    """
    plan, files = {}, []
    for file, group in groupby(sorted(summaries, key=lambda x: x[:2]), lambda x: x[0]):
        inside, begun, run, wrong, delimiter, width = False, 0, 0, None, None, None
        for _, start, size, own, fields, ends, counts in group:
            delimiter, width = delimiter or own or ",", width or fields
            k = 2 * DELIMITERS.index(delimiter) + inside
            plan[file, start] = (inside, ends[k], begun, delimiter, width)
            run = run + size if inside else size
            if inside and run > most:
                wrong = f"a quoted field is not closed within {most} bytes"
            inside, begun = ends[k], begun + counts[k]
        files.append((file, begun, wrong or (None if width else "the header does not end within the first range of the file")))
    return plan, files


class Fields:
    """Records of one byte range as lists of fields; what begins or ends in another range comes out as pieces of bytes."""

    def __init__(self, delimiter: str, inside: bool, ends_inside_: bool):
        self.delimiter, self.inside, self.cut = delimiter, inside, ends_inside_
        csv.field_size_limit(2**31 - 1)  # of the module's 131,072; a text can't be longer than this in any case

    def chunks(self, lines: Iterator[bytes], held: list[bytes]) -> Iterator[str]:
        """Text for the csv module, a line or less at a time; bytes go to ``held``."""
        inside = False
        for line in lines:
            held.append(line + b"\n")
            if not _inner_returns(line):
                inside = ends_inside(line, inside, self.delimiter.encode()) if b'"' in line else inside
                yield line.decode("utf-8", "replace") + "\n"
                continue
            for i, part in enumerate(parts := line.split(b"\r")):
                inside = ends_inside(part, inside, self.delimiter.encode())
                yield part.decode("utf-8", "replace") + ("\r" if inside and i < len(parts) - 1 else "\n")

    def read(self, lines: Iterator[bytes]) -> Iterator[tuple[str, object]]:
        """("piece", bytes) and ("record", fields)."""
        if self.inside:
            head, inside = [], True
            for line in lines:
                head.append(line + b"\n")
                if not (inside := records_in(line, inside, self.delimiter.encode())[0]):
                    break
            yield "piece", b"".join(head)
        held: list[bytes] = []
        last, raw = None, b""
        for fields in csv.reader(self.chunks(lines, held), delimiter=self.delimiter):
            if last:
                yield "record", last
            last, raw = fields, b"".join(held)
            held.clear()
        if last:
            yield ("piece", raw) if self.cut else ("record", last)


def _cells(file: str, row: int, fields: list[str], width: int) -> Iterator[tuple]:
    for i in range(width):
        yield ("cell", file, row, i, fields[i].strip() if i < len(fields) else "", None, None)


_ROW = pa.schema([("kind", pa.string()), ("file", pa.string()), ("row_idx", pa.int64()), ("col_idx", pa.int32()), ("value", pa.string()), ("start", pa.int64()), ("piece", pa.binary())])
_ROW_TYPES = "kind string, file string, row_idx long, col_idx int, value string, start long, piece binary"


def _packed(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, 20_000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _ROW)], schema=_ROW)


def rows_of(file: str, raw: bytes) -> Iterator[tuple]:
    """(kind, file, row_idx, col_idx, value): a file's trimmed fields under its header (row 0); missing fields are empty, further ones are left out."""
    lines = raw.removeprefix(BOM).split(b"\n")
    for row in _whole(file, iter(lines), delimiter_of(_head(lines[:5]))):
        yield row[:5]


def _whole(file: str, lines: Iterator[bytes], delimiter: str) -> Iterator[tuple]:
    """Rows of a file that is one byte range."""
    width, row = 0, -1
    for _, fields in Fields(delimiter, False, False).read(lines):
        row, width = row + 1, width or len(fields)
        yield from _cells(file, row, fields, width)
    yield ("sheet", file, None, None, None, None, None) if row > 0 else ("error", file, None, None, "no data rows", None, None)


def _lines_of(splits: Iterator[tuple], key: tuple, first: list[bytes], rest: list) -> Iterator[bytes]:
    """The lines of one byte range, drawn as they come; ``rest`` gets what belongs to the next one."""
    yield from first
    for file, start, whole, lines in splits:
        if (file, start) != key:
            rest.append((file, start, whole, lines))
            return
        yield from lines


def read_texts(spark: SparkSession, path: str, pattern: str = "*.[cC][sS][vV]", most: int = MAX_RECORD) -> DataFrame:
    """Rows (see ``CELLS``) of all text files under ``path``; a file's delimiter and header are its own.

    A large file is read by many tasks, wherever it is cut, also in quoted fields
    with line breaks: a first scan finds for each byte range how it changes the
    state, inside or outside quotes, the states are combined from range to range,
    and in a second scan each range knows where its records begin. Records that
    cross over are put together from their pieces. The first scan runs at the
    call, and only if a file is large enough to be cut; what the driver holds is
    a row for each range of such files, as Spark's own plan does.

    Of a file with a quoted field that isn't closed within ``most`` bytes, or with
    a header longer than a range, there is one row of kind broken, and no cell.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if not spark.conf.get("spark.sql.files.minPartitionNum", None):  # both scans must cut alike, also when executors come and go
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    scan = spark.read.option("lineSep", "\n").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(path)
    m = F.col("_metadata")
    lines = scan.select(m["file_path"].alias("path"), m["file_block_start"].alias("start"), (m["file_block_length"] >= m["file_size"]).alias("whole"), F.col("value").cast("binary").alias("line"))
    names = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    largest = names.agg(F.max("length")).first()[0] or 0
    bound = min(_bytes(spark, "spark.sql.files.openCostInBytes"), _bytes(spark, "spark.sql.files.maxPartitionBytes"))
    found = [tuple(r) for r in lines.filter("NOT whole").mapInArrow(_summaries, "file string, start long, size long, delimiter string, width long, ends array<boolean>, begun array<long>").collect()] if largest > bound else []
    plan, totals = planned(found, most)
    wrong = {file: why for file, _, why in totals if why}
    held = spark.sparkContext.broadcast((plan, set(wrong)))

    def run(batches: Iterator[pa.RecordBatch], pieces: bool) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            plan, broken = held.value
            splits, rest = _splits(batches), []
            while (now := rest.pop() if rest else next(splits, None)) is not None:
                file, start, whole, first = now
                drawn = _lines_of(splits, (file, start), _bare(start, first), rest)
                if whole and not pieces:
                    # The delimiter shows in the first lines, which may come in more than one batch.
                    head = list(islice(drawn, 5))
                    yield from _whole(file, chain(head, drawn), delimiter_of(_head(head)))
                elif not whole and file not in broken:
                    if (file, start) not in plan:
                        raise RuntimeError(f"{file} is cut into other ranges than before; set spark.sql.files.minPartitionNum")
                    inside, cut, row, delimiter, width = plan[file, start]
                    if not pieces or inside or cut:
                        for kind, got in Fields(delimiter, inside, cut).read(drawn):
                            if kind == "piece":
                                own = row - 1 if inside else row
                                inside = False
                                if pieces:
                                    yield ("piece", file, own, None, None, start, got)
                            else:
                                if not pieces:
                                    yield from _cells(file, row, got, width)
                                row += 1
                for _ in drawn:  # what is left of the range
                    pass

        yield from _packed(rows())

    out = lines.mapInArrow(lambda b: run(b, False), _ROW_TYPES)
    if any(inside for inside, *_ in plan.values()):
        parts = lines.filter("NOT whole").mapInArrow(lambda b: run(b, True), _ROW_TYPES).groupBy("file", "row_idx").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p"))  # of one record

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for batch in batches:
                    for file, row, p in zip(*(c.to_pylist() for c in batch.columns)):
                        text = b"".join(x["piece"] for x in p)
                        *_, delimiter, width = held.value[0][file, p[0]["start"]]
                        for _, fields in Fields(delimiter, False, False).read(iter(text.removesuffix(b"\n").split(b"\n"))):
                            yield from _cells(file, row, fields, width)

            yield from _packed(rows())

        out = out.unionByName(parts.mapInArrow(joined, _ROW_TYPES))
    rows = out.select("kind", "file", "row_idx", "col_idx", "value")
    facts = [("broken", f, why) if why else ("sheet", f, None) if n > 1 else ("error", f, "no data rows") for f, n, why in totals]
    return rows.unionByName(spark.createDataFrame(facts, "kind string, file string, value string"), allowMissingColumns=True) if facts else rows


def _bytes(spark: SparkSession, name: str) -> int:
    return int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))


def _bare(start: int, lines: list[bytes]) -> list[bytes]:
    """Lines without the mark of the encoding that a file may begin with."""
    return [lines[0].removeprefix(BOM), *lines[1:]] if lines and not start else lines
