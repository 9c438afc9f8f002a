"""One workbook written by many tasks, in two phases.

Each task packs its rows into fragments of a sheet: bytes of a deflate stream
that end at a byte and need nothing before them, with their length and CRC-32.
When all are there, one more task joins those of the attempts that counted:
packed bytes are copied as they are, checksums are combined from the fragments'
own without unpacking, so no process holds more than a fragment. Rows and cells
carry no number of their own, so a fragment may come to stand anywhere; beyond a
sheet's most rows the next sheet begins. The file appears under its name only
when it is whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from gridwork.sinks.xlsx import MAX_NAME, MAX_ROWS, Formats, cell, frame

#: Rows of a fragment, and bytes copied at a time.
FRAGMENT_ROWS, COPIED = 20_000, 2**20
# Fixed value: the polynomial of CRC-32, lowest power first.
POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32."""
    out = 0
    for _ in range(32):
        if a & 0x80000000:
            out ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def combined(first: int, second: int, length: int) -> int:
    """CRC-32 of two byte strings joined, from their own and the second one's length."""
    power, base, n = 0x80000000, 0x00800000, length  # one, and x to the eighth
    while n:
        if n & 1:
            power = _times(base, power)
        base, n = _times(base, base), n >> 1
    return _times(power, first) ^ second


def fragment(text: str) -> tuple[bytes, int, int]:
    """A text as packed bytes that may stand amid others, its length and its CRC-32."""
    raw = text.encode()
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    return packer.compress(raw) + packer.flush(zlib.Z_FULL_FLUSH), len(raw), zlib.crc32(raw)


#: What ends a packed stream: an empty last block.
LAST = zlib.compressobj(6, zlib.DEFLATED, -15).flush()


class Zip:
    """A zip file written in order from packed parts of known size; the large form where numbers ask for it."""

    def __init__(self, out):
        self.out, self.at, self.entries = out, 0, []

    def _write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.at += len(raw)

    def part(self, name: str, pieces: Iterator[bytes], size: int, few: int, crc: int) -> None:
        """A part of ``size`` bytes, ``few`` when packed, from its packed pieces."""
        raw, large = name.encode(), size >= 0xFFFFFFFF or few >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, few) if large else b""
        head = struct.pack("<HHHHHIIIHH", 45 if large else 20, 0x800, 8, 0, 0x21, crc, 0xFFFFFFFF if large else few, 0xFFFFFFFF if large else size, len(raw), len(extra))
        self.entries.append((raw, head, size, few, self.at))
        self._write(b"PK\3\4" + head + raw + extra)
        began = self.at
        for p in pieces:
            self._write(p)
        if self.at - began != few:
            raise ValueError(f"{name}: {self.at - began} bytes instead of {few}")

    def close(self) -> None:
        start = self.at
        for raw, head, size, few, place in self.entries:
            numbers = ([size, few] if size >= 0xFFFFFFFF or few >= 0xFFFFFFFF else []) + ([place] if place >= 0xFFFFFFFF else [])
            extra = struct.pack(f"<HH{len(numbers)}Q", 1, 8 * len(numbers), *numbers) if numbers else b""
            self._write(b"PK\1\2" + struct.pack("<H", 45) + head[:-2] + struct.pack("<HHHHII", len(extra), 0, 0, 0, 0, min(place, 0xFFFFFFFF)) + raw + extra)
        length, n, end = self.at - start, len(self.entries), self.at
        if start >= 0xFFFFFFFF or n >= 0xFFFF:
            self._write(b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, start) + b"PK\6\7" + struct.pack("<IQI", 0, end, 1))
        self._write(b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(length, 0xFFFFFFFF), min(start, 0xFFFFFFFF), 0))


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def _rows(rows: Sequence[Sequence], header: Sequence[str], by: Mapping[str, str], formats: Formats, date_format: str) -> str:
    # An empty cell keeps its place, as cells have no reference.
    return "".join("<row>" + "".join(cell("", v, by.get(h), formats, date_format).replace(' r=""', "", 1) or "<c/>" for h, v in zip(header, row)) + "</row>" for row in rows)


def write_workbook(df: DataFrame, path: str, sheet: str = "Data", names: Mapping[str, str] | None = None, formats: Mapping[str, str] | None = None, date_format: str = "yyyy-mm-dd", frozen: bool = False,
                   info: Sequence[tuple[str, str]] = (), most_rows: int = MAX_ROWS - 1, fragment_rows: int = FRAGMENT_ROWS) -> tuple[int, int]:
    """One workbook at ``path`` of all rows, in order of partition: how many rows and cells it has.

    Columns go under ``names``, with number formats by column; dates are serials.
    Sheets after the first are called ``sheet (2)`` and so on. With ``info`` the
    workbook begins with a sheet of these pairs. Fragments lie in a folder beside
    ``path`` until they are joined, on a store that all tasks reach.
    """
    columns = df.columns
    header = [(names or {}).get(c, c) for c in columns]
    by = {(names or {}).get(c, c): f for c, f in (formats or {}).items()}
    staged = f"{path}.parts-{uuid.uuid4().hex}"
    fragment_rows = max(1, min(fragment_rows, most_rows))

    def known() -> Formats:
        """The same formats at the same index in every task."""
        out = Formats()
        for f in [*(by[h] for h in header if h in by), date_format]:
            out.of(f)
        return out

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, held, k = known(), [], 0
        store, inner = _store(staged)

        def flush() -> pa.RecordBatch:
            packed, size, crc = fragment(_rows(held, header, by, own, date_format))
            name = f"{inner}/{uuid.uuid4().hex}"
            store.create_dir(inner, recursive=True)
            with store.open_output_stream(name) as out:
                out.write(packed)
            cells = sum(v is not None and v != "" for row in held for v in row)
            return pa.RecordBatch.from_pydict({"task": pa.array([TaskContext.get().partitionId()], pa.int32()), "k": pa.array([k], pa.int32()), "name": [name], "rows": [len(held)], "cells": [cells], "size": [size], "few": [len(packed)], "crc": [crc]})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == fragment_rows:
                    yield flush()
                    held, k = [], k + 1
        if held:
            yield flush()

    found = df.mapInArrow(pack, "task int, k int, name string, rows long, cells long, size long, few long, crc long").collect()  # a row a fragment
    sheets: list[list] = [[]]
    for f in sorted(found, key=lambda f: (f.task, f.k)):
        if sum(x[3] for x in sheets[-1]) + f.rows > most_rows:
            sheets.append([])
        sheets[-1].append(tuple(f))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        store, inner = _store(path)
        own, whole = known(), f"{inner}.whole-{uuid.uuid4().hex}"
        every = ([("Info", None)] if info else []) + [(sheet if i == 0 else f"{sheet[: MAX_NAME - 5]} ({i + 1})", s) for i, s in enumerate(sheets)]
        parts = frame([n for n, _ in every], own)

        def copied(pieces: list) -> Iterator[bytes]:
            for p in pieces:
                if isinstance(p, bytes):
                    yield p
                    continue
                with store.open_input_stream(p) as source:
                    while chunk := source.read(COPIED):
                        yield chunk

        with store.open_output_stream(whole) as out:
            z = Zip(out)
            for i, (_, fragments) in enumerate(every, 1):
                first = frame.head(frozen and fragments is not None) + (_rows([header], header, {}, own, date_format) if fragments is not None else _rows([("Name", "Value"), *info], ("Name", "Value"), {}, own, date_format))
                pieces, size, few, crc = [], 0, 0, 0
                for text, staged_one in [(first, None), *((None, f) for f in fragments or ()), (frame.TAIL, None)]:
                    packed, n, own_crc = fragment(text) if text is not None else (staged_one[2], staged_one[5], staged_one[7])
                    pieces.append(packed)
                    crc, size, few = combined(crc, own_crc, n), size + n, few + (len(packed) if text is not None else staged_one[6])
                z.part(f"xl/worksheets/sheet{i}.xml", copied([*pieces, LAST]), size, few + len(LAST), crc)
            for name, text in parts.items():
                packed, size, crc = fragment(text)
                z.part(name, iter([packed, LAST]), size, len(packed) + len(LAST), crc)
            z.close()
        store.move(whole, inner)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    df.sparkSession.range(1).coalesce(1).mapInArrow(join, "path string").collect()
    store, inner = _store(staged)
    if found:
        store.delete_dir(inner)
    return sum(f.rows for f in found), sum(f.cells for f in found)
