"""XLS workbooks made by hand: containers, records, texts over CONTINUE, and damage."""

import struct

import pytest
from pyspark.sql import functions as F

from gridwork.sources import files, xls

FREE, END, TABLE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD


def rec(number, *parts):
    """A record and CONTINUE records."""
    return b"".join(struct.pack("<HH", number if not i else xls.CONTINUE, len(p)) + p for i, p in enumerate(parts))


def text(s, length="H", wide=None):
    wide = any(ord(c) > 255 for c in s) if wide is None else wide
    raw = s.encode("utf-16-le" if wide else "latin-1")
    return struct.pack("<" + length + "B", len(raw) // (2 if wide else 1), int(wide)) + raw


def stream(sheets, sst=b"", styles=(0,), formats=(), extra=b"", version=0x0600):
    """A workbook stream of (name, records) sheets."""
    bof = lambda kind: rec(xls.BOF, struct.pack("<HHHHII", version, kind, 0, 0, 0, 0))
    name = lambda s: text(s, "B") if version == 0x0600 else bytes([len(s)]) + s.encode("cp1252")
    head = bof(5) + extra + b"".join(rec(xls.FORMAT, struct.pack("<H", c) + text(t)) for c, t in formats) + b"".join(rec(xls.XF, struct.pack("<HH", 0, s) + b"\0" * 16) for s in styles)
    size = len(head) + sum(len(rec(xls.BOUNDSHEET, b"\0" * 6 + name(n))) for n, _ in sheets) + len(sst) + 4
    places, body = [], b""
    for _, records in sheets:
        places.append(size + len(body))
        body += bof(0x10) + records + rec(xls.EOF, b"")
    bounds = b"".join(rec(xls.BOUNDSHEET, struct.pack("<IBB", p, 0, 0) + name(n)) for p, (n, _) in zip(places, sheets))
    return head + bounds + sst + rec(xls.EOF, b"") + body


def ole(raw, name="Workbook"):
    """A container of 512-byte sectors; a stream of under 4096 bytes goes to the mini stream."""
    small = len(raw) < 4096
    size = len(raw)
    whole = raw + b"\0" * (-len(raw) % (64 if small else 512))
    minis = len(whole) // 64
    data = whole + b"\0" * (-len(whole) % 512)
    n = len(data) // 512
    entry = lambda nm, kind, start, length: nm.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(nm) + 2, kind, 1) + b"\xff" * 12 + b"\0" * 36 + struct.pack("<II", start, length) + b"\0" * 4
    root = entry("Root Entry", 5, 0 if small else END, len(whole) if small else 0)
    directory = (root + entry(name, 2, 0, size)).ljust(512, b"\0")
    mini = b"".join(struct.pack("<I", i + 1 if i + 1 < minis else END) for i in range(minis)) if small else b""
    mini += struct.pack("<I", FREE) * ((-len(mini) % 512) // 4)
    m = len(mini) // 512
    table = [*range(1, n), END] + [END] + [*range(n + 2, n + 1 + m), END] * bool(m)
    t = -(-(len(table) + 1) // 127)
    table += [TABLE] * t
    fat = struct.pack(f"<{len(table)}I", *table)
    fat += struct.pack("<I", FREE) * ((-len(fat) % 512) // 4)
    ids = list(range(n + 1 + m, n + 1 + m + len(fat) // 512))
    header = xls.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<IIIIIIIIII", 0, len(ids), n, 0, 4096, n + 1 if m else END, m, END, 0, 0)[:36]
    return header.ljust(76, b"\0") + struct.pack("<109I", *(ids + [FREE] * (109 - len(ids)))) + data + directory + mini + fat


def num(r, c, v, style=0):
    return rec(xls.NUMBER, struct.pack("<HHHd", r, c, style, v))


def sst(*parts, n):
    return rec(xls.SST, struct.pack("<II", n, n) + parts[0], *parts[1:])


def label(r, c, i):
    return rec(xls.LABELSST, struct.pack("<HHHI", r, c, 0, i))


def cells(raw):
    return {(r[2], r[4], r[5]): (r[8], r[9]) for r in xls.rows_of("f.xls", raw) if r[0] == "cell"}


def test_every_kind_of_cell():
    shared = sst(text("Name") + text("Größe 漢") + text("When"), n=3)
    rk = lambda v: struct.unpack("<I", struct.pack("<i", v << 2 | 2))[0]
    hundredth = struct.unpack("<Q", struct.pack("<d", 1234.0))[0] >> 32 | 1
    formula = lambda r, c, result: rec(xls.FORMULA, struct.pack("<HHH", r, c, 0) + result + b"\0" * 8)
    sheet = (rec(0x0200, b"\0" * 14) + label(2, 0, 0) + label(2, 1, 1) + label(2, 3, 2) + label(2, 4, 7)
             + num(4, 0, 2.5) + rec(xls.RK, struct.pack("<HHHI", 4, 1, 0, rk(-7))) + rec(xls.RK, struct.pack("<HHHI", 4, 2, 0, hundredth)) + num(4, 3, 45601.5, 1) + num(4, 6, 3, 2)
             + rec(xls.MULRK, struct.pack("<HH", 5, 0) + struct.pack("<HIHI", 0, rk(1), 1, rk(45601)) + struct.pack("<H", 1))
             + rec(xls.BOOLERR, struct.pack("<HHHBB", 6, 0, 0, 1, 0)) + rec(xls.BOOLERR, struct.pack("<HHHBB", 6, 1, 0, 42, 1)) + rec(xls.LABEL, struct.pack("<HHH", 6, 2, 0) + text("12"))
             + formula(7, 0, struct.pack("<d", 0.5)) + formula(7, 1, b"\0" * 6 + b"\xff\xff") + rec(0x04BC, b"\0" * 8) + rec(xls.STRING, text("joined")) + formula(7, 2, b"\1\0\0\0\0\0\xff\xff") + formula(7, 3, b"\2\0\x2a\0\0\0\xff\xff")
             + rec(0x0201, struct.pack("<HHH", 9, 0, 0)) + rec(xls.LABEL, struct.pack("<HHH", 10, 0, 0) + text("  ")) + num(12, 8, 1e300))
    raw = stream([("Data", sheet), ("Leer", b"")], shared, styles=(0, 14, 170), formats=[(170, '"dash" [Red]0.0')])
    got = cells(ole(raw))
    assert {k: v for k, v in got.items() if k[1] == 0} == {("Data", 0, 0): ("Name", "Text"), ("Data", 0, 1): ("Größe 漢", "Text"), ("Data", 0, 3): ("When", "Text"), ("Data", 0, 4): ("[Invalid SST ref: 7]", "Text"), **{("Data", 0, c): ("", "Empty") for c in (2, 5, 6, 7, 8)}}
    want = {1: [("2.5", "FloatingPoint"), ("-7.0", "FloatingPoint"), ("12.34", "FloatingPoint"), ("2024-11-05T12:00:00", "DateTime"), None, None, ("3.0", "FloatingPoint")],
            2: [("1.0", "FloatingPoint"), ("2024-11-05T00:00:00", "DateTime")], 3: [("TRUE", "Boolean"), None, ("12", "Text")], 4: [("0.5", "FloatingPoint"), ("joined", "Text"), ("FALSE", "Boolean"), None], 5: [None] * 8 + [("1e+300", "FloatingPoint")]}
    assert {k: v for k, v in got.items() if k[1]} == {("Data", r, c): v for r, vs in want.items() for c, v in enumerate(vs) if v}
    rest = [(r[0], r[2], r[11], r[12]) for r in xls.rows_of("f.xls", ole(raw)) if r[0] != "cell"]
    assert rest == [("sheet", "Data", "1900", None), ("error", "Leer", None, "Info")]


@pytest.mark.parametrize("cut", [1, 7, 8224])
def test_texts_over_continue(cut):
    """Texts cut anywhere, in one- and two-byte parts, with runs of fonts and further data behind them."""
    words = ["abc", "x" * 9000, "漢字" * 3000, "é", "😀" * 50, ""]
    whole, marks = b"", []  # bytes, and where characters of a text lie
    for k, w in enumerate(words):
        wide = any(ord(c) > 255 for c in w)
        raw = w.encode("utf-16-le" if wide else "latin-1")
        flags = int(wide) | (8 if k == 1 else 0) | (4 if k == 2 else 0)
        whole += struct.pack("<HB", len(raw) // (2 if wide else 1), flags) + (struct.pack("<H", 3) if k == 1 else b"") + (struct.pack("<I", 11) if k == 2 else b"")
        marks.append((len(whole), len(whole) + len(raw), wide))
        whole += raw + (b"R" * 12 if k == 1 else b"") + (b"E" * 11 if k == 2 else b"")
    parts, at = [], 0
    while at < len(whole):
        end = min(len(whole), at + max(cut, 3000 if cut < 8 else cut))
        inside = next((m for m in marks if m[0] < end < m[1]), None)
        if inside and inside[2] and (end - inside[0]) % 2:
            end -= 1
        elif not inside and end < len(whole):  # only characters may be cut here
            end = next((m[0] for m in marks if m[0] >= end and m[1] > m[0]), len(whole))
        head = next((bytes([m[2]]) for m in marks if m[0] < at < m[1]), b"")
        parts.append(head + whole[at:end])
        at = end
    sheet = b"".join(label(0, i, i) for i in range(len(words)))
    got = cells(ole(stream([("S", sheet)], sst(*parts, n=len(words)))))
    assert [got["S", 0, i][0] for i in range(5)] == words[:5] and len(parts) > 2


def test_containers():
    small, large = stream([("S", num(0, 0, 1.0))]), stream([("S", b"".join(num(r, c, r * 10 + c) for r in range(3000) for c in range(5)))])
    assert len(small) < 4096 < len(large)
    assert cells(ole(small)) == cells(small) == {("S", 0, 0): ("1.0", "FloatingPoint")}
    assert len(cells(ole(large, "Book"))) == 15_000 and cells(ole(large))["S", 2999, 4] == ("29994.0", "FloatingPoint")


def test_old_version_and_1904():
    sheet = rec(xls.LABEL, struct.pack("<HHHH", 0, 0, 0, 3) + "à€b".encode("cp1252")) + num(1, 0, 1.0, 1)
    raw = stream([("Ä", sheet)], extra=rec(xls.CODEPAGE, struct.pack("<H", 1252)) + rec(xls.DATEMODE, b"\1\0"), styles=(0, 14), version=0x0500)
    assert cells(ole(raw)) == {("Ä", 0, 0): ("à€b", "Text"), ("Ä", 1, 0): ("1904-01-02T00:00:00", "DateTime")}
    assert [xls.moment(s, False) for s in (1, 59, 61, 0.5, -1, 3e6)] == ["1900-01-01T00:00:00", "1900-02-28T00:00:00", "1900-03-01T00:00:00", "1899-12-31T12:00:00", None, None]
    assert [xls.is_date(200, f) for f in ("yyyy-mm-dd", "[h]:mm", "0.00", "[Red]0", 'General "day"', "d\\d")] == [True, True, False, False, False, True] and xls.is_date(30, None)


def test_damage(spark, tmp_path):
    """Each broken file is a row; the others are read."""
    good = stream([("A", rec(xls.LABEL, struct.pack("<HHH", 0, 0, 0) + text("N")) + num(1, 0, 1.5) + rec(xls.LABEL, struct.pack("<HHH", 2, 0, 0) + text("12"))), ("B", num(0, 0, 1.0))])
    whole = ole(stream([("A", b"".join(num(r, 0, r) for r in range(900)))]))
    circle = bytearray(whole)
    at = whole.rindex(struct.pack("<II", 1, 2))
    circle[at + 4 : at + 8] = struct.pack("<I", 0)
    table = {"good.XLS": ole(good), "text.xls": b"text", "cut.xlt": whole[: len(whole) // 2], "circle.xls": bytes(circle), "secret.xls": ole(stream([("A", num(0, 0, 1.0))], extra=rec(xls.FILEPASS, b"\0" * 6))),
             "none.xls": ole(stream([])), "half.xls": ole(good[:-30]), "empty.xls": b"", "emp ty%20.csv": b""}
    for name, raw in table.items():
        (tmp_path / name).write_bytes(raw)
    found, errors, status = files.load(spark, str(tmp_path))
    by = {r.file.rsplit("/", 1)[-1]: (r.status, r.sheets) for r in status.collect()}
    failed = ("Failed", 0)
    assert by == {"good.XLS": ("Success", 2), "text.xls": failed, "cut.xlt": failed, "circle.xls": failed, "secret.xls": failed, "none.xls": ("Success", 0), "half.xls": ("PartialSuccess", 1), "empty.xls": failed, "emp ty%20.csv": failed}
    rows = {(r.row_idx, r.col_name): (r.value, r.tag) for r in found.filter(F.col("file").endswith("good.XLS") & (F.col("sheet") == "A")).collect()}
    assert rows == {(0, "N"): ("N", "Text"), (1, "N"): ("1.5", "FloatingPoint"), (2, "N"): ("12", "Integer")}
    assert {r.severity for r in errors.filter(F.col("file").endswith("none.xls")).collect()} == {"Warning"}
