"""The data source: the same rows as whole files give, in many tasks, with filters inside, by ranged reads."""

import io
import struct
import zipfile

import pytest

from gridwork.sources import ranged, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, extra=(), shared=("Name", "x")):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Type="t" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        for i, (_, xml) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}>{xml}</worksheet>")
        for name, raw in extra:
            z.writestr(name, raw)
    return out.getvalue()


def data(rows, columns, merge=""):
    return "<sheetData>" + "".join(f'<row r="{r + 1}">' + "".join(f"<c><v>{r * 1000 + c}</v></c>" for c in range(columns)) + "</row>" for r in range(rows)) + "</sheetData>" + merge


@pytest.fixture
def folder(tmp_path):
    import random

    (tmp_path / "deep").mkdir()
    (tmp_path / "one.xlsx").write_bytes(book([("A", data(50, 4, '<mergeCells><mergeCell ref="A1:B2"/></mergeCells>')), ("B", data(3, 2)), ("Empty", "<sheetData/>")]))
    (tmp_path / "deep" / "UPPER.XLSM").write_bytes(book([("B", data(2, 2))]))
    noise = random.Random(1).randbytes(60_000)
    (tmp_path / "large.xlsx").write_bytes(book([(f"S{i}", data(200, 5)) for i in range(6)], [("noise.bin", noise)]))
    (tmp_path / "bad.xltx").write_bytes(b"no zip")
    (tmp_path / "cut.xlsx").write_bytes(book([("A", data(9, 9))])[:-30])
    (tmp_path / "skip.csv").write_text("a,b\n")
    return str(tmp_path)


def plain(df):
    return sorted((repr(r).replace("file:", "") for r in df.collect()))


def test_same_rows(spark, folder):
    ranged.register(spark)
    got = spark.read.format("gridwork").option("splitBytes", "40000").load(folder)
    assert plain(got) == plain(xlsx.read_workbooks(spark, folder))
    assert got.rdd.getNumPartitions() == 7  # six sheets of the large file, and all others together
    assert spark.read.format("gridwork").option("packBytes", "1").load(folder).rdd.getNumPartitions() == 5


@pytest.mark.parametrize("where, tasks", [("sheet = 'S3'", 2), ("sheet IN ('S1', 'S4', 'B') AND col_idx = 1", 3), ("kind = 'cell' AND row_idx < 5", 7), ("kind = 'cell' AND row_idx >= 195 AND col_idx <= 2", 7), ("kind = 'sheet'", 7), ("kind = 'merge'", 7),
                                          ("file LIKE '%large.xlsx' AND row_idx = 3", 7), ("row_idx IS NULL", 7), ("sheet = 'none'", 1), ("kind = 'error' AND severity = 'Info'", 7), ("row_idx > 48 AND row_idx <= 60 AND tag = 'Integer'", 7)])
def test_filters_inside(spark, folder, where, tasks):
    ranged.register(spark)
    got = spark.read.format("gridwork").option("splitBytes", "40000").load(folder).filter(where)
    assert plain(got) == plain(xlsx.read_workbooks(spark, folder).filter(where))
    assert got.rdd.getNumPartitions() == tasks


def test_filter_on_a_file(spark, folder):
    ranged.register(spark)
    got = spark.read.format("gridwork").load(folder).filter(f"file = '{folder}/one.xlsx'")
    assert {r.file for r in got.collect()} == {f"{folder}/one.xlsx"} and "Filter " not in got._jdf.queryExecution().executedPlan().toString()


class Counted(io.BytesIO):
    fetched = 0

    def read(self, n=-1):
        out = super().read(n)
        self.fetched += len(out)
        return out


def test_bombs_are_refused_by_their_directory():
    """Less than a megabyte is read, wherever the bomb lies."""
    zeros = b"\0" * 30_000_000
    ratio = book([("A", data(2, 2))], [("zeros.bin", zeros)])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(20_000):
            z.writestr(f"{'long' * 12}{i}", b"")
    many = out.getvalue()
    # Declared sizes of eight bytes: three terabytes in one part.
    raw = bytearray(book([("A", data(2, 2))], [("noise.bin", bytes(range(256)) * 4000)]))
    at = raw.rindex(b"PK\1\2")
    size = struct.unpack_from("<HHH", raw, at + 28)
    extra = struct.pack("<HHQ", 1, 8, 3 * 10**12)
    raw[at + 24 : at + 28], raw[at + 30 : at + 32] = b"\xff" * 4, struct.pack("<H", len(extra))
    raw[at + 46 + size[0] : at + 46 + size[0]] = extra
    end = raw.rindex(b"PK\5\6")
    raw[end + 12 : end + 16] = struct.pack("<I", struct.unpack_from("<I", raw, end + 12)[0] + len(extra))
    for bomb in (ratio, many, bytes(raw)):
        file = Counted(bomb)
        assert ranged.refused(file, len(bomb)).startswith("suspicious compression") and file.fetched < 1_000_000


def test_directory_of_the_large_form():
    """An end with eight-byte numbers says the same as the short one."""
    raw = book([("A", data(5, 5))])
    end = raw.rindex(b"PK\5\6")
    n, length, place = struct.unpack_from("<HII", raw, end + 10)
    large = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, length, place)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, end, 1)
    short = raw[end : end + 8] + b"\xff" * 12 + b"\0\0"
    whole = raw[:end] + large + locator + short
    assert ranged.directory(io.BytesIO(whole), len(whole)) == ranged.directory(io.BytesIO(raw), len(raw)) == [(p.filename, p.file_size, p.compress_size) for p in zipfile.ZipFile(io.BytesIO(raw)).infolist()]
    assert ranged.refused(io.BytesIO(whole), len(whole)) is None


def test_only_what_is_needed_is_fetched(tmp_path):
    from pyarrow import fs

    noise = __import__("random").Random(2).randbytes(3_000_000)
    (tmp_path / "f.xlsx").write_bytes(book([("A", data(5, 5)), ("B", data(4, 4))], [("noise.bin", noise)]))
    size = (tmp_path / "f.xlsx").stat().st_size
    with ranged.Ranged(fs.LocalFileSystem().open_input_file(str(tmp_path / "f.xlsx")), size) as opened:
        rows = list(ranged.rows_of("f", opened, ranged.Wanted(), only=1))
        assert {r[2] for r in rows} == {"B"} and len(rows) == 17 and opened.fetched < 1_000_000 < size
