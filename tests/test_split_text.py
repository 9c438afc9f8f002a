"""Text files cut anywhere give the rows of the file read whole."""

import csv
import io
import random

import pytest

from gridwork.sources import delimited, files


def whole(raw, delimiter):
    """The standard library's reading of a file in one go, cut to the header's width."""
    rows = [r for r in csv.reader(io.StringIO(raw.decode("utf-8-sig"), newline=""), delimiter=delimiter) if r]
    width = len(rows[0])
    return {(i, c): (r[c].strip() if c < len(r) else "") for i, r in enumerate(rows) for c in range(width)}


def made(seed, delimiter, end, quoted, rows=120):
    r = random.Random(seed)
    bits = ["a", "bc ", "é漢", '"', '""', "\n", "\r\n", delimiter, "x" * 30, "", " ", ",", ";", "|", "'"]
    out = ["id", f'na{delimiter}me' if quoted else "name", "note", "more"]
    lines = [out]
    for i in range(rows):
        lines.append([str(i), *("".join(r.choice(bits) for _ in range(r.randrange(6))) for _ in range(r.choice([2, 3, 3, 3, 5])))])
    if not quoted:  # no field needs quotes; some hold one in their middle
        lines = [[f.replace("\n", "").replace("\r", "").replace(delimiter, "").lstrip('"').replace('"', 'q"') for f in line] for line in lines]
        return end.join(delimiter.join(x) for x in lines) + end
    text = io.StringIO(newline="")
    csv.writer(text, delimiter=delimiter, lineterminator=end).writerows(lines)
    return text.getvalue() + end * 2


@pytest.fixture
def cut(spark):
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


@pytest.mark.parametrize("size", [97, 1000])
def test_cut_anywhere(spark, tmp_path, cut, size):
    """Line breaks, delimiters and doubled quotes inside quotes; quotes amid plain fields; both line ends; a mark of the encoding."""
    want = {}
    for k, (delimiter, end, quoted) in enumerate([(",", "\n", True), (";", "\r\n", True), ("\t", "\n", False), ("|", "\n", True), (",", "\r\n", False)]):
        raw = made(k, delimiter, end, quoted).encode()
        raw = delimited.BOM + raw if k % 2 else raw
        name = f"f {k}%.CSV"
        (tmp_path / name).write_bytes(raw)
        # The delimiter of the first lines, as ever; the header's is even there.
        want[name] = whole(raw, delimited.delimiter_of(delimited._head(raw.removeprefix(delimited.BOM).split(b"\n")[:5])))
    (tmp_path / "small.csv").write_text("a,b\n1,2\n")
    (tmp_path / "header.csv").write_text("a,b\n")
    want |= {"small.csv": {(0, 0): "a", (0, 1): "b", (1, 0): "1", (1, 1): "2"}, "header.csv": {(0, 0): "a", (0, 1): "b"}}
    cut(size)
    rows = delimited.read_texts(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 8
    got, rest = {}, []
    for r in rows.collect():
        name = r.file.rsplit("/", 1)[-1]
        if r.kind == "cell":
            assert (r.row_idx, r.col_idx) not in got.setdefault(name, {})
            got[name][r.row_idx, r.col_idx] = r.value
        else:
            rest.append((r.kind, name))
    assert got == want
    assert sorted(rest) == sorted([("error" if n == "header.csv" else "sheet", n) for n in want])


def test_ends_inside():
    """The state at a line's end is that of the standard library's reader."""
    r = random.Random(4)
    for _ in range(4000):
        line = "".join(r.choice('",ab') for _ in range(r.randrange(9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line + "\nZZZ"
            first = next(csv.reader(io.StringIO(text, newline="")), [])
            assert delimited.ends_inside(line.encode(), inside, b",") == ("ZZZ" in "".join(first)), (line, inside)


def test_long_fields_and_open_quotes(spark, tmp_path, cut):
    """A field of any length is whole; a quote that never closes is one row and takes no other file with it."""
    long = "z" * 700_000
    (tmp_path / "long.csv").write_text(f'a,b\n1,"{long}\n{long}"\n2,x\n')
    (tmp_path / "open.csv").write_text('a,b\n1,x\n2,"y\n' + "3,z\n" * 50_000)
    (tmp_path / "head.csv").write_text('"a\n' + "b\n" * 50_000 + '",c\n1,2\n')
    (tmp_path / "mac.csv").write_text("a,b\r1,2\r3,4\r")
    assert len(next(r for r in delimited.rows_of("f", f'a\n"{long}"\n'.encode()) if r[2] == 1)[4]) == 700_000
    cut(64_000)
    rows = delimited.read_texts(spark, str(tmp_path), most=150_000).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file.rsplit("/", 1)[-1], []).append(r)
    assert {n: [x.kind for x in v] for n, v in by.items() if n in ("open.csv", "head.csv")} == {"open.csv": ["broken"], "head.csv": ["broken"]}
    assert [r.kind for r in by["long.csv"]] == ["broken"]
    assert {(r.row_idx, r.col_idx): r.value for r in by["mac.csv"] if r.kind == "cell"} == {(0, 0): "a", (0, 1): "b", (1, 0): "1", (1, 1): "2", (2, 0): "3", (2, 1): "4"}
    rows = delimited.read_texts(spark, str(tmp_path)).filter("file LIKE '%long.csv' AND kind = 'cell'").collect()
    assert {(r.row_idx, r.col_idx): r.value for r in rows} == {(0, 0): "a", (0, 1): "b", (1, 0): "1", (1, 1): f"{long}\n{long}", (2, 0): "2", (2, 1): "x"}
    cells, errors, status = files.load(spark, str(tmp_path))
    assert {r.file.rsplit("/", 1)[-1]: r.status for r in status.collect()} == {"long.csv": "Success", "open.csv": "Success", "head.csv": "Failed", "mac.csv": "Success"}
