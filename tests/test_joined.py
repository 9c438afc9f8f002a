"""One workbook of many tasks: valid for the zip library, equal to the rows, with combined checksums."""

import io
import random
import zipfile
import zlib
from datetime import date

from pyspark.sql import functions as F

from gridwork.sinks import joined
from gridwork.sources import xlsx


def test_combined_checksums():
    r = random.Random(1)
    for n in (0, 1, 7, 1000, 70_001):
        a, b = r.randbytes(r.randrange(50)), r.randbytes(n)
        assert joined.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_fragments_join_without_unpacking():
    texts = ["<a>", "é漢" * 3000, "", "x" * 100_000, "</a>"]
    parts = [joined.fragment(t) for t in texts]
    raw = "".join(texts).encode()
    assert zlib.decompress(b"".join(p for p, _, _ in parts) + joined.LAST, -15) == raw and sum(n for _, n, _ in parts) == len(raw)
    out = io.BytesIO()
    z, crc = joined.Zip(out), 0
    for _, n, c in parts:
        crc = joined.combined(crc, c, n)
    z.part("one.xml", iter([p for p, _, _ in parts] + [joined.LAST]), len(raw), sum(len(p) for p, _, _ in parts) + len(joined.LAST), crc)
    z.close()
    assert zipfile.ZipFile(out).testzip() is None and zipfile.ZipFile(out).read("one.xml") == raw


def test_one_workbook(spark, tmp_path):
    """Many partitions, empty ones too, several sheets, gaps, dates, formats; nothing is left beside the file."""
    df = spark.range(0, 5000, 1, 7).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("n & <"), F.col("id").cast("string"))).alias("name"), (F.col("id") / 8).alias("amount"), F.when(F.col("id") % 2 == 0, F.lit(date(2024, 11, 5))).alias("day"), (F.col("id") % 2 == 0).alias("even"))
    df = df.filter("id < 1000 OR id >= 2000")
    path = f"{tmp_path}/out/book.xlsx"
    (tmp_path / "out").mkdir()
    rows, cells = joined.write_workbook(df, path, "Numbers", {"name": "Label"}, {"amount": "#,##0.00"}, frozen=True, info=[("Terms", "x & y")], most_rows=1500, fragment_rows=400)
    assert rows == 4000 and [p.name for p in (tmp_path / "out").iterdir()] == ["book.xlsx"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
    got = xlsx.read_workbooks(spark, f"{tmp_path}/out").filter("kind = 'cell' AND tag <> 'Empty'").collect()
    assert cells + 5 * 3 + 4 == len(got)
    by = {}
    for r in got:
        by.setdefault((r.sheet, r.row_idx), {})[r.col_idx] = (r.value, r.tag, r.fmt)
    assert by["Info", 1] == {0: ("Terms", "Text", None), 1: ("x & y", "Text", None)}
    sheets = ["Numbers", "Numbers (2)", "Numbers (3)"]
    data = [by[s, k] for s in sheets for k in range(1, 1600) if (s, k) in by]
    assert all({c: v[0] for c, v in by[s, 0].items()} == {0: "id", 1: "Label", 2: "amount", 3: "day", 4: "even"} for s in sheets)
    for want, have in zip(sorted(df.collect()), data, strict=True):
        row = {0: (str(want.id), "Integer", None), 2: have[2], 4: (str(want.even).upper(), "Boolean", None)}
        row |= {1: (want.name, "Text", None)} if want.name else {}
        row |= {3: ("45601", "Integer", "yyyy-mm-dd")} if want.day else {}
        assert have == row and float(have[2][0]) == want.amount and have[2][2] == "#,##0.00"


def test_no_rows_and_over_a_sheet(spark, tmp_path):
    assert joined.write_workbook(spark.range(0), f"{tmp_path}/none.xlsx") == (0, 0)
    assert {r.value for r in xlsx.read_workbooks(spark, f"{tmp_path}/none.xlsx").filter("kind = 'cell'").collect()} == {"id"}
    assert joined.write_workbook(spark.range(0, 1_100_000, 1, 8), f"{tmp_path}/large.xlsx", fragment_rows=50_000) == (1_100_000, 1_100_000)
    from gridwork.sources import ranged

    ranged.register(spark)
    found = spark.read.format("gridwork").option("splitBytes", "1000").load(f"{tmp_path}/large.xlsx").filter("kind = 'cell' AND row_idx > 0").groupBy("sheet").agg(F.count("*").alias("n"), F.max("row_idx").alias("last"), F.sum(F.col("value").cast("long")).alias("total")).collect()
    assert sum(r.n for r in found) == 1_100_000 and len(found) == 2 and max(r.last for r in found) <= 1_048_575 and sum(r.total for r in found) == 1_100_000 * 1_099_999 // 2
