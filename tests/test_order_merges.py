"""Places in an order over many ranges; merged ranges by their index."""

import random

from pyspark.sql import functions as F

from gridwork.operators import compare, merged, order
from gridwork.sources import xlsx


def test_numbered_over_many_ranges(spark):
    df = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), (F.col("id") % 7).alias("g")).repartition(6)
    got = order.numbered(df, ["g", "k"])
    assert "_range" not in got.columns and [r.place for r in got.orderBy("g", "k").collect()] == list(range(20_000))
    same = spark.range(5000).select(F.lit("x").alias("k"))  # all equal: places are still a count
    assert sorted(r.place for r in order.numbered(same, ["k"]).collect()) == list(range(5000))
    few = spark.createDataFrame([("b",), (None,), ("a",)], "k string")
    assert {r.k: r.place for r in order.numbered(few, ["k"]).collect()} == {None: 0, "a": 1, "b": 2}
    assert order.numbered(few.limit(0), ["k"]).collect() == []


def test_numbered_ranges_are_even(spark):
    """No range holds much more than its share, also when all keys begin alike."""
    df = spark.range(50_000).select(F.format_string("Customer#%09d", F.col("id")).alias("k"))
    plan = order.numbered(df, ["k"])
    assert plan.select(F.max("place")).first()[0] == 49_999
    shown = df.select("k").orderBy(F.xxhash64(F.struct("k"))).limit(order.SHOWN * order.RANGES).orderBy("k").collect()
    cuts = [r.k for r in shown][:: max(1, len(shown) // order.RANGES)][1:]
    table = spark.createDataFrame([(cuts,)], "_cuts array<string>")
    by = df.join(F.broadcast(table)).select("k", order._at_most("_cuts", len(cuts), F.col("k")).alias("n"), F.size(F.filter("_cuts", lambda c: c <= F.col("k"))).alias("want"))
    assert by.filter("n <> want").count() == 0
    sizes = by.groupBy("n").count().collect()
    assert len(sizes) >= 90 and max(r["count"] for r in sizes) < 3 * 50_000 / len(sizes)


def test_verdict_ranks(spark):
    """Ranks by frequency, then value, within each group, where all values begin alike and occur once."""
    import math

    cells = spark.range(6000).select((F.col("id") % 3).alias("g"), F.format_string("Customer#%09d", F.col("id")).alias("value")).unionByName(spark.createDataFrame([(0, "Customer#000000003"), (1, "b"), (2, "")], "g long, value string"))
    got = {(r.g, r.value): r.intensity for r in compare.verdicts(cells, ["g"]).select("g", "value", "intensity").distinct().collect()}
    for g in range(3):
        counts = {}
        for r in cells.filter(F.col("g") == g).collect():
            counts[r.value] = counts.get(r.value, 0) + bool(r.value)
        ordered = sorted((v for v in counts if v), key=lambda v: (-counts[v], v))
        for k, v in enumerate(ordered):
            assert abs(got[g, v] - math.log(1 + k / (len(ordered) - 1) * (math.e - 1))) < 1e-9


def test_merges_by_index(spark):
    """Random ranges of all sizes, overlapping ones too, against a look at every range for every cell."""
    r = random.Random(9)
    ranges = [("f", o, r0 := r.randrange(300), c0 := r.randrange(60), r0 + r.choice([0, 1, 2, 7, 8, 100, 255]), c0 + r.choice([0, 1, 3, 4, 31])) for o in range(60)] + [("g", 0, 0, 0, 2**20 - 1, 2**14 - 1)]
    cells = [(f, row, col, f"{row}:{col}") for f in ("f", "g", "none") for row in range(0, 400, 3) for col in range(0, 90, 4)]
    df = spark.createDataFrame(cells, "file string, row_idx long, col_idx int, value string")
    rg = spark.createDataFrame([(f, o, a, b, c, d) for f, o, a, b, c, d in ranges], "file string, ord long, r0 long, c0 int, r1 long, c1 int")
    index = merged.covered(df, rg, ["file"])
    want = {}
    for f, row, col, _ in cells:
        hit = [(o, a, b) for g, o, a, b, c, d in ranges if g == f and a <= row <= c and b <= col <= d]
        if hit:
            want[f, row, col] = max(hit)
    assert {(x.file, x.row_idx, x.col_idx): (x.ord, x.r0, x.c0) for x in index.collect()} == want
    kept = {(x.file, x.row_idx, x.col_idx): x.value for x in merged.resolve(df, rg, "keep", ["file"]).collect()}
    assert kept == {(f, row, col): (v if (f, row, col) not in want or want[f, row, col][1:] == (row, col) else None) for f, row, col, v in cells}
    assert "Generate" in index._jdf.queryExecution().executedPlan().toString()
    # The range over a whole sheet is one row of the index, not a row a cell.
    assert merged.covered(df.filter("file = 'g' AND row_idx = 0 AND col_idx = 0"), rg.filter("file = 'g'"), ["file"]).count() == 1


def test_last_in_file_order_wins(spark, tmp_path):
    from tests.test_workbooks import book

    (tmp_path / "f.xlsx").write_bytes(book("<sheetData><row r='1'><c r='A1'><v>1</v></c><c r='B1'><v>2</v></c></row><row r='2'><c r='A2'><v>3</v></c><c r='B2'><v>4</v></c></row></sheetData><mergeCells><mergeCell ref='B1:B2'/><mergeCell ref='A1:B1'/></mergeCells>"))
    rows = xlsx.read_workbooks(spark, str(tmp_path))
    assert [(x.ord, x.r0, x.c0) for x in xlsx.merged_ranges(rows).orderBy("ord").collect()] == [(0, 0, 1), (1, 0, 0)]
    out = merged.resolve(rows.filter("kind = 'cell'").select("file", "sheet", "row_idx", "col_idx", "value"), xlsx.merged_ranges(rows), by=["file", "sheet"])
    assert {(x.row_idx, x.col_idx): x.value for x in out.collect()} == {(0, 0): "1", (0, 1): "1", (1, 0): "3", (1, 1): "2"}
