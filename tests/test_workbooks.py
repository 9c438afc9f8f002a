"""Workbooks, loads, exports and records: what a round trip gives, and what broken files give."""

import io
import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from gridwork import catalog
from gridwork.functions import scalars as X
from gridwork.operators import enrich, merged, sheet, template
from gridwork.sinks import delimited, xlsx as sink
from gridwork.sources import files, records, xlsx

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def book(sheet_xml, shared=(), styles="", workbook_pr=""):
    """A workbook by hand: one sheet's XML."""
    out = io.BytesIO()
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{rel}">{workbook_pr}<sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="t" Target="worksheets/s.xml"/></Relationships>')
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>")
        if styles:
            z.writestr("xl/styles.xml", f"<styleSheet {MAIN}>{styles}</styleSheet>")
        z.writestr("xl/worksheets/s.xml", f"<worksheet {MAIN}>{sheet_xml}</worksheet>")
    return out.getvalue()


def test_cells_of_a_workbook():
    styles = '<numFmts><numFmt numFmtId="170" formatCode="[$€-407] 0.00"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs>'
    raw = book('<sheetData><row r="2"><c r="B2" t="s"><v>0</v></c><c t="s"><v>9</v></c><c t="s"><v>-1</v></c><c t="s"><v>x</v></c></row>'
               '<row><c r="B3"><v>5.0</v></c><c s="1"><v>45601</v></c><c s="2"><v>1.25</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="inlineStr"><is><t>12</t></is></c><c t="str"><v>7</v></c><c s="9"/><c><v>abc</v></c></row></sheetData>'
               '<mergeCells><mergeCell ref="A1:C2"/><mergeCell ref="C3:A1"/><mergeCell ref="nonsense"/></mergeCells>', ["Name"], styles, '<workbookPr date1904="1"/>')
    rows = list(xlsx.rows_of("f.xlsx", raw))
    cells = [(r[4], r[5], r[8], r[9], r[10]) for r in rows if r[0] == "cell"]
    assert cells[:4] == [(1, 1, "Name", "Text", None), (1, 2, "[Invalid SST ref: 9]", "Text", None), (1, 3, "[Invalid SST ref: -1]", "Text", None), (1, 4, "[Invalid SST ref: x]", "Text", None)]
    assert cells[4:] == [(2, 1, "5", "Integer", None), (2, 2, "45601", "Integer", "mm/dd/yyyy"), (2, 3, "1.25", "FloatingPoint", "[$€-407] 0.00"), (2, 4, "TRUE", "Boolean", None), (2, 5, "#ERROR: #N/A", "Text", None), (2, 6, "12", "Text", None), (2, 7, "7", "Text", None), (2, 8, "", "Empty", None), (2, 9, "abc", "Text", None)]
    assert [(r[4], r[5], r[6], r[7]) for r in rows if r[0] == "merge"] == [(0, 0, 1, 2)]
    assert [r[12] for r in rows if r[0] == "error"] == ["Warning", "Warning"] and next(r for r in rows if r[0] == "sheet")[11] == "1904"


def test_load_a_folder(spark, tmp_path):
    """One broken, one empty, one foreign and two good files: each has its status, and none fails the job."""
    good = [(1, "a", 2.5, date(2024, 11, 5), True), (2, "b & <c>", None, None, False), (3, " x\n", 1e-7, date(1999, 1, 2), None)]
    df = spark.createDataFrame(good, "id long, name string, amount double, day date, ok boolean").coalesce(1)
    manifest = sink.write_xlsx(df, f"{tmp_path}/in", "A sheet with a name that is much too long", {"name": "Label"}, {"amount": "#,##0.00"}, frozen=True, info=[("Terms", "x")]).collect()
    assert [(m.rows, m.cells) for m in manifest] == [(3, 12)]
    (tmp_path / "in" / "bad.xlsx").write_bytes(b"PK not a zip")
    (tmp_path / "in" / "cut.xlsx").write_bytes(open(manifest[0].path, "rb").read()[:200])
    (tmp_path / "in" / "empty.xlsx").write_bytes(book("<sheetData/>"))
    (tmp_path / "in" / "wrong.xlsx").write_bytes(book("<sheetData><row><c r='1A'><v>1</v></c></row></sheetData>"))
    (tmp_path / "in" / "old.xls").write_bytes(b"text")
    (tmp_path / "in" / "UPPER.XLSX").write_bytes(open(manifest[0].path, "rb").read())
    (tmp_path / "in" / "t.csv").write_text("id;what\n1;=2+3\n2,5;x\n")
    cells, errors, status = files.load(spark, str(tmp_path / "in"))
    by = {r.file.rsplit("/", 1)[-1]: (r.status, r.sheets) for r in status.collect()}
    name = manifest[0].path.rsplit("/", 1)[-1]
    assert by == {name: ("Success", 2), "bad.xlsx": ("Failed", 0), "cut.xlsx": ("Failed", 0), "empty.xlsx": ("Success", 0), "wrong.xlsx": ("Failed", 0), "UPPER.XLSX": ("Success", 2), "old.xls": ("Failed", 0), "t.csv": ("Success", 1)}
    assert {r.severity for r in errors.filter("file LIKE '%empty.xlsx'").collect()} == {"Info"}
    rows = cells.filter(F.col("file").endswith(name) & (F.col("sheet") == "A sheet with a name that is muc")).collect()
    table = {(r.row_idx, r.col_name): (r.value, r.tag, r.fmt) for r in rows}
    assert table[0, "Label"] == ("Label", "Text", None) and table[1, "id"] == ("1", "Integer", None) and table[1, "amount"] == ("2.5", "FloatingPoint", "#,##0.00")
    assert table[2, "Label"][0] == "b & <c>" and table[3, "Label"][0] == " x\n" and table[1, "ok"][:2] == ("TRUE", "Boolean") and (2, "day") not in table
    assert table[1, "day"] == (str(45601), "Integer", "yyyy-mm-dd")
    text = {(r.row_idx, r.col_name): r.value for r in cells.filter(F.col("file").endswith("t.csv")).collect()}
    assert text == {(0, "id"): "id", (0, "what"): "what", (1, "id"): "1.0", (1, "what"): "'=2+3", (2, "id"): "25.0", (2, "what"): "x"}
    with pytest.raises(ValueError):
        files.kind_of(" ")
    assert files.kind_of("A.XLSM") == "workbook" and files.kind_of("a.pdf") is None


def test_parts_of_an_export(spark, tmp_path):
    manifest = sink.write_xlsx(spark.range(25).repartition(2), str(tmp_path), rows_per_file=10).collect()
    assert sum(m.rows for m in manifest) == 25 and max(m.rows for m in manifest) <= 10
    assert xlsx.read_xlsx(spark, str(tmp_path)).filter("row_idx > 0").count() == 25


def test_headers_and_merges(spark):
    cells = [("f", "S", 0, 2, 1, "A", "Text", None), ("f", "S", 0, 2, 3, "A", "Text", None), ("f", "S", 0, 2, 2, " ", "Text", None), ("f", "S", 0, 5, 0, "left", "Text", None), ("f", "S", 0, 5, 1, "v", "Text", None), ("f", "S", 0, 5, 9, "right", "Text", None), ("f", "S", 0, 5, 3, "w", "Text", None), ("f", "S", 0, 5, 2, "", "Empty", None)]
    df = spark.createDataFrame(cells, "file string, sheet string, sheet_idx int, row_idx long, col_idx int, value string, tag string, fmt string")
    named = sheet.with_headers(df)
    assert sorted((r.row_idx, r.col_idx, r.col_name) for r in named.collect()) == [(2, 1, "A"), (2, 2, "Column_2"), (2, 3, "A_2"), (5, 1, "A"), (5, 2, "Column_2"), (5, 3, "A_2")]
    ranges = spark.createDataFrame([("f", "S", 1, 5, 1, 5, 2)], "file string, sheet string, ord int, r0 long, c0 int, r1 long, c1 int")
    out = {(r.row_idx, r.col_idx): (r.value, r.tag) for r in enrich.resolved(named, ranges).collect()}
    assert out[5, 2] == ("v", "Text") and out[5, 1] == ("v", "Text") and out[5, 3] == ("w", "Text")
    # Ranges and cells of another workbook stay apart.
    other = ranges.withColumn("file", F.lit("g"))
    assert {r.value for r in merged.resolve(named.select("file", "sheet", "row_idx", "col_idx", "value"), other, by=["file", "sheet"]).collect()} == {"A", " ", "v", "w", ""}


def test_cells_are_not_broadcast(spark, tmp_path):
    """Packed files look small; the names of their columns go to the cells, not all cells to the names."""
    rows = spark.range(3000).select("id", F.lit("x").alias("Name")).repartition(3)
    sink.write_xlsx(rows, str(tmp_path)).collect()
    cells, _, _ = files.load(spark, str(tmp_path))
    assert "BuildLeft" not in cells._jdf.queryExecution().executedPlan().toString()
    got = cells.filter("row_idx > 0").groupBy("file", "col_name").count().collect()
    assert len(got) == 6 and {r.col_name for r in got} == {"id", "Name"} and sum(r["count"] for r in got) == 6000


@pytest.mark.parametrize("name", ["load_folder", "load_folder_status"])
def test_loads_spread_their_cells(spark, sf, name):
    """The task that has the names of the columns is not sent all cells."""
    plan = catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and "SortMergeJoin" in plan


def test_no_task_has_most_cells(spark, tmp_path, monkeypatch):
    """A task's share of a load doesn't grow with the folder: one column of one long sheet goes to many tasks."""
    monkeypatch.setattr(sheet, "STRETCH", 50)
    sink.write_xlsx(spark.range(4000).select("id").coalesce(1), str(tmp_path)).collect()
    cells, _, _ = files.load(spark, str(tmp_path))
    shares = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(shares) == 4001 and max(shares) < 2000
    assert [tuple(r) for r in cells.filter("row_idx > 0").agg(F.count("*"), F.countDistinct("row_idx"), F.min("col_name"), F.max("col_name"), F.sum(F.col("value").cast("long"))).collect()] == [(4000, 4000, "id", "id", 7998000)]
    monkeypatch.setattr(files, "TASK_BYTES", 1000)
    cells, _, _ = files.load(spark, str(tmp_path))
    assert cells.rdd.getNumPartitions() > 8  # by the bytes of the files, above the 8 of the session


@pytest.mark.parametrize("shape, level", [((2, 5), ("Simple", "ExpandValue", 0, 1)), ((3, 3), ("Simple", "ExpandValue", 0, 0)), ((5, 2), ("Complex", "KeepTopLeft", 1, 0))])
def test_merge_shapes(spark, shape, level):
    r = merged.complexity(spark.createDataFrame([(1, 30, 30, 30 + shape[0] - 1, 30 + shape[1] - 1)], "ord int, r0 long, c0 int, r1 long, c1 int")).first()
    assert (r.level, r.advice, r.vertical, r.horizontal) == level


def test_comparison_export(spark, tmp_path):
    cells = [(1, "/a/f.xlsx", "S", 4, "Date", "Integer", "45601", "mm/dd/yyyy"), (1, "/a/f.xlsx", "S", 4, "Sum", "FloatingPoint", "0.15", "0%"), (2, "/b/g.xlsx", "S", 7, "Sum", "FloatingPoint", "2.345", None)]
    rows = spark.createDataFrame(cells, "ord int, file string, sheet string, row_idx long, col_name string, tag string, value string, fmt string")
    out = delimited.comparison_table(rows, ["Date", "Sum"])
    assert [tuple(r) for r in out.collect()] == [("f.xlsx", "S", 5, "11/05/2024", "0"), ("g.xlsx", "S", 8, "", "2.345")]
    delimited.write_csv(out, f"{tmp_path}/csv", bom=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "csv").glob("part*")))
    assert text.startswith("﻿Source File,Sheet,Row,Date,Sum\n") and "f.xlsx,S,5,11/05/2024,0" in text
    info = sink.comparison_info(["a", "a", "b"], ["f", "g"], datetime(2024, 1, 2, 3, 4), 2, "mine")
    assert info[:2] == [("Terms", "a, b"), ("Files", "f, g")] and info[3] == ("Rows", "2")


def test_records(spark, tmp_path):
    folder = f"{tmp_path}/templates"
    made = template.Template("b/../x", (template.Expected("A"),))
    path = records.save_template(folder, made)
    assert path.endswith("/b____x.json") or "/.." not in path
    with pytest.raises(FileExistsError):
        records.save_template(folder, made)
    records.save_template(folder, template.Template("Alpha", (template.Expected("B", "Text", 1, currency="EUR"),), (template.Rule("B", "NotEmpty"),), sheet="S"))
    (tmp_path / "templates" / "broken.json").write_text("{")
    (tmp_path / "templates" / "other.json").write_text("[1]")
    assert [t.name for t in records.load_templates(spark, folder)] == ["Alpha", "b/../x"]
    assert records.delete_template(folder, "Alpha") and not records.delete_template(folder, "Alpha")
    logs = spark.createDataFrame([("/x/A b.xlsx", datetime(2024, 1, 1), "Success", 1, []), ("/x/a B.xlsx", datetime(2024, 2, 1), "Failed", 0, ["e"])], records.LOG)
    records.write_logs(logs, f"{tmp_path}/logs")
    (tmp_path / "logs" / "part-bad.json").write_text("not json\n")
    back = records.read_logs(spark, f"{tmp_path}/logs")
    assert [r.status for r in records.log_history(back, "/X/a b.xlsx").collect()] == ["Failed", "Success"] and records.latest_logs(back).first().status == "Failed"
    assert records.without_logs(back, "/x/a b.xlsx").count() == 0 and back.first().name.startswith("a_b_")
    assert records.Settings.load('{"header_rows": 99, "output_folder": " ", "date_format": 5, "semantic_names": false}') == records.Settings(1, "exports", "yyyy-MM-dd", False)
    assert records.Settings.load("{") == records.Settings() and records.Settings.load('{"header_rows": 3}').header_rows == 3
    bad = spark.createDataFrame([("{",), (None,)], "t string").select(records.error_of(F.col("t")).alias("e")).collect()
    assert all(r.e.code is None and r.e.row is None for r in bad)


def test_ladders(spark):
    rows = [("Integer", "45601", "mm/dd/yyyy"), ("FloatingPoint", "45602.5", "mm/dd/yyyy"), ("Text", "1.234,56", "#,##0.00"), ("Text", "✓", None), ("Text", "1/2/2024 3:04 PM", None), ("DateTime", "2024-01-02", None), ("Boolean", "TRUE", None), ("Empty", "", None), ("Text", None, None)]
    df = spark.createDataFrame(rows, "tag string, text string, fmt string").select(X.normalize(F.col("tag"), F.col("text"), F.col("fmt")).alias("n"), X.normalize(F.col("tag"), F.col("text"), F.col("fmt"), integers=True)["date"].alias("whole"))
    got = [(r.n.type, r.n.number, r.n.flag, r.n.date) for r in df.collect()]
    assert got[0] == ("Unknown", None, None, None) and got[1] == ("Date", None, None, datetime(2024, 11, 5, 12)) and got[2][:2] == ("Number", 1234.56) and got[3][2] is True
    assert got[4][3] == datetime(2024, 1, 2, 15, 4) and got[5][3] == datetime(2024, 1, 2) and got[6][2] is True and got[7][0] == got[8][0] == "Unknown"
    assert df.first().whole == datetime(2024, 11, 4)
