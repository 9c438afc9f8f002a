"""CSV and XLSX files."""

import zipfile

from gridwork import catalog
from gridwork.sinks.delimited import write_csv
from gridwork.sources.delimited import detect_delimiter, read_csv
from gridwork.sources.xlsx import read_xlsx


def test_csv_round_trip(spark, sf, tmp_path):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    write_csv(nation, f"{tmp_path}/n", delimiter=";")
    back = read_csv(spark, f"{tmp_path}/n")
    assert detect_delimiter(spark, f"{tmp_path}/n") == ";"
    assert sorted(map(tuple, back.collect())) == sorted(tuple(str(v) for v in r) for r in nation.collect())


def test_csv_guard_and_quotes(spark, tmp_path):
    write_csv(spark.createDataFrame([("=1+1", 'a "b", c', True)], "x string, y string, z boolean"), f"{tmp_path}/g")
    assert [tuple(r) for r in read_csv(spark, f"{tmp_path}/g", ",").collect()] == [("'=1+1", 'a "b", c', "TRUE")]


def test_guard_of_whole_documents(spark, tmp_path):
    """Every row in full, whatever it begins with."""
    tail = "x" * 100
    texts = [f"={tail}", f"+{tail}", f"-{tail}", f"@{tail}", f"\t{tail}", f"\r{tail}", "-", "+5", f"-1{tail}", f"7{tail}", f"é{tail}", f" ={tail}", f"A{tail}", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r.guarded for r in catalog.queries()["csv_guard_documents"](spark, str(tmp_path)).collect()}
    assert rows == {i: f"'{t}" if i < 7 else t for i, t in enumerate(texts)}


def test_xlsx(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>9</v></c></row><row r="3"><c r="A3"><v>5</v></c><c r="AA3" t="b"><v>1</v></c><c r="B3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_text("no zip")
    rows = sorted(map(tuple, read_xlsx(spark, str(tmp_path)).collect()), key=repr)
    assert rows == sorted([
        ("a.xlsx", "Data", 0, 0, "Name", "Text", None), ("a.xlsx", "Data", 0, 1, "[Invalid SST ref: 9]", "Text", None), ("a.xlsx", "Data", 2, 0, "5", "Integer", None),
        ("a.xlsx", "Data", 2, 26, "TRUE", "Boolean", None), ("a.xlsx", "Data", 2, 1, "#ERROR: #N/A", "Text", None), ("b.xlsx", None, None, None, None, None, "not a workbook")], key=repr)
