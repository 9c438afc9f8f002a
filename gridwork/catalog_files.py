"""Queries that write the driver's tables as files and read them back, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.catalog import Tables, query
from gridwork.catalog_sheets import CELLS_SQL, _cells
from gridwork.sinks.delimited import comparison_table, write_csv
from gridwork.sinks.joined import write_workbook
from gridwork.sinks.xlsx import write_xlsx
from gridwork.sources import delimited, files, xlsx
from gridwork.sources.shared import fresh_folder


def _wide(cells: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Long cells (by, col_idx, value) as a row each, under names by place."""
    rows = cells.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("m"))  # the width of a sheet
    return rows.select(*[F.element_at("m", i).alias(n) for i, n in enumerate(names)])


@query("SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, CAST(c_nationkey AS VARCHAR) AS nation, CAST(c_acctbal AS VARCHAR) AS balance, concat('a,\"', c_mktsegment, '\"', chr(10), 'b') AS note FROM customer")
def csv_roundtrip(spark, sf):
    c = Tables(spark, sf).customer
    path = fresh_folder(spark, "csv")
    rows = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.concat(F.lit('a,"'), "c_mktsegment", F.lit('"\nb')).alias("note"))
    write_csv(rows, path, guard=False)
    back = delimited.read_texts(spark, path)
    return _wide(back.filter("kind = 'cell' AND row_idx > 0"), ["file", "row_idx"], ["key", "name", "nation", "balance", "note"])


_NUMBER = "CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END"


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS key, c_name AS name, {_NUMBER} AS balance, CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS even, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def workbook_roundtrip(spark, sf):
    c = Tables(spark, sf).customer
    path = fresh_folder(spark, "book")
    rows = c.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), (F.col("c_custkey") % 2 == 0).alias("even"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).alias("segment"))
    write_workbook(rows, f"{path}/book.xlsx", "Customers", formats={"balance": "#,##0.00"}, info=[("Table", "customer")])
    back = xlsx.read_workbooks(spark, path).filter("kind = 'cell' AND sheet <> 'Info' AND row_idx > 0 AND tag <> 'Empty'")
    return _wide(back, ["sheet", "row_idx"], ["key", "name", "balance", "even", "segment"])


@query(f"""WITH all_cells AS (SELECT 'csv' AS kind, 'Name' AS col_name, n_name AS value, 'Text' AS tag, CAST(NULL AS VARCHAR) AS fmt FROM nation UNION ALL SELECT 'csv', 'Region', CAST(CAST(n_regionkey AS DOUBLE) AS VARCHAR), 'FloatingPoint', NULL FROM nation
UNION ALL SELECT 'xlsx', 'Name', c_name, 'Text', NULL FROM customer UNION ALL SELECT 'xlsx', 'Balance', {_NUMBER}, CASE WHEN c_acctbal = floor(c_acctbal) THEN 'Integer' ELSE 'FloatingPoint' END, '#,##0.00' FROM customer)
SELECT kind, col_name, tag, fmt, count(*) AS cells, min(value) AS least, max(value) AS most FROM all_cells GROUP BY ALL""")
def load_folder(spark, sf):
    """A folder of text files and workbooks, loaded in one go."""
    t, path = Tables(spark, sf), fresh_folder(spark, "folder")
    write_csv(t.nation.select(F.col("n_name").alias("Name"), F.col("n_regionkey").alias("Region")), f"{path}/texts")
    write_xlsx(t.customer.select(F.col("c_name").alias("Name"), F.col("c_acctbal").alias("Balance")), f"{path}/books", formats={"Balance": "#,##0.00"}).collect()
    cells, _, _ = files.load(spark, path)
    kind = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    rows = cells.filter("row_idx > 0").groupBy(kind.alias("kind"), "col_name", "tag", F.when(kind == "xlsx", F.col("fmt")).alias("fmt"))
    return rows.agg(F.count("*").alias("cells"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("WITH f AS (SELECT 'csv' AS kind, count(*) AS rows FROM nation UNION ALL SELECT 'xlsx', count(*) FROM customer) SELECT kind, 'Success' AS status, CAST(rows AS BIGINT) AS rows FROM f UNION ALL SELECT 'txt', 'Failed', CAST(0 AS BIGINT) FROM region WHERE r_regionkey = 0")
def load_folder_status(spark, sf):
    """The status of each kind of file in a folder, and how many rows its files have."""
    t, path = Tables(spark, sf), fresh_folder(spark, "folder")
    write_csv(t.nation, f"{path}/texts")
    write_xlsx(t.customer, f"{path}/books").collect()
    t.region.filter("r_regionkey = 0").select("r_name").write.text(f"{path}/others")
    cells, _, status = files.load(spark, path)
    rows = cells.filter("row_idx > 0").select("file", "row_idx").distinct().groupBy("file").agg(F.count("*").alias("rows"))
    kind = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    return status.join(rows, "file", "left").groupBy(kind.alias("kind"), "status").agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


@query(f"WITH {CELLS_SQL} SELECT file AS source, 'Data' AS sheet, CAST(row_idx + 1 AS VARCHAR) AS row, value AS name FROM cells WHERE col_idx = 0 AND row_idx <= 3")
def comparison_export(spark, sf):
    """The first rows of every sheet side by side, written as a table and read back."""
    path = fresh_folder(spark, "comparison")
    rows = _cells(spark, sf).filter("row_idx <= 3").withColumn("ord", F.col("c_custkey"))
    write_csv(comparison_table(rows, ["Name"]), path, bom=True)
    back = delimited.read_texts(spark, path)
    return _wide(back.filter("kind = 'cell' AND row_idx > 0"), ["file", "row_idx"], ["source", "sheet", "row", "name"])
