"""Queries of the sheet operators over the driver's tables as sheets, each with its SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.catalog import Tables, query
from gridwork.functions import scalars as X
from gridwork.operators import compare, enrich, linking, merged, profile, search, sheet, template, validate
from gridwork.sources import records

# Customers as sheets: a file for each nation, row by key; balance with a number format that differs by row.
_FMT = "CASE WHEN c_custkey % 11 = 0 THEN '[$€-407] #,##0.00' WHEN c_custkey % 13 = 0 THEN 'mm/dd/yyyy' ELSE '#,##0.00' END"
_NOTE = "CASE WHEN c_custkey % 7 = 0 THEN 'yes' WHEN c_custkey % 7 = 1 THEN '  padded ' WHEN c_custkey % 7 = 2 THEN '2024-0' || CAST(c_custkey % 9 + 1 AS STRING) || '-1' || CAST(c_custkey % 10 AS STRING) WHEN c_custkey % 7 = 3 THEN CAST(c_custkey AS STRING) || '.5' WHEN c_custkey % 7 = 4 THEN '' ELSE c_mktsegment END"
_V = "VARCHAR"
_ROW = "row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)"
#: The same long cells in SQL: file, row_idx, col_idx, col_name, tag, value, fmt.
CELLS_SQL = f"""rows AS (SELECT *, {_ROW} AS row_idx, 'n' || CAST(c_nationkey AS VARCHAR) || '.xlsx' AS file, {_FMT} AS fmt, {_NOTE.replace('STRING', _V)} AS note FROM customer),
cells AS (SELECT file, c_custkey, row_idx, 0 AS col_idx, 'Name' AS col_name, 'Text' AS tag, c_name AS value, CAST(NULL AS VARCHAR) AS fmt FROM rows
UNION ALL SELECT file, c_custkey, row_idx, 1, 'Balance', 'FloatingPoint', CAST(c_acctbal AS VARCHAR), fmt FROM rows
UNION ALL SELECT file, c_custkey, row_idx, 2, 'Note', CASE WHEN note = '' THEN 'Empty' ELSE 'Text' END, note, NULL FROM rows)"""


def _cells(spark, sf) -> DataFrame:
    """file, sheet, sheet_idx, c_custkey, row_idx (from 1), col_idx, col_name, tag, value, fmt."""
    from pyspark.sql import Window

    c = Tables(spark, sf).customer
    rows = c.withColumn("row_idx", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long")).withColumn("file", F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit(".xlsx")))
    rows = rows.withColumn("fmt", F.expr(_FMT)).withColumn("note", F.expr(_NOTE))
    one = lambda i, name, tag, value, fmt: F.struct(F.lit(i).alias("col_idx"), F.lit(name).alias("col_name"), tag.alias("tag"), value.alias("value"), fmt.alias("fmt"))
    none = F.lit(None).cast("string")
    three = F.array(one(0, "Name", F.lit("Text"), F.col("c_name"), none), one(1, "Balance", F.lit("FloatingPoint"), F.col("c_acctbal").cast("string"), F.col("fmt")), one(2, "Note", F.when(F.col("note") == "", "Empty").otherwise("Text"), F.col("note"), none))
    return rows.select("file", F.lit("Data").alias("sheet"), F.lit(0).alias("sheet_idx"), "c_custkey", "row_idx", F.explode(three).alias("x")).select("file", "sheet", "sheet_idx", "c_custkey", "row_idx", "x.*")


def _typed(spark, sf) -> DataFrame:
    return _cells(spark, sf).withColumn("type", X.cell_type(F.col("tag"), F.col("value"), F.col("fmt")))


_TYPED = f"{CELLS_SQL}, typed AS (SELECT *, CASE WHEN tag = 'Empty' THEN 'Unknown' WHEN tag = 'FloatingPoint' AND fmt LIKE '%€%' THEN 'Currency' WHEN tag = 'FloatingPoint' AND fmt = 'mm/dd/yyyy' THEN 'Date' WHEN tag = 'FloatingPoint' THEN 'Number' ELSE 'Text' END AS type FROM cells)"
#: The profile of the first 100 rows of each column: dominant type (Number becomes Currency with any currency), counts and confidence.
_PROFILE = f"""{_TYPED}, smp AS (SELECT * FROM typed WHERE row_idx <= 100), cnt AS (SELECT file, col_idx, col_name, type, count(*) AS n, min(row_idx) AS f FROM smp GROUP BY ALL),
dom AS (SELECT file, col_idx, col_name, coalesce(arg_max(type, n * 1000000 - f) FILTER (type NOT IN ('Unknown', 'Error')), 'Unknown') AS dominant, sum(n) AS total FROM cnt GROUP BY ALL),
cur AS (SELECT file, col_idx, bool_or(fmt LIKE '%€%') AS euro FROM smp GROUP BY ALL),
pr AS (SELECT dom.file, dom.col_idx, dom.col_name, dominant, total, CASE WHEN dominant = 'Number' AND euro THEN 'Currency' ELSE dominant END AS type, CASE WHEN euro THEN 'EUR' END AS currency FROM dom JOIN cur USING (file, col_idx)),
prof AS (SELECT pr.*, coalesce(sum(n) FILTER (cnt.type = pr.type), 0) AS same, coalesce(sum(n) FILTER (cnt.type NOT IN ('Unknown', 'Error') AND cnt.type <> pr.type), 0) AS mismatches FROM pr JOIN cnt ON cnt.file = pr.file AND cnt.col_idx = pr.col_idx GROUP BY pr.file, pr.col_idx, pr.col_name, dominant, total, pr.type, currency),
an AS (SELECT *, CASE WHEN type = 'Unknown' THEN 0.0 ELSE greatest(0.0, least(1.0, same / CAST(total AS DOUBLE) - mismatches * 0.05)) END AS confidence FROM prof)"""


@query(f"WITH {_PROFILE} SELECT file, col_name, type, CAST(total AS BIGINT) AS total, CAST(mismatches AS BIGINT) AS mismatches, CAST(mismatches AS BIGINT) AS warnings, round(confidence, 6) AS confidence, currency FROM an")
def analyse_columns(spark, sf):
    out = profile.analyse(profile.first_sample(_typed(spark, sf)), ("file", "col_idx", "col_name"))
    return out.select("file", "col_name", "type", F.col("total").cast("long").alias("total"), F.col("mismatches").cast("long").alias("mismatches"), F.col("warnings").cast("long").alias("warnings"), F.round("confidence", 6).alias("confidence"), "currency")


@query(f"WITH {CELLS_SQL}, k AS (SELECT file, CASE WHEN fmt LIKE '%€%' THEN 'EUR' WHEN c_custkey % 3 = 0 THEN 'USD' END AS cur, row_idx FROM cells WHERE col_idx = 1), m AS (SELECT file, cur, min(row_idx) AS r FROM k WHERE cur IS NOT NULL GROUP BY ALL) SELECT file, string_agg(cur, ',' ORDER BY r) AS currencies, arg_min(cur, r) AS currency FROM m GROUP BY file")
def currencies_distinct(spark, sf):
    cells = _cells(spark, sf).filter("col_idx = 1").withColumn("fmt", F.when(F.col("fmt").contains("€"), F.col("fmt")).when(F.col("c_custkey") % 3 == 0, "$ 0.00"))
    return profile.currencies(cells, ("file",)).select("file", F.array_join("currencies", ",").alias("currencies"), "currency")


@query(f"WITH {_TYPED}, c AS (SELECT file, col_name, type, count(*) AS n, min(row_idx) AS f FROM typed GROUP BY ALL), d AS (SELECT file, col_name, arg_max(type, n * 1000000 - f) FILTER (type <> 'Unknown') AS dominant FROM c GROUP BY ALL) SELECT file, col_name, count(*) AS warnings FROM typed JOIN d USING (file, col_name) WHERE type <> 'Unknown' AND type <> dominant GROUP BY ALL")
def warning_count(spark, sf):
    by = ("file", "col_name")
    return profile.warning_count(profile.anomalies(_typed(spark, sf), by), by)


# Merged ranges of many sheets: a range for each supplier, a sheet for each nation.
_RANGES = "SELECT s_nationkey AS sheet, s_suppkey AS ord, s_suppkey % 50 AS r0, s_suppkey % 5 AS c0, s_suppkey % 50 + s_suppkey % 4 AS r1, s_suppkey % 5 + s_suppkey % 3 AS c1 FROM supplier"


@query(f"""WITH r AS ({_RANGES}), x AS (SELECT *, r1 - r0 + 1 AS h, c1 - c0 + 1 AS w FROM r), a AS (SELECT sheet, count(*) AS ranges, sum(h * w) AS cells, count(*) FILTER (h > w) AS vertical, count(*) FILTER (w > h) AS horizontal, sum(h * w) / CAST((max(r1) + 1) * (max(c1) + 1) AS DOUBLE) AS percent FROM x GROUP BY 1)
SELECT sheet, ranges, CAST(cells AS BIGINT) AS cells, vertical, horizontal, round(percent, 6) AS percent, CASE WHEN percent > 0.2 AND ranges >= 5 THEN 'Chaos' WHEN vertical > 0 THEN 'Complex' ELSE 'Simple' END AS level, CASE WHEN percent > 0.2 AND ranges >= 5 OR vertical > 2 * horizontal THEN 'KeepTopLeft' ELSE 'ExpandValue' END AS advice FROM a""")
def merge_complexity_sheets(spark, sf):
    Tables(spark, sf).supplier.createOrReplaceTempView("supplier")
    out = merged.complexity(spark.sql(_RANGES), ["sheet"])
    return out.select("sheet", "ranges", F.col("cells").cast("long").alias("cells"), "vertical", "horizontal", F.round("percent", 6).alias("percent"), "level", "advice")


@query("""WITH f(i, fmt, code, sure) AS (VALUES (0, '[$€-407] #,##0.00', 'EUR', true), (1, '[$€-40C] 0', 'EUR', true), (2, '[$€-410] 0', 'EUR', true), (3, '[$€-c0a] 0', 'EUR', true), (4, '[$€-413] 0.0', 'EUR', true), (5, '[$$-409]0', 'USD', true), (6, '[$$-1009]0', 'CAD', true), (7, '[$$-1409]0', 'CAD', true), (8, '[$$-C09]0', 'CAD', true), (9, '[$$-0C09]0', 'AUD', true), (10, '[$£-809]0', 'GBP', true), (11, '[$¥-411]0', 'JPY', true), (12, '[$₩-412]0', 'KRW', true), (13, '[$¥-404]0', 'CNY', true), (14, '[$€] 0', 'EUR', false), (15, '[$kr] $0', NULL, false), (16, '[$R$-416] 0', NULL, true), (17, '[$£-999] 0', 'GBP', true), (18, '[EUR] 0.00', 'EUR', true), (19, '0 ₹', 'INR', false), (20, '₽ 0', NULL, false), (21, '#,##0', NULL, false), (22, '$ 0 €', 'EUR', false), (23, 'General', NULL, false))
SELECT c_custkey, code, CASE WHEN code IS NULL THEN NULL WHEN sure THEN 'Unambiguous' ELSE 'Low' END AS confidence FROM customer JOIN f ON c_custkey % 24 = i""")
def currency_table(spark, sf):
    formats = ["[$€-407] #,##0.00", "[$€-40C] 0", "[$€-410] 0", "[$€-c0a] 0", "[$€-413] 0.0", "[$$-409]0", "[$$-1009]0", "[$$-1409]0", "[$$-C09]0", "[$$-0C09]0", "[$£-809]0", "[$¥-411]0", "[$₩-412]0", "[$¥-404]0", "[$€] 0", "[$kr] $0", "[$R$-416] 0", "[$£-999] 0", "[EUR] 0.00", "0 ₹", "₽ 0", "#,##0", "$ 0 €", "General"]
    fmt = F.get(F.array(*[F.lit(x) for x in formats]), (F.col("c_custkey") % len(formats)).cast("int"))
    return Tables(spark, sf).customer.select("c_custkey", X.currency_code(fmt).alias("code"), X.currency_confidence(fmt).alias("confidence"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN ',' WHEN c_custkey % 4 = 3 THEN ',' ELSE '.' END AS decimal, CASE WHEN c_custkey % 4 IN (0, 3) THEN '.' ELSE ',' END AS thousand,
CASE WHEN c_custkey % 4 = 1 THEN 0 ELSE 2 END AS places, CASE c_custkey % 4 WHEN 0 THEN 'Prefix' WHEN 1 THEN NULL WHEN 2 THEN 'Suffix' END AS place FROM customer""")
def format_separators(spark, sf):
    fmt = F.expr("CASE c_custkey % 4 WHEN 0 THEN '[$€-407] #,##0.00' WHEN 1 THEN '#,##0' WHEN 2 THEN '0.00 $' ELSE '#.##0,00' END")
    s = X.separators(fmt)
    return Tables(spark, sf).customer.select("c_custkey", s["decimal"].alias("decimal"), s["thousand"].alias("thousand"), X.decimal_places(fmt).alias("places"), X.sign_position(fmt).alias("place"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN strftime(DATE '1899-12-30' + CAST(o_orderkey % 40000 + 1 AS INTEGER), '%m/%d/%Y') WHEN 1 THEN printf('%.2f', o_totalprice) WHEN 2 THEN printf('%.0f', round(o_totalprice)) WHEN 3 THEN o_orderstatus
ELSE strftime(DATE '1899-12-30' + CAST(o_orderkey % 40000 + 1 AS INTEGER), '%-d-%b-%y') END AS shown FROM orders""")
def display_text(spark, sf):
    k = F.col("o_orderkey") % 5
    serial = (F.col("o_orderkey") % 40000 + 1).cast("string")
    tag = F.when(k.isin(0, 4), "Integer").when(k == 3, "Text").otherwise("FloatingPoint")
    value = F.when(k.isin(0, 4), serial).when(k == 3, F.col("o_orderstatus")).when(k == 2, F.round("o_totalprice").cast("string")).otherwise(F.col("o_totalprice").cast("string"))
    fmt = F.when(k == 0, "mm/dd/yyyy").when(k == 1, "#,##0.00").when(k == 2, "0").when(k == 4, "d-mmm-yy")
    return Tables(spark, sf).orders.select("o_orderkey", X.display(tag, value, fmt).alias("shown"))


_NORMAL = f"""{CELLS_SQL}, nrm AS (SELECT c_custkey, col_name, CASE WHEN tag = 'Empty' THEN 'Unknown' WHEN col_idx = 0 THEN 'Text' WHEN col_idx = 1 THEN CASE WHEN fmt LIKE '%€%' THEN 'Currency' WHEN fmt = 'mm/dd/yyyy' THEN 'Date' ELSE 'Number' END
WHEN c_custkey % 7 = 0 THEN 'Boolean' WHEN c_custkey % 7 = 2 THEN 'Date' WHEN c_custkey % 7 = 3 THEN 'Number' ELSE 'Text' END AS type,
CASE WHEN col_idx = 2 AND c_custkey % 7 = 1 THEN 'ExtraWhitespace' ELSE 'None' END AS issue,
CASE WHEN col_idx = 1 AND fmt <> 'mm/dd/yyyy' THEN CAST(value AS DOUBLE) WHEN col_idx = 2 AND c_custkey % 7 = 3 THEN CAST(value AS DOUBLE) END AS number,
CASE WHEN col_idx = 0 OR col_idx = 2 AND c_custkey % 7 IN (1, 5, 6) THEN trim(value) END AS text,
CASE WHEN col_idx = 2 AND c_custkey % 7 = 2 THEN CAST(value AS TIMESTAMP) WHEN col_idx = 1 AND fmt = 'mm/dd/yyyy' AND CAST(value AS DOUBLE) >= 0 THEN date_trunc('second', CAST(DATE '1899-12-30' AS TIMESTAMP) + to_microseconds(CAST(round(CASE WHEN CAST(value AS DOUBLE) >= 61 THEN CAST(value AS DOUBLE) - 1 ELSE CAST(value AS DOUBLE) END * 86400) AS BIGINT) * 1000000)) END AS date FROM cells)"""


@query(f"WITH {_NORMAL} SELECT c_custkey, col_name, type, issue, number, text, strftime(date, '%Y-%m-%d') AS date FROM nrm")
def normalize_cells(spark, sf):
    out = enrich.normalized(_cells(spark, sf), mode="days")
    return out.select("c_custkey", "col_name", "n.type", "n.issue", "n.number", "n.text", F.date_format("n.date", "yyyy-MM-dd").alias("date"))


@query(f"WITH {_NORMAL} SELECT n.c_custkey, n.col_name, CASE WHEN row_idx > 100 THEN value WHEN n.text IS NOT NULL THEN n.text WHEN number IS NOT NULL THEN NULL WHEN type = 'Boolean' THEN 'TRUE' WHEN date IS NOT NULL THEN strftime(date, '%Y-%m-%d') ELSE '' END AS cleaned FROM nrm n JOIN cells c ON n.c_custkey = c.c_custkey AND n.col_name = c.col_name")
def enrich_sheet(spark, sf):
    """The cells' cleaned texts; of numbers only that they are there."""
    cells, _, _ = enrich.enrich(_cells(spark, sf), mode="days")
    inside = F.col("row_idx") <= 100
    shown = F.when(inside & F.col("n.number").isNotNull(), None).when(inside & F.col("n.date").isNotNull(), F.date_format("n.date", "yyyy-MM-dd")).otherwise(F.col("cleaned"))
    return cells.select("c_custkey", "col_name", shown.alias("cleaned"))


_ANOM = f"{_PROFILE}, bad AS (SELECT smp.file, smp.col_idx, smp.col_name, row_idx, dominant AS expected, smp.type AS actual FROM smp JOIN dom USING (file, col_idx) WHERE smp.type <> 'Unknown' AND smp.type <> dominant)"


@query(f"WITH {_ANOM} SELECT file, 'Error' AS severity, chr(CAST(65 + col_idx AS INTEGER)) || CAST(row_idx + 1 AS VARCHAR) AS place, 'Data!' || chr(CAST(65 + col_idx AS INTEGER)) || CAST(row_idx + 1 AS VARCHAR) || ': TypeMismatch (expected ' || expected || ', found ' || actual || ')' AS message FROM bad")
def anomaly_errors(spark, sf):
    _, _, errors = enrich.enrich(_cells(spark, sf))
    return errors.select("file", "severity", "place", "message")


@query(f"WITH {_PROFILE}, st AS (SELECT DISTINCT file, CASE WHEN CAST(regexp_extract(file, '[0-9]+') AS INTEGER) % 5 = 0 THEN 'Failed' ELSE 'Success' END AS status FROM cells) SELECT row_number() OVER (ORDER BY file, col_idx) - 1 AS ord, file, col_name, type FROM an JOIN st USING (file) WHERE status <> 'Failed'")
def extract_columns(spark, sf):
    _, columns, _ = enrich.enrich(_cells(spark, sf))
    files = columns.select("file").distinct().withColumn("status", F.when(F.regexp_extract("file", "[0-9]+", 0).cast("int") % 5 == 0, "Failed").otherwise("Success"))
    return enrich.catalog(files, columns).select(F.col("ord").cast("long").alias("ord"), "file", "col_name", "type")


@query(f"""WITH {CELLS_SQL}, h AS (SELECT s_suppkey AS ord, 'n' || CAST(s_nationkey AS VARCHAR) || '.xlsx' AS file, CASE WHEN s_suppkey % 10 = 0 THEN -1 ELSE s_suppkey % 60 END AS row_idx FROM supplier), l AS (SELECT file, max(row_idx) AS last FROM cells GROUP BY 1)
SELECT ord, cells.row_idx, cells.col_name, cells.value FROM h JOIN cells USING (file, row_idx) WHERE h.row_idx >= 1""")
def create_comparison(spark, sf):
    rows, _ = enrich.comparison(_cells(spark, sf), _hits_of_suppliers(spark, sf), "c")
    return rows.select("ord", "row_idx", "col_name", "value")


def _hits_of_suppliers(spark, sf) -> DataFrame:
    s = Tables(spark, sf).supplier
    return s.select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit(".xlsx")).alias("file"), F.lit("Data").alias("sheet"), F.when(F.col("s_suppkey") % 10 == 0, -1).otherwise(F.col("s_suppkey") % 60).cast("long").alias("row_idx"), F.lit(0).alias("col_idx"))


@query(f"""WITH {CELLS_SQL}, h AS (SELECT s_suppkey AS ord, 'n' || CAST(s_nationkey AS VARCHAR) || '.xlsx' AS file, CASE WHEN s_suppkey % 10 = 0 THEN -1 ELSE s_suppkey % 60 END AS row_idx FROM supplier), l AS (SELECT file, max(row_idx) AS last FROM cells GROUP BY 1)
SELECT ord, CASE WHEN row_idx < 0 THEN 'not a cell' WHEN last IS NULL THEN 'no such sheet' WHEN row_idx < 1 THEN 'a header row' ELSE 'beyond the sheet' END AS reason FROM h LEFT JOIN l USING (file) WHERE row_idx < 1 OR last IS NULL OR row_idx > last""")
def comparison_errors(spark, sf):
    _, bad = enrich.comparison(_cells(spark, sf), _hits_of_suppliers(spark, sf), "c")
    return bad.select("ord", "reason")


# Validation ----------------------------------------------------------

_T = template.Template("customers", (
    template.Expected("Name", "Text", 0), template.Expected("balance", "Number", 2, currency="EUR"), template.Expected("Remark", "Text", required=True, alternatives=("Note",)), template.Expected("Phone", "Text", required=False)),
    (template.Rule("Name", "NotEmpty"), template.Rule("Remark", "Unique")), min_rows=60, max_rows=70, allow_extra=True, sheet="data")
_WANT = "want(name, key, wtype, pos, req, wcur) AS (VALUES ('Name', 'Name', 'Text', 0, true, NULL), ('balance', 'Balance', 'Number', 2, true, 'EUR'), ('Remark', 'Note', 'Text', -1, true, NULL), ('Phone', 'Phone', 'Text', -1, false, NULL))"
_VALID = f"""{_PROFILE}, {_WANT}, met AS (SELECT an.*, name, wtype, pos, wcur FROM an JOIN want ON an.col_name = key),
cntr AS (SELECT file, count(DISTINCT row_idx) AS n FROM cells GROUP BY 1),
dup AS (SELECT file, lower(value) AS k, count(*) AS n, arg_min(value, row_idx) AS v, min(row_idx) AS f FROM cells WHERE col_name = 'Note' AND value <> '' GROUP BY 1, 2 HAVING count(*) > 1),
issues AS (SELECT file, name AS col_name, 'WrongPosition' AS issue, 'Warning' AS severity, CAST(pos AS VARCHAR) AS expected, CAST(col_idx AS VARCHAR) AS actual, CAST(NULL AS BIGINT) AS row_idx FROM met WHERE pos >= 0 AND pos <> col_idx
UNION ALL SELECT file, name, 'TypeMismatch', 'Error', wtype, type, NULL FROM met WHERE wtype <> 'Unknown' AND wtype <> type
UNION ALL SELECT file, name, 'LowConfidence', 'Warning', '0.8', NULL, NULL FROM met WHERE confidence < 0.8
UNION ALL SELECT file, name, 'CurrencyMismatch', 'Warning', wcur, currency, NULL FROM met WHERE wcur IS NOT NULL AND (currency IS NULL OR currency <> wcur)
UNION ALL SELECT smp.file, name, 'RuleViolation', 'Error', met.type, smp.type, row_idx FROM smp JOIN met USING (file, col_idx) WHERE smp.type <> 'Unknown' AND smp.type <> met.type
UNION ALL SELECT file, 'Remark', 'DuplicateValue', 'Warning', CAST(n AS VARCHAR), v, NULL FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, f) AS r FROM dup) WHERE r <= 5
UNION ALL SELECT DISTINCT file, 'Phone', 'MissingColumn', 'Warning', 'Phone', NULL, CAST(NULL AS BIGINT) FROM cells
UNION ALL SELECT file, NULL, 'RowCountOutOfRange', 'Warning', '60-70', CAST(n AS VARCHAR), NULL FROM cntr WHERE n < 60 OR n > 70)"""


def _issues(spark, sf) -> DataFrame:
    out = validate.validate(_typed(spark, sf), _T)
    return out.withColumn("actual", F.when(F.col("issue") != "LowConfidence", F.col("actual")))


@query(f"WITH {_VALID} SELECT file, col_name, issue, severity, expected, actual, row_idx FROM issues")
def validate_sheets(spark, sf):
    return _issues(spark, sf).select("file", "col_name", "issue", "severity", "expected", "actual", "row_idx")


@query(f"WITH {_VALID} SELECT file, expected, actual FROM issues WHERE issue = 'RowCountOutOfRange'")
def row_count_limits(spark, sf):
    return _issues(spark, sf).filter("issue = 'RowCountOutOfRange'").select("file", "expected", "actual")


@query(f"WITH {_VALID} SELECT file, col_name, issue, expected, actual FROM issues WHERE issue IN ('WrongPosition', 'TypeMismatch')")
def validate_position_type(spark, sf):
    return _issues(spark, sf).filter("issue IN ('WrongPosition', 'TypeMismatch')").select("file", "col_name", "issue", "expected", "actual")


@query(f"WITH {_VALID} SELECT file, col_name, expected, actual FROM issues WHERE issue = 'DuplicateValue'")
def rules_unique(spark, sf):
    return _issues(spark, sf).filter("issue = 'DuplicateValue'").select("file", "col_name", "expected", "actual")


_REPORT = f"""{_VALID}, rep AS (SELECT file, count(*) FILTER (severity = 'Error') AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos, count(*) FILTER (issue = 'MissingColumn') AS missing,
count(DISTINCT CASE WHEN severity = 'Error' THEN col_name END) AS failed FROM issues GROUP BY 1), reps AS (SELECT *, 4 - failed AS passed, CASE WHEN errors > 0 THEN 'Invalid' WHEN warnings > 0 THEN 'ValidWithWarnings' ELSE 'Valid' END AS status FROM rep)"""


@query(f"WITH {_REPORT} SELECT file, errors, warnings, infos, missing, failed, CAST(passed AS BIGINT) AS passed, status FROM reps")
def validation_reports(spark, sf):
    cells = _typed(spark, sf)
    out = validate.reports(cells, validate.validate(cells, _T), _T)
    return out.select("file", "errors", "warnings", "infos", "missing", "failed", F.col("passed").cast("long").alias("passed"), "status")


@query(f"WITH {_REPORT} SELECT count(*) FILTER (status = 'Valid') AS valid, count(*) FILTER (status = 'ValidWithWarnings') AS with_warnings, count(*) FILTER (status IN ('Invalid', 'Failed')) AS with_errors, CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(warnings) AS BIGINT) AS warnings FROM reps")
def batch_totals(spark, sf):
    cells = _typed(spark, sf)
    out = validate.batch_totals(validate.reports(cells, validate.validate(cells, _T), _T))
    return out.select("valid", "with_warnings", "with_errors", F.col("errors").cast("long").alias("errors"), F.col("warnings").cast("long").alias("warnings"))


@query(f"WITH {_VALID} SELECT file, col_name, count(*) AS n, count(*) FILTER (severity = 'Error') AS errors FROM issues WHERE col_name IS NOT NULL GROUP BY 1, 2")
def issues_by_column(spark, sf):
    return validate.issues_by_column(_issues(spark, sf))


@query(f"WITH {_VALID} SELECT file, issue, severity, count(*) AS n, CASE severity WHEN 'Critical' THEN 1 WHEN 'Error' THEN 2 WHEN 'Warning' THEN 3 ELSE 4 END AS gravity FROM issues GROUP BY ALL")
def issues_by_gravity(spark, sf):
    few = _issues(spark, sf).groupBy("file", "issue", "severity").agg(F.count("*").alias("n"))
    return sheet.by_gravity(few, "file").withColumn("gravity", sheet.gravity(F.col("severity")).cast("int"))


@query("SELECT 'n' || CAST(n AS VARCHAR) || '.xlsx' AS file, n % 3 <> 0 AS ok FROM (SELECT DISTINCT c_nationkey AS n FROM customer)")
def quick_check(spark, sf):
    """Every third file lacks the balance."""
    columns = _cells(spark, sf).select("file", "col_idx", "col_name").distinct().filter("NOT (col_name = 'Balance' AND CAST(regexp_extract(file, '[0-9]+', 0) AS INT) % 3 = 0)")
    return validate.quick_check(columns, replace(_T, columns=(template.Expected("Name", position=0), template.Expected("Balance"))))


@query(f"WITH {_PROFILE} SELECT col_name AS name, col_idx AS position, type, CASE WHEN type = 'Currency' THEN currency END AS currency FROM an WHERE file = 'n1.xlsx'")
def template_from_file(spark, sf):
    made = validate.template_from(validate.analysed(_typed(spark, sf)), "made", "n1.xlsx", "Data")
    back = validate.with_semantics(template.Template.from_json(made.to_json()), {"note": "Remark"})
    if [c.semantic for c in back.columns] != [None, None, "Remark"] or not back.rules or back.validate():
        raise ValueError("the template does not come back from JSON")
    return spark.createDataFrame([(c.name, c.position, c.type, c.currency) for c in back.columns], "name string, position int, type string, currency string")


# Sheets, links, selection --------------------------------------------


@query(f"WITH {CELLS_SQL} SELECT file, count(DISTINCT row_idx) AS rows, count(DISTINCT row_idx) FILTER (row_idx >= 3) AS data_rows, count(DISTINCT col_idx) AS columns, count(*) FILTER (value <> '') AS cells, count(fmt) AS formatted FROM cells GROUP BY 1")
def sheet_counters(spark, sf):
    return sheet.counters(_cells(spark, sf), 3).drop("sheet")


@query("WITH h AS (SELECT c_nationkey AS file, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INTEGER) AS col_idx, CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_mktsegment END AS name FROM customer), b AS (SELECT file, col_idx, CASE WHEN trim(name) = '' THEN 'Column_' || CAST(col_idx AS VARCHAR) ELSE name END AS base FROM h), n AS (SELECT *, row_number() OVER (PARTITION BY file, base ORDER BY col_idx) AS k FROM b) SELECT file, col_idx, CASE WHEN k = 1 THEN base ELSE base || '_' || CAST(k AS VARCHAR) END AS col_name FROM n")
def unique_headers(spark, sf):
    from pyspark.sql import Window

    c = Tables(spark, sf).customer
    rows = c.select(F.col("c_nationkey").alias("file"), (F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1).alias("col_idx"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("name"))
    return sheet.unique_names(rows, ["file"]).select("file", "col_idx", "col_name")


@query(f"WITH {CELLS_SQL} SELECT col_name, value, tag FROM cells WHERE file = 'n3.xlsx' AND row_idx = 5")
def point_access(spark, sf):
    one = _cells(spark, sf).filter("file = 'n3.xlsx'")
    row = sheet.row_at(one, 5).select("col_name", "value", "tag")
    cell = sheet.cell_at(one, 5, 0).select(F.lit("Name").alias("col_name"), "value", "tag")
    outside = sheet.cell_at(one, -1, 99).filter("value <> '' OR tag <> 'Empty'").select(F.lit("?").alias("col_name"), "value", "tag")
    return cell.unionByName(row.filter("col_name <> 'Name'")).unionByName(outside)


@query(f"WITH {CELLS_SQL} SELECT row_idx, col_idx, CASE WHEN row_idx % 4 = 0 AND col_idx = 2 THEN 'set' ELSE value END AS value FROM cells WHERE file = 'n3.xlsx'")
def cell_update(spark, sf):
    cells = _cells(spark, sf).filter("file = 'n3.xlsx'")
    changes = cells.filter("row_idx % 4 = 0 AND col_idx = 2").select("row_idx", "col_idx", F.lit("set").alias("value"))
    return sheet.updated(cells, changes).select("row_idx", "col_idx", "value")


@query("SELECT c_name AS Customer, c_acctbal AS Balance FROM customer")
def project_rename(spark, sf):
    return sheet.projected(Tables(spark, sf).customer, ["C_NAME", "c_acctbal"], {"c_name": "Customer", "C_ACCTBAL": "Balance"})


_ERR = "err AS (SELECT 'n' || CAST(c_nationkey AS VARCHAR) AS file, CASE WHEN c_custkey % 50 = 0 THEN 'Critical' WHEN c_custkey % 7 = 0 THEN 'Error' WHEN c_custkey % 3 = 0 THEN 'Warning' ELSE 'Info' END AS severity FROM customer WHERE c_nationkey % 4 <> 0 OR c_custkey % 7 <> 0 AND c_custkey % 50 <> 0)"


def _errors(spark, sf) -> DataFrame:
    severity = F.expr("CASE WHEN c_custkey % 50 = 0 THEN 'Critical' WHEN c_custkey % 7 = 0 THEN 'Error' WHEN c_custkey % 3 = 0 THEN 'Warning' ELSE 'Info' END")
    return Tables(spark, sf).customer.filter("c_nationkey % 4 <> 0 OR c_custkey % 7 <> 0 AND c_custkey % 50 <> 0").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("file"), severity.alias("severity"))


@query(f"WITH {_ERR} SELECT file, bool_or(severity IN ('Error', 'Critical')) AS has_errors, bool_or(severity = 'Warning') AS has_warnings, bool_or(severity = 'Critical') AS has_critical, CAST(count(*) FILTER (severity = 'Error') AS BIGINT) AS errors FROM err GROUP BY 1")
def error_filters(spark, sf):
    errors = _errors(spark, sf)
    counts = sheet.errors_by_level(errors, "Error").groupBy("file").agg(F.count("*").alias("errors"))
    return sheet.error_flags(errors).join(counts, "file", "left").na.fill({"errors": 0})


@query(f"WITH {_ERR}, f AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS file, n_regionkey AS sheets FROM nation), e AS (SELECT file, bool_or(severity IN ('Error', 'Critical')) AS bad FROM err GROUP BY 1) SELECT file, CASE WHEN NOT coalesce(bad, false) THEN 'Success' WHEN sheets > 0 THEN 'PartialSuccess' ELSE 'Failed' END AS status FROM f LEFT JOIN e USING (file)")
def load_status(spark, sf):
    files = Tables(spark, sf).nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"), F.col("n_regionkey").alias("sheets"))
    return sheet.load_status(files, _errors(spark, sf)).select("file", "status")


@query("SELECT CAST(row_number() OVER (ORDER BY upper(n_name), n_name) - 1 AS INTEGER) AS place, n_name AS semantic_name FROM nation")
def links_sorted(spark, sf):
    return linking.links_by_name(Tables(spark, sf).nation.select(F.col("n_name").alias("semantic_name"))).select("place", "semantic_name")


_MEM = "mem AS (SELECT r_name AS link, n_name AS col_name, CASE WHEN n_nationkey % 3 = 0 THEN 'Text' ELSE 'Number' END AS type, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey)"


def _members(spark, sf) -> DataFrame:
    t = Tables(spark, sf)
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("link"), F.col("n_name").alias("col_name"), F.when(F.col("n_nationkey") % 3 == 0, "Text").otherwise("Number").alias("type"), F.col("n_nationkey").alias("ord"))


@query(f"WITH {_MEM}, e AS (SELECT CASE WHEN link = 'ASIA' AND col_name = 'JAPAN' THEN 'JAPAN' WHEN link IN ('ASIA', 'AFRICA') THEN 'East' WHEN link = 'EUROPE' THEN 'Old' ELSE link END AS link, col_name, type, ord FROM mem UNION ALL SELECT 'Old', c_mktsegment, 'Number', 100 FROM (SELECT min(c_mktsegment) AS c_mktsegment FROM customer)), t AS (SELECT link, type, count(*) AS n, min(ord) AS f FROM e GROUP BY ALL) SELECT link, arg_max(type, n * 1000 - f) AS dominant, CAST(sum(n) AS BIGINT) AS columns FROM t GROUP BY 1")
def link_editing(spark, sf):
    out = linking.remove_member(_members(spark, sf), "asia", "JAPAN")
    out = linking.rename_link(linking.merge_groups(out, "East", ["asia", "AFRICA"]), "Europe", "Old")
    new = Tables(spark, sf).customer.agg(F.min("c_mktsegment").alias("col_name")).select("col_name", F.lit("Number").alias("type"), F.lit(100).alias("ord"))
    return linking.group_types(linking.add_member(linking.add_member(out, new, "Old"), new, "Old"))


@query("SELECT c_mktsegment AS header, CASE c_mktsegment WHEN 'BUILDING' THEN 'Works' ELSE c_mktsegment END AS by_map, lower(c_mktsegment) AS by_function, c_mktsegment AS by_none FROM customer")
def header_resolvers(spark, sf):
    h = Tables(spark, sf).customer.select(F.col("c_mktsegment").alias("header"))
    return linking.resolve_headers(linking.resolve_headers(linking.resolve_headers(h, {"BUILDING": "Works", "building": "never"}).withColumnRenamed("semantic_name", "by_map"), F.lower).withColumnRenamed("semantic_name", "by_function")).withColumnRenamed("semantic_name", "by_none")


@query("SELECT 'f' || CAST(c_nationkey AS VARCHAR) AS file_name, c_mktsegment AS col_name, 'Works' AS semantic_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def semantic_names_file(spark, sf):
    links = spark.createDataFrame([("Works", 0, ["building", " Machinery"]), ("household", 1, ["HOUSEHOLD"])], "semantic_name string, ord int, members array<string>")
    columns = Tables(spark, sf).customer.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file_name"), F.col("c_mktsegment").alias("col_name"))
    return linking.semantic_names(columns, links)


@query("SELECT 'f' || CAST(c_nationkey AS VARCHAR) AS file_name, c_mktsegment AS col_name, c_mktsegment IN ('BUILDING') AND c_nationkey = 3 AS highlighted FROM customer")
def template_highlight(spark, sf):
    columns = Tables(spark, sf).customer.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file_name"), F.col("c_mktsegment").alias("col_name"))
    return linking.highlighted(columns, ["Building"], "F3")


@query("SELECT c_mktsegment AS wanted, CASE c_mktsegment WHEN 'BUILDING' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE -1 END AS col_idx FROM customer")
def header_lookup(spark, sf):
    headers = spark.createDataFrame([(" building", 0), ("Machinery ", 1), ("BUILDING", 2), ("machinery", 4)], "header string, col_idx int")
    return sheet.find_header(headers, Tables(spark, sf).customer.select(F.col("c_mktsegment").alias("wanted")))


@query("SELECT lower(c_mktsegment) AS value, 'f' || CAST(c_nationkey AS VARCHAR) AS file_name, count(*) AS hits FROM customer WHERE c_nationkey <> 3 GROUP BY ALL")
def visible_files(spark, sf):
    return search.group_tree(sheet.visible(_segment_hits(spark, sf), ["f3"])).select("value", "file_name", "hits")


def _segment_hits(spark, sf) -> DataFrame:
    return Tables(spark, sf).customer.select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("file_name"), F.lit("Data").alias("sheet_name"), F.col("c_mktsegment").alias("value"))


@query("WITH g AS (SELECT lower(c_mktsegment) AS value, count(DISTINCT c_nationkey) AS files FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_nationkey <> 3 GROUP BY 1) SELECT value, files = 25 AS found_in_all, CAST(row_number() OVER (ORDER BY files = 25, value COLLATE de, value) - 1 AS INTEGER) AS place FROM g")
def groups_sorted(spark, sf):
    """Values that some file lacks first, then by value."""
    hits = _segment_hits(spark, sf).filter("value <> 'BUILDING' OR file_name <> 'f3'")
    return search.groups_in_order(search.group_by_value(hits, 25)).select("value", "found_in_all", "place")


@query("SELECT min(n_name) AS name FROM nation WHERE contains(lower(n_name), 'tion_1') GROUP BY lower(n_name) ORDER BY min(n_nationkey) LIMIT 10")
def suggestion_narrowing(spark, sf):
    return sheet.narrowed(Tables(spark, sf).nation.select(F.col("n_name").alias("name"), "n_nationkey"), "Tion_1", "n_nationkey")


@query("SELECT n_nationkey, 'CELL' AS code, CASE WHEN n_nationkey % 4 = 0 THEN 'Critical' ELSE 'Error' END AS severity, n_name AS message, n_nationkey % 4 <> 0 AS recoverable, CAST(n_nationkey AS BIGINT) AS row, CAST(n_nationkey * 30 AS BIGINT) AS col FROM nation")
def error_json_roundtrip(spark, sf):
    n = Tables(spark, sf).nation
    text = records.error_json(F.lit("Cell"), F.when(F.col("n_nationkey") % 4 == 0, "Critical").otherwise("Error"), F.col("n_name"), F.lit("Cell"), F.col("n_nationkey").cast("long"), F.col("n_nationkey") * 30)
    e = records.error_of(text)
    return n.select("n_nationkey", e["code"].alias("code"), e["severity"].alias("severity"), e["message"].alias("message"), e["recoverable"].alias("recoverable"), e["row"].cast("long").alias("row"), e["column"].cast("long").alias("col"))


@query("SELECT 'c' || CAST(o_custkey AS VARCHAR) AS file, max(o_orderdate) AS at FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY 1")
def latest_logs(spark, sf):
    logs = Tables(spark, sf).orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.col("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"))
    kept = records.kept_logs(logs, 365, F.lit("1995-01-01").cast("timestamp"))
    return records.latest_logs(kept).select("file", "at")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d_%H%M') || '_' || lower(o_orderstatus) || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '_a_b' END || '.csv' AS name FROM orders")
def export_names(spark, sf):
    words = F.array(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, " ? ").otherwise(" A/B "), F.lit("third"))
    return Tables(spark, sf).orders.select("o_orderkey", X.export_filename(F.col("o_orderdate"), words, "csv").alias("name"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(c_name, '[\",]') THEN '\"' || replace(c_name, '\"', '\"\"') || '\"' ELSE c_name END AS escaped, CASE WHEN c_custkey < 1024 THEN CAST(c_custkey AS VARCHAR) || ' B' ELSE CAST(c_custkey // 1024 AS VARCHAR) || ' KB' END AS size FROM customer")
def escape_and_size(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", X.csv_escape(F.col("c_name")).alias("escaped"), X.file_size(F.col("c_custkey")).alias("size"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'There is no file ' || c_name WHEN 1 THEN 'The file may not be read; check its permissions' ELSE 'Something unforeseen went wrong' END AS message, c_custkey % 3 <> 2 AS recoverable FROM customer")
def error_messages(spark, sf):
    kind = F.expr("CASE c_custkey % 3 WHEN 0 THEN 'FileNotFoundError' WHEN 1 THEN 'PermissionError' ELSE 'RuntimeError' END")
    m = X.error_message(kind, F.concat(F.lit("/data/in/"), F.col("c_name")))
    return Tables(spark, sf).customer.select("c_custkey", m["message"].alias("message"), m["recoverable"].alias("recoverable"))


@query("SELECT string_agg(DISTINCT 'f' || CAST(c_nationkey AS VARCHAR), ',' ORDER BY 'f' || CAST(c_nationkey AS VARCHAR)) AS files, string_agg(DISTINCT lower(c_mktsegment), ',' ORDER BY lower(c_mktsegment)) AS terms FROM customer")
def distinct_lists(spark, sf):
    return search.distinct_lists(_segment_hits(spark, sf))


@query("WITH g AS (SELECT o_custkey, o_orderkey FROM orders), n AS (SELECT o_custkey FROM g WHERE o_orderkey % 10 <> 0 GROUP BY 1 HAVING count(*) >= 2) SELECT o_custkey AS comparison_id, o_orderkey FROM g JOIN n USING (o_custkey) WHERE o_orderkey % 10 <> 0")
def comparisons_without_file(spark, sf):
    rows = Tables(spark, sf).orders.select(F.col("o_custkey").alias("comparison_id"), "o_orderkey", F.when(F.col("o_orderkey") % 10 == 0, "gone").otherwise("kept").alias("file_name"))
    return compare.comparisons_without(rows, "gone").select("comparison_id", "o_orderkey")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def missing_rows(spark, sf):
    t = Tables(spark, sf)
    hits = t.supplier.select(F.col("s_suppkey").alias("row_key"))
    return compare.missing_rows(t.customer.filter("c_custkey % 2 = 0"), hits, "c_custkey").select(F.col("row_key").alias("s_suppkey"))


@query("""SELECT 'o_orderstatus' AS col_name, 'Unique' AS rule, count(o_orderstatus) - count(DISTINCT lower(o_orderstatus)) AS violations FROM orders UNION ALL SELECT 'o_orderkey', 'Unique', count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'o_orderpriority', 'MinLength', count(*) FILTER (length(o_orderpriority) < 6) FROM orders UNION ALL SELECT 'o_orderstatus', 'Numeric', count(*) FROM orders UNION ALL SELECT 'o_custkey', 'TypeMatch', 0 FROM orders
UNION ALL SELECT 'o_orderstatus', 'TypeMatch', count(*) FROM orders UNION ALL SELECT 'o_orderpriority', 'NotEmpty', count(*) FILTER (o_orderpriority IS NULL OR trim(o_orderpriority) = '') FROM orders UNION ALL SELECT 'price', 'Currency', count(*) FILTER (o_orderkey % 3 = 0) FROM orders""".replace("SELECT 'o_custkey', 'TypeMatch', 0 FROM orders", "SELECT 'o_custkey', 'TypeMatch', count(*) FILTER (o_custkey IS NULL) FROM orders"))
def rules_more(spark, sf):
    price = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "$ ").when(F.col("o_orderkey") % 3 == 1, "€ ").otherwise("EUR "), F.col("o_totalprice").cast("string"))
    wanted = [("o_orderstatus", "Unique", ""), ("o_orderkey", "Unique", ""), ("o_orderpriority", "MinLength", "6"), ("o_orderstatus", "Numeric", ""), ("o_custkey", "TypeMatch", "Number"), ("o_orderstatus", "TypeMatch", "Number"), ("o_orderpriority", "NotEmpty", ""), ("price", "Currency", "EUR")]
    return template.rule_violations(Tables(spark, sf).orders.withColumn("price", price), [template.Rule(*w) for w in wanted])


@query("SELECT c_custkey, c_custkey AS at, c_custkey + 1 AS number FROM customer")
def row_indexes(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", X.sheet_row(F.col("c_custkey") + 1).alias("at"), X.row_number_of(F.col("c_custkey")).alias("number"))


@query("""WITH v AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'Match' WHEN 1 THEN 'Different' WHEN 2 THEN 'Missing' ELSE 'New' END AS verdict, (o_orderkey % 101) / 100.0 AS x FROM orders), h AS (SELECT *, (90 - x * 40) / 100 AS l, (70 + x * 20) / 100 AS s FROM v), c AS (SELECT *, (1 - abs(2 * l - 1)) * s AS chroma FROM h)
SELECT o_orderkey, CASE verdict WHEN 'Match' THEN '#FFFFFF' WHEN 'New' THEN '#F8FDF9' WHEN 'Missing' THEN '#FEF8F8' ELSE '#' || upper(printf('%02x', CAST(floor((l + chroma / 2) * 255 + 1e-9) AS INTEGER)) || printf('%02x', CAST(floor((l - chroma / 2) * 255 + 1e-9) AS INTEGER)) || printf('%02x', CAST(floor((l - chroma / 6) * 255 + 1e-9) AS INTEGER))) END AS colour FROM c""")
def verdict_colours(spark, sf):
    verdict = F.expr("CASE o_orderkey % 4 WHEN 0 THEN 'Match' WHEN 1 THEN 'Different' WHEN 2 THEN 'Missing' ELSE 'New' END")
    return Tables(spark, sf).orders.select("o_orderkey", X.verdict_colour(verdict, F.col("o_orderkey") % 101 / 100).alias("colour"))


@query("""WITH c AS (SELECT 'f' || r_name AS file_name, 'Build ' || CAST(n_regionkey AS VARCHAR) AS sheet_name, n_name || ' is built in ' || r_name AS value, n_nationkey AS ord FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT sheet_name AS t, 1 AS k, min(ord) AS o FROM c GROUP BY 1
UNION ALL SELECT CASE WHEN strpos(value, 'built') - 10 > 1 THEN '...' ELSE '' END || substr(value, CAST(greatest(strpos(value, 'built') - 10, 1) AS INTEGER), CAST(least(strpos(value, 'built') + 15, length(value) + 1) - greatest(strpos(value, 'built') - 10, 1) AS INTEGER)) || CASE WHEN strpos(value, 'built') + 15 <= length(value) THEN '...' ELSE '' END, 2, min(ord) FROM c GROUP BY 1),
q AS (SELECT t, k, o FROM s WHERE k = 2) SELECT t AS suggestion FROM q ORDER BY o LIMIT 10""")
def suggestions_sheets(spark, sf):
    t = Tables(spark, sf)
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    cells = rows.select(F.concat(F.lit("f"), "r_name").alias("file_name"), F.concat(F.lit("Build "), F.col("n_regionkey").cast("string")).alias("sheet_name"), F.concat("n_name", F.lit(" is built in "), "r_name").alias("value"), F.col("n_nationkey").alias("ord"))
    return search.suggestions_of_sheets(cells, "built")


@query("SELECT n_name AS col_name, CASE WHEN n_nationkey % 4 = 0 THEN 'Group' ELSE n_name END AS shown FROM nation WHERE n_nationkey % 3 <> 0")
def included_columns(spark, sf):
    n = Tables(spark, sf).nation.select(F.col("n_name").alias("col_name"), F.when(F.col("n_nationkey") % 4 == 0, "Group").alias("semantic_name"), (F.col("n_nationkey") % 3 == 0).alias("included"))
    return linking.included_names(linking.invert_selection(n))


@query(f"WITH {CELLS_SQL} SELECT file, count(*) AS hits FROM cells WHERE contains(lower(value), 'u') AND file <> 'n3.xlsx' GROUP BY file")
def hits_without_file(spark, sf):
    """Hits that are left when a file is closed."""
    hits = _cells(spark, sf).filter(F.lower("value").contains("u")).withColumnRenamed("file", "file_name")
    return search.without_file(hits, "n3.xlsx").groupBy(F.col("file_name").alias("file")).agg(F.count("*").alias("hits"))


@query(f"WITH {CELLS_SQL}, h AS (SELECT DISTINCT file, col_idx, CASE WHEN file = 'n5.xlsx' AND col_idx = 1 THEN 'Saldo' ELSE col_name END AS col_name FROM cells) SELECT file, count(*) FILTER (lower(col_name) = 'name' AND col_idx = 0) > 0 AND count(*) FILTER (lower(col_name) = 'balance') > 0 AS ok FROM h GROUP BY file")
def template_quick_check(spark, sf):
    """Whether each sheet has the columns that a template asks for; one has its balance under another name."""
    heads = _cells(spark, sf).select("file", "col_idx", F.when((F.col("file") == "n5.xlsx") & (F.col("col_idx") == 1), "Saldo").otherwise(F.col("col_name")).alias("col_name")).distinct()
    wanted = template.Template("t", (template.Expected("name", "Text", 0), template.Expected("Balance", "Number"), template.Expected("Other", "Text", required=False)))
    return validate.quick_check(heads, wanted)


@query(f"WITH {CELLS_SQL} SELECT file, row_idx, col_idx, concat('R', CAST(row_idx + 1 AS VARCHAR), 'C', CAST(col_idx + 1 AS VARCHAR)) AS coordinates FROM cells WHERE contains(lower(value), 'furn')")
def hit_coordinates(spark, sf):
    hits = _cells(spark, sf).filter(F.lower("value").contains("furn")).withColumnRenamed("row_idx", "row_key")
    return search.coordinates(hits).select("file", F.col("row_key").alias("row_idx"), "col_idx", "coordinates")


_ACCENTS = "CASE n_nationkey % 4 WHEN 0 THEN 'é' WHEN 1 THEN '_' WHEN 2 THEN 'E' ELSE 'ä_' END || lower(n_name)"


@query(f"SELECT {_ACCENTS} AS value, n_nationkey % 3 = 0 AS found_in_all, CAST(row_number() OVER (ORDER BY n_nationkey % 3 = 0, {_ACCENTS} COLLATE de, {_ACCENTS}) - 1 AS INTEGER) AS place FROM nation")
def groups_by_culture(spark, sf):
    """Values with accents, capitals and underscores in a dictionary's order."""
    groups = Tables(spark, sf).nation.select(F.expr(_ACCENTS).alias("value"), (F.col("n_nationkey") % 3 == 0).alias("found_in_all"))
    return search.groups_in_order(groups).select("value", "found_in_all", "place")


_UNDERSCORES = "CASE WHEN n_nationkey % 2 = 0 THEN lower(replace(n_name, '_', 'b')) ELSE n_name END"


@query(f"SELECT CAST(row_number() OVER (ORDER BY upper({_UNDERSCORES}), {_UNDERSCORES}) - 1 AS INTEGER) AS place, {_UNDERSCORES} AS semantic_name FROM nation")
def links_in_any_case(spark, sf):
    """Names in both cases, underscores after all letters."""
    return linking.links_by_name(Tables(spark, sf).nation.select(F.expr(_UNDERSCORES).alias("semantic_name"))).select("place", "semantic_name")
