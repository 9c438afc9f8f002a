"""The library's queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.functions import scalars as X
from gridwork.operators import compare, linking, merged, profile, search, template
from gridwork.operators.search import Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query, and the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def _long(*columns: str):
    return [F.col(c).cast("long").alias(c) for c in columns]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    hits = search.search_files({n: getattr(t, n) for n in ("region", "nation", "customer", "supplier", "part")}, "building")
    return search.group_by_value(hits, 5)


# Search ---------------------------------------------------------------

HIT = ("row_key", "col_name", "value")


def _hits(df: DataFrame, q: str, options: Options = Options(), **kw) -> DataFrame:
    return search.search_sheet(df, q, options, **kw).select(F.col("row_key").cast("long").alias("row_key"), "col_name", "value")


def _hit_sql(table: str, key: str, columns: list[str], where: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({key} AS BIGINT) AS row_key, '{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM {table} WHERE {where.format(v=f'CAST({c} AS VARCHAR)')}" for c in columns)


@query(_hit_sql("customer", "c_custkey", ["c_name", "c_mktsegment"], "contains(lower({v}), 'building')"))
def search_contains_ci(spark, sf):
    return _hits(Tables(spark, sf).customer, "Building", columns=["c_name", "c_mktsegment"])


@query(_hit_sql("part", "p_partkey", ["p_name"], "contains({v}, 'gear')"))
def search_contains_cs(spark, sf):
    return _hits(Tables(spark, sf).part, "gear", Options(case_sensitive=True), columns=["p_name"])


@query(_hit_sql("orders", "o_orderkey", ["o_orderpriority", "o_orderstatus"], "lower({v}) = '1-urgent'"))
def search_exact_ci(spark, sf):
    return _hits(Tables(spark, sf).orders, "1-Urgent", Options(exact=True), columns=["o_orderpriority", "o_orderstatus"])


@query(_hit_sql("orders", "o_orderkey", ["o_orderpriority"], "{v} = '1-URGENT'"))
def search_exact_cs(spark, sf):
    return _hits(Tables(spark, sf).orders, "1-URGENT", Options(case_sensitive=True, exact=True), columns=["o_orderpriority"])


@query(_hit_sql("part", "p_partkey", ["p_brand", "p_type"], "regexp_matches({v}, '^Brand#[1-3]$')"))
def search_regex(spark, sf):
    return _hits(Tables(spark, sf).part, "^Brand#[1-3]$", Options(case_sensitive=True, regex=True), columns=["p_brand", "p_type"])


@query(_hit_sql("part", "p_partkey", ["p_brand", "p_type"], "regexp_matches({v}, '^brand#[1-3]$', 'i')"))
def search_regex_ci(spark, sf):
    return _hits(Tables(spark, sf).part, "^brand#[1-3]$", Options(regex=True), columns=["p_brand", "p_type"])


@query(_hit_sql("documents", "doc_id", ["text"], "contains({v}, '***')"))
def search_bad_regex_fallback(spark, sf):
    """``***`` is no regular expression, so it is searched as it stands."""
    return _hits(Tables(spark, sf).documents, "***", Options(regex=True), columns=["text"])


@query(_hit_sql("supplier", "s_suppkey", ["s_name"], "contains(lower({v}), '1')"))
def search_included_columns(spark, sf):
    return _hits(Tables(spark, sf).supplier, "1", columns=["S_NAME"])


@query("SELECT CAST(n_nationkey AS BIGINT) AS row_key, '' AS col_name, n_name AS value FROM nation WHERE false")
def search_empty_include_set(spark, sf):
    return _hits(Tables(spark, sf).nation, "nation", columns=[])


_ALL = {"region": ("r_regionkey", ["r_name"]), "nation": ("n_nationkey", ["n_name"]), "customer": ("c_custkey", ["c_name", "c_mktsegment"]), "supplier": ("s_suppkey", ["s_name"]), "part": ("p_partkey", ["p_name", "p_brand", "p_type"])}
_ALL_SQL = " UNION ALL ".join(
    [f"SELECT '{t}' AS file_name, CAST({k} AS BIGINT) AS row_key, '{c}' AS col_name, {c} AS value FROM {t} WHERE contains(lower({c}), 'er')" for t, (k, cs) in _ALL.items() for c in cs]
    + [f"SELECT '{t}' AS file_name, CAST(-1 AS BIGINT) AS row_key, 'FileName' AS col_name, '{t}' AS value" for t in _ALL if "er" in t])


@query(_ALL_SQL)
def search_all_tables(spark, sf):
    t = Tables(spark, sf)
    return search.search_files({n: getattr(t, n) for n in _ALL}, "ER").select("file_name", *HIT)


@query("SELECT CAST(c_custkey AS BIGINT) AS row_key, 'c_mktsegment' AS col_name, c_mktsegment AS value, CAST(c_custkey AS VARCHAR) AS row_header FROM customer WHERE contains(lower(c_mktsegment), 'auto')")
def search_context_rowheader(spark, sf):
    return search.search_sheet(Tables(spark, sf).customer, "auto", columns=["c_mktsegment"]).select(*HIT, "row_header")


@query(_hit_sql("lineitem", "l_orderkey", ["l_partkey", "l_suppkey"], "contains({v}, '777')"))
def search_numeric_cells(spark, sf):
    return _hits(Tables(spark, sf).lineitem, "777", columns=["l_partkey", "l_suppkey"])


@query("SELECT CAST(doc_id AS BIGINT) AS row_key, lang FROM documents WHERE contains(lower(text), 'the')")
def search_documents(spark, sf):
    docs = Tables(spark, sf).documents
    return docs.filter(search.matches(F.col("text"), "The")).select(F.col("doc_id").alias("row_key"), "lang")


@query("""WITH f AS (SELECT p_partkey, p_name, strpos(lower(p_name), 'ge') AS place FROM part),
g AS (SELECT p_partkey, CASE WHEN place - 10 > 1 THEN '...' ELSE '' END || substr(p_name, greatest(place - 10, 1), least(place + 12, length(p_name) + 1) - greatest(place - 10, 1)) || CASE WHEN place + 12 <= length(p_name) THEN '...' ELSE '' END AS fragment FROM f WHERE place > 0),
h AS (SELECT arg_min(fragment, p_partkey) AS fragment, min(p_partkey) AS o FROM g GROUP BY lower(fragment))
SELECT fragment FROM h ORDER BY o LIMIT 10""")
def suggestions_top10(spark, sf):
    return search.suggestions(Tables(spark, sf).part, "p_name", "p_partkey", "GE")


@query("""WITH h AS (SELECT 'customer' AS f, c_mktsegment AS v FROM customer WHERE contains(lower(c_mktsegment), 'o') UNION ALL SELECT 'part', p_type FROM part WHERE contains(lower(p_type), 'o') UNION ALL SELECT 'customer', 'customer')
SELECT lower(v) AS value, count(*) AS hits, count(DISTINCT f) AS files, count(DISTINCT f) = 2 AS found_in_all FROM h GROUP BY 1""")
def group_hits_by_value(spark, sf):
    t = Tables(spark, sf)
    hits = search.search_files({"customer": t.customer, "part": t.part}, "o", columns={"customer": ["c_mktsegment"], "part": ["p_type"]})
    return search.group_by_value(hits, 2)


@query("""SELECT event_type, event_id, CAST(rank AS BIGINT) AS rank, total FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rank <= 100""")
def history_capped(spark, sf):
    out = search.capped_history(Tables(spark, sf).events.select("event_type", "event_id"), ["event_type"], ["event_id"])
    return out.select("event_type", "event_id", F.col("rank").cast("long").alias("rank"), "total")


@query('SELECT lower(event_type) AS query, max(event_id) AS "at" FROM events GROUP BY 1 ORDER BY "at" DESC, query LIMIT 5')
def history_recent5(spark, sf):
    return search.recent_queries(Tables(spark, sf).events, "event_type", "event_id")


@query("SELECT 'nation' AS file_name, CAST(n_nationkey AS BIGINT) AS row_key, n_name AS value FROM nation WHERE contains(lower(n_name), 'nation')")
def comparable_hits(spark, sf):
    return search.comparable(search.search_files({"nation": Tables(spark, sf).nation}, "nation")).select("file_name", "row_key", "value")


# Scalars --------------------------------------------------------------

@query("""SELECT l_orderkey, l_linenumber, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INTEGER)) WHEN i < 702 THEN chr(CAST(65 + (i - 26) // 26 AS INTEGER)) || chr(CAST(65 + (i - 26) % 26 AS INTEGER))
ELSE chr(CAST(65 + (i - 702) // 676 AS INTEGER)) || chr(CAST(65 + (i - 702) // 26 % 26 AS INTEGER)) || chr(CAST(65 + (i - 702) % 26 AS INTEGER)) END || CAST(l_linenumber + 1 AS VARCHAR) AS cell,
'R' || CAST(l_linenumber + 1 AS VARCHAR) || 'C' || CAST(i + 1 AS VARCHAR) AS rc, i AS back FROM (SELECT *, l_partkey % 5000 AS i FROM lineitem)""")
def a1_notation(spark, sf):
    i = F.col("l_partkey") % 5000
    cell = X.a1(F.col("l_linenumber"), i)
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", cell.alias("cell"), X.rc(F.col("l_linenumber"), i).alias("rc"), X.a1_column(cell).cast("long").alias("back"))


@query("""SELECT v, tag, count(*) AS n FROM (SELECT CASE WHEN v = '' THEN 'Empty' WHEN regexp_full_match(v, '[0-9]+') THEN 'Integer' WHEN regexp_full_match(v, '-?[0-9]+\\.[0-9]+') THEN 'FloatingPoint' WHEN v IN ('true', 'false') THEN 'Boolean' ELSE 'Text' END AS tag, v FROM
(SELECT CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN CAST(user_id AS VARCHAR) || '.25' WHEN 3 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE event_type END AS v FROM events)) GROUP BY v, tag""")
def cell_type_inference(spark, sf):
    k, u = F.col("event_id") % 5, F.col("user_id").cast("string")
    v = F.when(k == 0, "").when(k == 1, u).when(k == 2, F.concat(u, F.lit(".25"))).when(k == 3, F.when(F.col("user_id") % 2 == 0, "true").otherwise("false")).otherwise(F.col("event_type"))
    return Tables(spark, sf).events.select(v.alias("v")).select("v", X.infer_text(F.col("v")).alias("tag")).groupBy("v", "tag").agg(F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN true WHEN quality = 1 THEN false END AS flag FROM labels""")
def bool_words(spark, sf):
    word = F.when(F.col("toxic") == 1, " YES ").when(F.col("quality") == 1, "n").otherwise("maybe")
    return Tables(spark, sf).labels.select("doc_id", X.boolean_word(word).alias("flag"))


@query("""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\\x{200B}\\x{200C}\\x{200D}\\x{FEFF}]', '', 'g'), '\\r\\n?', chr(10), 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]', '', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS cleaned FROM documents""")
def clean_text(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", X.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT o_orderkey, round(floor(o_totalprice), 2) AS us, round(floor(o_totalprice) + 0.5, 2) AS eu, round(floor(o_totalprice), 2) / 100 AS pct FROM orders")
def number_parse(spark, sf):
    whole = F.floor("o_totalprice").cast("long")
    us = F.concat(F.lit("$"), F.format_number(whole, 0))
    eu = F.concat(F.regexp_replace(F.format_number(whole, 0), ",", "."), F.lit(",5 €"))
    return Tables(spark, sf).orders.select("o_orderkey", X.parse_number(us).alias("us"), X.parse_number(eu).alias("eu"), X.parse_number(F.concat(whole.cast("string"), F.lit("%"))).alias("pct"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def date_parse_multi(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "M/d/yyyy")).when(k == 2, F.date_format(d, "d MMM yyyy")).otherwise(F.date_format(d, "yyyy/MM/dd"))
    return Tables(spark, sf).orders.select("o_orderkey", F.date_format(X.parse_date(text), "yyyy-MM-dd").alias("day"))


@query("""SELECT o_orderkey, strftime(CASE WHEN s = 60 THEN DATE '1900-03-01' ELSE DATE '1899-12-30' + CAST(CASE WHEN s > 60 THEN s - 1 ELSE s END AS INTEGER) END, '%Y-%m-%d') AS d1900,
strftime(DATE '1904-01-01' + CAST(s AS INTEGER), '%Y-%m-%d') AS d1904 FROM (SELECT *, o_orderkey % 50000 AS s FROM orders)""")
def serial_dates(spark, sf):
    s = (F.col("o_orderkey") % 50000).cast("double")
    return Tables(spark, sf).orders.select("o_orderkey", F.date_format(X.serial_date(s), "yyyy-MM-dd").alias("d1900"), F.date_format(X.serial_date(s, "1904"), "yyyy-MM-dd").alias("d1904"))


FORMATS = ("0", "0.00", "0%", "yyyy-mm-dd", "[$€-407] #,##0.00", "[$-809]#,##0", "$#,##0.00", "[USD] 0.0", "#,##0 €", "h:mm AM/PM")


def _format():
    """A number format for each row of nation, by its key."""
    return F.element_at(F.array(*[F.lit(f) for f in FORMATS]), (F.col("n_nationkey") % len(FORMATS) + 1).cast("int"))


_FORMAT_SQL = "list_extract([" + ", ".join(f"'{f}'" for f in FORMATS) + f"], CAST(n_nationkey % {len(FORMATS)} + 1 AS INTEGER))"


@query(f"""SELECT n_nationkey, f, regexp_matches(lower(f), 'mm|dd|yy|m/d|d/m|h:|am/pm') AS is_date, regexp_matches(f, '[$€£¥₹₽]') AS is_currency, contains(f, '%') AS is_percent,
CASE WHEN contains(f, '%') THEN 'Percentage' WHEN regexp_matches(f, '[$€£¥₹₽]') THEN 'Currency' WHEN regexp_matches(lower(f), 'mm|dd|yy|m/d|d/m|h:|am/pm') THEN 'Date' ELSE 'Number' END AS kind FROM (SELECT n_nationkey, {_FORMAT_SQL} AS f FROM nation)""")
def format_predicates(spark, sf):
    f = F.col("f")
    kind = X.cell_type(F.lit("FloatingPoint"), F.lit(""), f)
    return Tables(spark, sf).nation.select("n_nationkey", _format().alias("f")).select("n_nationkey", "f", X.is_date_format(f).alias("is_date"), X.is_currency_format(f).alias("is_currency"), X.is_percent_format(f).alias("is_percent"), kind.alias("kind"))


@query(f"""SELECT n_nationkey, CASE WHEN f LIKE '%407%' THEN 'EUR' WHEN f LIKE '%809%' THEN 'GBP' WHEN f LIKE '%USD%' THEN 'USD' WHEN contains(f, '€') THEN 'EUR' WHEN contains(f, '$') THEN 'USD' END AS code,
CASE WHEN f LIKE '%407%' OR f LIKE '%809%' OR f LIKE '%USD%' THEN 'Unambiguous' WHEN contains(f, '€') OR contains(f, '$') THEN 'Low' END AS confidence FROM (SELECT n_nationkey, {_FORMAT_SQL} AS f FROM nation)""")
def currency_detect(spark, sf):
    return Tables(spark, sf).nation.select("n_nationkey", X.currency_code(_format()).alias("code"), X.currency_confidence(_format()).alias("confidence"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '0.00' ELSE '0.0%' END AS fmt FROM lineitem")
def csv_format_infer(spark, sf):
    text = F.when(F.col("l_linenumber") % 2 == 0, F.format_string("%.2f", "l_extendedprice")).otherwise(F.format_string("%.1f%%", "l_discount"))
    return Tables(spark, sf).lineitem.select("l_orderkey", "l_linenumber", X.csv_number_format(text).alias("fmt"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '^([=@\t\r]|[+-]([^0-9]|$))') THEN '''' || t ELSE t END AS guarded FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '=' || text WHEN 1 THEN '-' || text ELSE text END AS t FROM documents)""")
def csv_sanitize(spark, sf):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), "text")).otherwise(F.col("text"))
    return Tables(spark, sf).documents.select("doc_id", X.csv_guard(text).alias("guarded"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '^([=@\t\r]|[+-]([^0-9]|$))') THEN '''' || text ELSE text END AS guarded FROM documents")
def csv_guard_documents(spark, sf):
    return Tables(spark, sf).documents.select("doc_id", X.csv_guard(F.col("text")).alias("guarded"))


@query("SELECT page_id, substr(md5(lower(url)), 1, 6) AS hash FROM pages")
def path_hash(spark, sf):
    return Tables(spark, sf).pages.select("page_id", X.path_hash(F.col("url")).alias("hash"))


@query(r"""SELECT page_id, lower(regexp_replace(substr(regexp_replace(regexp_replace(url, '[\s<>:"/\\|?*\x00-\x1F]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 20), '_+$', '')) AS word FROM pages""")
def filename_sanitize(spark, sf):
    return Tables(spark, sf).pages.select("page_id", X.filename_keyword(F.col("url")).alias("word"))


# Profiles -------------------------------------------------------------

def _cells(t: Tables) -> DataFrame:
    """Typed cells made of events: every 7th an error, every 5th a text, else a number or a date."""
    k = F.col("event_id")
    kind = F.when(k % 7 == 0, "Error").when(k % 5 == 0, "Text").when(k % 11 == 0, "Unknown").when(k % 3 == 0, "Date").otherwise("Number")
    return t.events.select(F.col("event_type").alias("col_name"), k.alias("row_idx"), kind.alias("type"))


_CELLS = "cells AS (SELECT event_type AS col_name, event_id AS row_idx, CASE WHEN event_id % 7 = 0 THEN 'Error' WHEN event_id % 5 = 0 THEN 'Text' WHEN event_id % 11 = 0 THEN 'Unknown' WHEN event_id % 3 = 0 THEN 'Date' ELSE 'Number' END AS type FROM events)"
_DOM = "d AS (SELECT col_name, type, count(*) AS n, min(row_idx) AS first_row FROM cells GROUP BY 1, 2), dom AS (SELECT col_name, type AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY n DESC, first_row) AS r FROM d WHERE type NOT IN ('Unknown', 'Error')) WHERE r = 1)"


@query(f"WITH {_CELLS} SELECT col_name, type, count(*) AS n, min(row_idx) AS first_row FROM cells GROUP BY 1, 2")
def type_distribution(spark, sf):
    return profile.type_distribution(_cells(Tables(spark, sf)))


@query(f"WITH {_CELLS}, {_DOM} SELECT col_name, dominant, CAST(sum(n) AS BIGINT) AS total FROM dom JOIN d USING (col_name) GROUP BY 1, 2")
def dominant_type_first_seen(spark, sf):
    return profile.dominant_type(_cells(Tables(spark, sf)))


@query(f"""WITH {_CELLS}, {_DOM}, s AS (SELECT col_name, dominant, sum(n) AS total, sum(CASE WHEN type = dominant THEN n ELSE 0 END) AS nd, sum(CASE WHEN type NOT IN ('Unknown', 'Error') AND type <> dominant THEN n ELSE 0 END) AS mm, sum(CASE WHEN type = 'Error' THEN n ELSE 0 END) AS er FROM dom JOIN d USING (col_name) GROUP BY 1, 2)
SELECT col_name, dominant, CAST(mm AS BIGINT) AS mismatches, CAST(er AS BIGINT) AS errors, round(greatest(0.0, least(1.0, CAST(nd AS DOUBLE) / total - mm * CAST(0.05 AS DOUBLE) - er * CAST(0.02 AS DOUBLE))), 6) AS confidence FROM s""")
def type_confidence(spark, sf):
    return profile.profile(_cells(Tables(spark, sf))).select("col_name", "dominant", "mismatches", "errors", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_CELLS}, {_DOM} SELECT col_name, row_idx, CASE WHEN type = 'Error' THEN 'InconsistentFormat' ELSE 'TypeMismatch' END AS issue, CASE WHEN type = 'Error' THEN 'Warning' ELSE 'Error' END AS severity, dominant AS expected, type AS actual FROM cells JOIN dom USING (col_name) WHERE type = 'Error' OR (type <> 'Unknown' AND type <> dominant)")
def anomalies(spark, sf):
    return profile.anomalies(_cells(Tables(spark, sf)))


@query("""WITH c AS (SELECT CAST(s_nationkey % 3 AS VARCHAR) AS col_name, s_suppkey AS row_idx, CASE s_suppkey % 4 WHEN 0 THEN 'EUR' WHEN 3 THEN NULL ELSE 'USD' END AS currency FROM supplier),
b AS (SELECT col_name, currency AS expected FROM (SELECT *, row_number() OVER (PARTITION BY col_name ORDER BY n DESC, f) AS r FROM (SELECT col_name, currency, count(*) AS n, min(row_idx) AS f FROM c WHERE currency IS NOT NULL GROUP BY 1, 2)) WHERE r = 1)
SELECT col_name, row_idx, currency, expected FROM c JOIN b USING (col_name) WHERE currency <> expected""")
def mixed_currency(spark, sf):
    k = F.col("s_suppkey") % 4
    cells = Tables(spark, sf).supplier.select((F.col("s_nationkey") % 3).cast("string").alias("col_name"), F.col("s_suppkey").alias("row_idx"), F.when(k == 0, "EUR").when(k != 3, "USD").alias("currency"))
    return profile.mixed_currencies(cells)


@query(f"""WITH {_CELLS}, e AS (SELECT 'all' AS col_name, row_idx, type FROM cells), n AS (SELECT a.row_idx, b.type, count(*) AS n, min(b.row_idx) AS f FROM e a JOIN e b ON b.row_idx BETWEEN a.row_idx - 3 AND a.row_idx + 3 AND b.row_idx <> a.row_idx AND b.type <> 'Unknown' GROUP BY 1, 2),
g AS (SELECT row_idx, type AS local_type, row_number() OVER (PARTITION BY row_idx ORDER BY n DESC, f) AS r, sum(n) OVER (PARTITION BY row_idx) AS neighbours FROM n)
SELECT e.col_name, e.row_idx, local_type, CAST(coalesce(neighbours, 0) AS BIGINT) AS neighbours FROM e LEFT JOIN (SELECT * FROM g WHERE r = 1) g USING (row_idx)""")
def local_context(spark, sf):
    return profile.local_context(_cells(Tables(spark, sf)).withColumn("col_name", F.lit("all")))


@query("SELECT o_orderkey AS row_idx, o_orderstatus FROM orders WHERE o_orderkey >= 1 AND o_orderkey < 101")
def first_n_sample(spark, sf):
    return profile.first_sample(Tables(spark, sf).orders.select(F.col("o_orderkey").alias("row_idx"), "o_orderstatus"))


@query("SELECT CAST((count(v) - count(DISTINCT v)) * 60 AS BIGINT) AS bytes_saved FROM (SELECT c_mktsegment AS v FROM customer UNION ALL SELECT c_name FROM customer)")
def interning_saving(spark, sf):
    return profile.interning_saving(Tables(spark, sf).customer, ["c_mktsegment", "c_name"])


# Comparison -----------------------------------------------------------

@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE contains(lower(o_orderpriority), 'high')")
def extract_rows(spark, sf):
    orders = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return compare.extract_rows(orders, search.search_sheet(orders, "high", columns=["o_orderpriority"]), "o_orderkey")


@query("SELECT s_suppkey AS key, s_name AS name, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_mktsegment FROM customer")
def header_union(spark, sf):
    t = Tables(spark, sf)
    return compare.header_union([t.supplier.selectExpr("s_suppkey AS key", "s_name AS name"), t.customer.selectExpr("c_custkey AS key", "c_name AS name", "c_mktsegment AS segment")])


@query("SELECT c_nationkey, trim(c_mktsegment) AS value, count(*) AS freq FROM customer WHERE trim(c_mktsegment) <> '' GROUP BY 1, 2")
def value_frequency(spark, sf):
    return compare.value_frequency(Tables(spark, sf).customer.select("c_nationkey", F.col("c_mktsegment").alias("value")), ["c_nationkey"])


@query("""WITH c AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE o_orderstatus END AS value FROM orders),
f AS (SELECT o_custkey, value, count(*) AS freq, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, value) - 1 AS rank FROM c WHERE value <> '' GROUP BY 1, 2),
t AS (SELECT o_custkey, count(*) AS groups, sum(freq) AS filled FROM f GROUP BY 1), r AS (SELECT o_custkey, count(*) AS rows FROM c GROUP BY 1),
j AS (SELECT c.*, r.rows, coalesce(groups, 0) AS groups, coalesce(filled, 0) AS filled, freq, rank FROM c JOIN r USING (o_custkey) LEFT JOIN t USING (o_custkey) LEFT JOIN f USING (o_custkey, value)),
v AS (SELECT *, CASE WHEN value = '' AND filled > 0 THEN 'Missing' WHEN groups <= 1 THEN 'Match' ELSE 'Different' END AS verdict FROM j)
SELECT o_custkey, o_orderkey, value, verdict, CAST(CASE WHEN verdict = 'Missing' THEN 0 WHEN value = '' THEN rows WHEN verdict = 'Match' THEN filled ELSE freq END AS BIGINT) AS freq, CAST(CASE WHEN value = '' AND filled = 0 THEN rows ELSE filled END AS BIGINT) AS total,
round(CASE WHEN verdict = 'Missing' THEN 0.5 WHEN verdict = 'Match' THEN 0.0 ELSE ln(1 + CAST(rank AS DOUBLE) / (groups - 1) * (2.718281828459045 - 1)) END, 6) AS intensity FROM v""")
def diff_verdict(spark, sf):
    cells = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderstatus")).alias("value"))
    out = compare.verdicts(cells, ["o_custkey"])
    return out.select("o_custkey", "o_orderkey", "value", "verdict", *_long("freq", "total"), F.round("intensity", 6).alias("intensity"))


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), c_name, '') AS value FROM customer")
def coalesce_groups(spark, sf):
    return Tables(spark, sf).customer.select("c_custkey", compare.first_filled(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")), F.col("c_name")).alias("value"))


# Catalogues of columns ------------------------------------------------

#: Tables as files, with their columns in order. Headers lose the table's prefix; nation has them in capitals, supplier with a blank behind.
FILES = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
         "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")}


def _header(table: str, column: str) -> str:
    name = column.partition("_")[2]
    return name.upper() if table == "nation" else f"{name} " if table == "supplier" else name


_HEADERS = [(100 * k + i, f"{t}.xlsx", _header(t, c), i, t, c) for k, (t, columns) in enumerate(FILES.items()) for i, c in enumerate(columns)]


def _catalog(spark, sf) -> DataFrame:
    """A row for each column of the tables, its type the commonest of all its values: ord, file_name, col_name, col_idx, type."""
    cells = None
    for t, columns in FILES.items():
        own = [h for h in _HEADERS if h[4] == t]
        one = F.array(*[F.struct(F.lit(o).cast("long").alias("ord"), F.lit(f).alias("file_name"), F.lit(n).alias("col_name"), F.lit(i).alias("col_idx"), F.col(c).cast("string").alias("value")) for o, f, n, i, _, c in own])
        rows = getattr(Tables(spark, sf), t).select(F.explode(one).alias("x")).select("x.*")
        cells = rows if cells is None else cells.unionByName(rows)
    tag = X.infer_text(F.col("value"))
    kind = F.when(tag.isin("Integer", "FloatingPoint"), "Number").when(tag == "DateTime", "Date").otherwise(tag)
    counts = cells.withColumn("type", kind).groupBy("ord", "file_name", "col_name", "col_idx", "type").agg(F.count("*").alias("n"))
    return counts.groupBy("ord", "file_name", "col_name", "col_idx").agg(F.max_by("type", F.struct("n", "type")).alias("type"))


_CATALOG = "vals AS (" + " UNION ALL ".join(f"SELECT CAST({o} AS BIGINT) AS ord, '{f}' AS file_name, '{n}' AS col_name, {i} AS col_idx, CAST({c} AS VARCHAR) AS v FROM {t}" for o, f, n, i, t, c in _HEADERS) + """),
kinds AS (SELECT ord, file_name, col_name, col_idx, CASE WHEN regexp_full_match(trim(v), '[+-]?[0-9]{1,18}|[+-]?([0-9][0-9,]*\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'Number' ELSE 'Text' END AS type, count(*) AS n FROM vals GROUP BY ALL),
cat AS (SELECT ord, file_name, col_name, col_idx, arg_max(type, n * 100000 + length(type)) AS type FROM kinds GROUP BY ALL)"""


@query(f"""WITH {_CATALOG}, h AS (SELECT col_name, row_number() OVER (ORDER BY min(file_name || '|' || lpad(CAST(col_idx AS VARCHAR), 3, '0'))) - 1 AS place, count(DISTINCT file_name) AS have FROM cat GROUP BY 1)
SELECT col_name, 'Missing' AS issue, 5 - have AS files FROM h WHERE have < 5 UNION ALL SELECT col_name, 'Position', count(DISTINCT file_name) FROM cat JOIN h USING (col_name) WHERE col_idx <> place GROUP BY 1""")
def structural_warnings(spark, sf):
    return compare.structural_warnings(_catalog(spark, sf)).select("col_name", "issue", "files")


@query(f"""WITH {_CATALOG}, g AS (SELECT lower(trim(col_name)) AS k, arg_min(col_name, ord) AS semantic_name, count(*) AS columns, count(DISTINCT lower(file_name)) AS sources, count(DISTINCT col_name) AS case_variants, count(DISTINCT type) AS type_variants, list_sort(list(DISTINCT col_name)) AS ns, list_sort(list(DISTINCT type)) AS ts FROM cat GROUP BY 1),
d AS (SELECT k, type AS dominant FROM (SELECT lower(trim(col_name)) AS k, type, row_number() OVER (PARTITION BY lower(trim(col_name)) ORDER BY count(*) DESC, min(ord)) AS r FROM cat GROUP BY 1, 2) WHERE r = 1)
SELECT semantic_name, dominant, columns, sources, case_variants, type_variants, nullif(concat_ws('; ', CASE WHEN case_variants > 1 THEN 'case: ' || array_to_string(ns[1:3], ', ') END, CASE WHEN type_variants > 1 THEN 'types: ' || array_to_string(ts, ', ') END), '') AS warning FROM g JOIN d USING (k)""")
def column_links(spark, sf):
    return linking.column_links(_catalog(spark, sf)).select("semantic_name", "dominant", "columns", "sources", *_long("case_variants", "type_variants"), "warning")


@query(f"WITH {_CATALOG} SELECT ord, CASE WHEN lower(trim(col_name)) = 'brand' THEN 'Name' ELSE col_name END AS link FROM cat")
def merge_links(spark, sf):
    return linking.merge_links(_catalog(spark, sf), "Name", "Brand").select("ord", "link")


@query(f"WITH {_CATALOG} SELECT display, string_agg(col_name, '|' ORDER BY ord) AS headers, min(ord) AS place FROM (SELECT *, first_value(d) OVER (PARTITION BY lower(d) ORDER BY ord) AS display FROM (SELECT *, trim(col_name) AS d FROM cat)) GROUP BY 1")
def header_groups(spark, sf):
    return linking.header_groups(_catalog(spark, sf).select("ord", F.col("col_name").alias("header"), F.trim("col_name").alias("display"))).select("display", "headers", "place")


@query("SELECT c_mktsegment AS header, CASE c_mktsegment WHEN 'BUILDING' THEN 'Works' WHEN 'MACHINERY' THEN 'Works' ELSE c_mktsegment END AS semantic_name FROM customer")
def semantic_lookup(spark, sf):
    links = spark.createDataFrame([("Works", 0, ["building", " Machinery"]), ("Other", 1, ["building"])], "semantic_name string, ord int, members array<string>")
    return linking.semantic_lookup(Tables(spark, sf).customer.select(F.col("c_mktsegment").alias("header")), links)


# Templates ------------------------------------------------------------

TEMPLATE = template.Template("parties", (template.Expected("Name", "Text", 1), template.Expected("AcctBal", "Number", 2), template.Expected("Brand", "Number", required=False)), allow_extra=False)
_ISSUES = f"""WITH {_CATALOG}, want(name, type, pos, req) AS (VALUES ('Name', 'Text', 1, true), ('AcctBal', 'Number', 2, true), ('Brand', 'Number', -1, false)), m AS (SELECT file_name, name, c.type AS got, want.type AS wt, col_idx, pos FROM cat c JOIN want ON lower(c.col_name) = lower(name)),
issues AS (SELECT file_name, name AS "column", 'WrongPosition' AS issue, 'Warning' AS severity FROM m WHERE pos >= 0 AND col_idx <> pos UNION ALL SELECT file_name, name, 'TypeMismatch', 'Error' FROM m WHERE got <> wt
UNION ALL SELECT f.file_name, name, 'MissingColumn', CASE WHEN req THEN 'Error' ELSE 'Warning' END FROM (SELECT DISTINCT file_name FROM cat) f, want WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_name = f.file_name AND m.name = want.name)
UNION ALL SELECT file_name, col_name, 'ExtraColumn', 'Info' FROM cat WHERE NOT EXISTS (SELECT 1 FROM want WHERE lower(name) = lower(col_name)))"""


@query(f"{_ISSUES} SELECT * FROM issues")
def template_structure(spark, sf):
    return template.structure_issues(_catalog(spark, sf), TEMPLATE)


@query(f"{_ISSUES} SELECT file_name, count(*) FILTER (severity IN ('Error', 'Critical')) AS errors, count(*) FILTER (severity = 'Warning') AS warnings, count(*) FILTER (severity = 'Info') AS infos, CASE WHEN count(*) FILTER (severity IN ('Error', 'Critical')) > 0 THEN 'Invalid' WHEN count(*) FILTER (severity = 'Warning') > 0 THEN 'ValidWithWarnings' ELSE 'Valid' END AS status FROM issues GROUP BY 1")
def report_rollup(spark, sf):
    return template.report(template.structure_issues(_catalog(spark, sf), TEMPLATE))


@query(f"{_ISSUES} SELECT severity, file_name AS context, count(*) AS n FROM issues GROUP BY GROUPING SETS ((severity), (file_name), ())")
def error_summary(spark, sf):
    return template.error_summary(template.structure_issues(_catalog(spark, sf), TEMPLATE))


@query("SELECT CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1 ORDER BY n DESC, min(c_custkey) LIMIT 5")
def duplicates_top5(spark, sf):
    return template.duplicates(Tables(spark, sf).customer, "c_nationkey", "c_custkey")


@query("SELECT lower(p_type) AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, min(p_partkey) LIMIT 5")
def duplicates_in_any_case(spark, sf):
    """Values that repeat when case is set aside."""
    mixed = Tables(spark, sf).part.withColumn("p_type", F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).otherwise(F.lower("p_type")))
    return template.duplicates(mixed, "p_type", "p_partkey").select(F.lower("value").alias("value"), "n")


@query("SELECT 'text' AS col_name, count(*) FILTER (trim(text, ' ') <> '') AS filled FROM documents UNION ALL SELECT 'lang', count(*) FILTER (trim(lang, ' ') <> '') FROM documents")
def not_empty(spark, sf):
    return template.not_empty(Tables(spark, sf).documents, ["text", "lang"])


RULES = [template.Rule("l_quantity", "InRange", "5|40"), template.Rule("l_discount", "Positive"), template.Rule("l_tax", "NonNegative"), template.Rule("l_returnflag", "InList", "n, r"), template.Rule("l_linestatus", "MaxLength", "1"), template.Rule("l_returnflag", "Pattern", "^[AN]$")]
_RULE_SQL = {("l_quantity", "InRange"): "l_quantity < 5 OR l_quantity > 40", ("l_discount", "Positive"): "l_discount <= 0", ("l_tax", "NonNegative"): "l_tax < 0", ("l_returnflag", "InList"): "lower(l_returnflag) NOT IN ('n', 'r')", ("l_linestatus", "MaxLength"): "length(l_linestatus) > 1", ("l_returnflag", "Pattern"): "NOT regexp_matches(l_returnflag, '^[AN]$')"}


@query(" UNION ALL ".join(f"SELECT '{c}' AS col_name, '{k}' AS rule, count(*) FILTER ({w}) AS violations FROM lineitem" for (c, k), w in _RULE_SQL.items()))
def rules(spark, sf):
    return template.rule_violations(Tables(spark, sf).lineitem, RULES)


# Merged ranges --------------------------------------------------------

RANGES = ((0, 0, 0, 2, 0), (1, 4, 0, 4, 1), (2, 6, 1, 8, 1))
_GRID = "g AS (SELECT CAST(n_nationkey AS BIGINT) AS row_idx, 0 AS col_idx, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 1, CAST(n_regionkey AS VARCHAR) FROM nation)"
_COVER = "rg(ord, r0, c0, r1, c1) AS (VALUES " + ", ".join(map(str, RANGES)) + "), cov AS (SELECT g.*, r0, c0, ord FROM g LEFT JOIN rg ON row_idx BETWEEN r0 AND r1 AND col_idx BETWEEN c0 AND c1)"


def _merged(spark, sf, strategy):
    nation = Tables(spark, sf).nation
    grid = nation.select(F.col("n_nationkey").cast("long").alias("row_idx"), F.lit(0).alias("col_idx"), F.col("n_name").alias("value")).unionByName(nation.select(F.col("n_nationkey").cast("long").alias("row_idx"), F.lit(1).alias("col_idx"), F.col("n_regionkey").cast("string").alias("value")))
    return merged.resolve(grid, spark.createDataFrame(RANGES, "ord int, r0 long, c0 int, r1 long, c1 int"), strategy)


@query(f"WITH {_GRID}, {_COVER} SELECT row_idx, col_idx, CASE WHEN ord IS NULL THEN value ELSE (SELECT value FROM g WHERE g.row_idx = cov.r0 AND g.col_idx = cov.c0) END AS value FROM cov")
def merge_expand(spark, sf):
    return _merged(spark, sf, "expand")


@query(f"WITH {_GRID}, {_COVER} SELECT row_idx, col_idx, CASE WHEN ord IS NULL OR (row_idx = r0 AND col_idx = c0) THEN value END AS value FROM cov")
def merge_keep(spark, sf):
    return _merged(spark, sf, "keep")


@query(f"WITH {_GRID}, {_COVER}, t AS (SELECT ord, string_agg(value, ' ' ORDER BY row_idx, col_idx) AS v FROM cov WHERE ord IS NOT NULL GROUP BY 1) SELECT row_idx, col_idx, CASE WHEN cov.ord IS NULL THEN value WHEN row_idx = r0 AND col_idx = c0 THEN v END AS value FROM cov LEFT JOIN t USING (ord)")
def merge_flatten(spark, sf):
    return _merged(spark, sf, "flatten")


def queries() -> dict:
    from gridwork import catalog_files, catalog_sheets  # noqa: F401  register their queries

    return dict(QUERIES)


def oracle_sql() -> dict:
    queries()
    return dict(SQL)
