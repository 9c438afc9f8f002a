"""Validation of sheets against templates: every check over all files at once, as DataFrames of issues.

Cells are long rows (file, sheet, sheet_idx, row_idx, col_idx, col_name, type,
value, fmt) of data rows; ``analysed`` gives one row per column. Where the
original looks at the first 100 data rows, so does ``sample`` (None: all rows).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.operators import profile
from gridwork.operators.template import Expected, Rule, Template

COLUMN = ("file", "sheet", "col_idx", "col_name")
ISSUE = ("file", "col_name", "col_idx", "row_idx", "issue", "severity", "expected", "actual")


def target_sheets(cells: DataFrame, template: Template, sheet: str | None = None) -> DataFrame:
    """The sheet of each file to look at (file, sheet): the one asked for, else the template's, else the first; null where there is none."""
    sheets = cells.groupBy("file", "sheet").agg(F.min("sheet_idx").alias("at"))
    wanted = sheet or template.sheet
    found = F.min_by("sheet", "at") if not wanted else F.min_by("sheet", F.when(F.lower("sheet") == wanted.lower(), F.col("at")))
    return sheets.groupBy("file").agg(found.alias("sheet"))


def analysed(cells: DataFrame, sample: int | None = profile.SAMPLE, header_rows: int = 1) -> DataFrame:
    """One row per column: type, confidence, currency, and of all its data rows how many are filled."""
    data = cells.filter(F.col("row_idx") >= header_rows)
    seen = data if sample is None else profile.first_sample(data, header_rows, sample)
    filled = cells.groupBy(*COLUMN).agg(F.count(F.when((F.col("row_idx") >= header_rows) & (F.trim("value") != ""), 1)).alias("filled"))
    out = filled.join(profile.analyse(seen, COLUMN), list(COLUMN), "left")
    return out.withColumn("type", F.coalesce("type", F.lit("Unknown"))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))


def _expected(df: DataFrame, template: Template) -> DataFrame:
    rules = lambda c: [r.kind for r in template.rules if r.column.lower() == c.name.lower()]
    rows = [(i, c.name, c.type, c.position, c.required, float(c.min_confidence), c.currency, [n.lower() for n in (c.name, *c.alternatives, *filter(None, [c.semantic]))], "NotEmpty" in rules(c), "Unique" in rules(c)) for i, c in enumerate(template.columns)]
    return df.sparkSession.createDataFrame(rows, "ord int, name string, want string, position int, required boolean, min_confidence double, want_currency string, names array<string>, not_empty boolean, uniq boolean")


def _issue(df: DataFrame, issue: str, severity, expected=None, actual=None, row=None) -> DataFrame:
    text = lambda c: F.lit(None).cast("string") if c is None else F.lit(c).cast("string") if isinstance(c, str) else c.cast("string")
    return df.select(
        "file", F.col("name").alias("col_name"), F.col("col_idx").cast("int").alias("col_idx"), (F.lit(None) if row is None else row).cast("long").alias("row_idx"), F.lit(issue).alias("issue"),
        (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), text(expected).alias("expected"), text(actual).alias("actual"))


def matched(columns: DataFrame, template: Template) -> DataFrame:
    """Each expected column of each file with the first actual column of one of its names (col_idx null: missing)."""
    want = _expected(columns, template)
    met = columns.withColumn("_key", F.lower("col_name")).join(want.select("ord", F.explode("names").alias("_key")), "_key")
    first = met.groupBy("file", "ord").agg(F.min_by(F.struct("col_idx", F.col("col_name").alias("actual_name"), "type", "confidence", "currency", "filled"), "col_idx").alias("m")).select("file", "ord", "m.*")
    every = columns.select("file").distinct().withColumn("ord", F.explode(F.array(*[F.lit(i) for i in range(len(template.columns))]))) if template.columns else columns.select("file").limit(0).withColumn("ord", F.lit(0))
    return every.join(want.drop("names"), "ord").join(first, ["file", "ord"], "left")


def column_issues(cells: DataFrame, columns: DataFrame, template: Template, sample: int | None = profile.SAMPLE) -> DataFrame:
    """All issues of expected columns: missing, place, type, confidence, cells of another type, currency, empty, repeated values."""
    both = matched(columns, template)
    here = both.filter("col_idx IS NOT NULL")
    out = _issue(both.filter("col_idx IS NULL"), "MissingColumn", F.when(F.col("required"), "Error").otherwise("Warning"), F.col("name"))
    out = out.unionByName(_issue(here.filter("position >= 0 AND position <> col_idx"), "WrongPosition", "Warning", F.col("position"), F.col("col_idx")))
    out = out.unionByName(_issue(here.filter("want <> 'Unknown' AND want <> type"), "TypeMismatch", "Error", F.col("want"), F.col("type")))
    out = out.unionByName(_issue(here.filter("confidence < min_confidence"), "LowConfidence", "Warning", F.col("min_confidence"), F.round("confidence", 6)))
    out = out.unionByName(_issue(here.filter("want_currency IS NOT NULL AND (currency IS NULL OR lower(currency) <> lower(want_currency))"), "CurrencyMismatch", "Warning", F.col("want_currency"), F.col("currency")))
    out = out.unionByName(_issue(here.filter("not_empty AND filled = 0"), "EmptyColumn", "Error"))
    data = cells.filter("row_idx >= 1")
    seen = (data if sample is None else profile.first_sample(data, 1, sample)).select("file", "col_idx", "row_idx", F.col("type").alias("actual_type"), "value")
    odd = here.join(seen, ["file", "col_idx"]).filter("NOT actual_type IN ('Unknown', 'Error') AND actual_type <> type AND type <> 'Unknown'")
    out = out.unionByName(_issue(odd, "RuleViolation", "Error", F.col("type"), F.col("actual_type"), F.col("row_idx")))
    return out.unionByName(repeated_values(data, here.filter("uniq")))


def repeated_values(data: DataFrame, columns: DataFrame, keep: int = 5) -> DataFrame:
    """DuplicateValue issues: of each column the ``keep`` most frequent values (any case) that occur more than once."""
    from pyspark.sql import Window

    text = data.filter("value <> ''").join(columns.select("file", "col_idx", "name"), ["file", "col_idx"])
    by = text.groupBy("file", "col_idx", "name", F.lower("value").alias("_key")).agg(F.count("*").alias("n"), F.min_by("value", "row_idx").alias("value"), F.min("row_idx").alias("first")).filter("n > 1")
    rank = F.row_number().over(Window.partitionBy("file", "col_idx").orderBy(F.desc("n"), "first"))
    return _issue(by.withColumn("rank", rank).filter(F.col("rank") <= keep), "DuplicateValue", "Warning", F.col("n"), F.col("value"))


def sheet_issues(cells: DataFrame, template: Template) -> DataFrame:
    """Sheet name and number of data rows."""
    rows = cells.groupBy("file", "sheet").agg(F.countDistinct(F.when(F.col("row_idx") >= 1, F.col("row_idx"))).alias("n")).withColumn("name", F.lit(None).cast("string")).withColumn("col_idx", F.lit(None).cast("int"))
    low, high = template.min_rows or 0, template.max_rows or 0
    limits = f"{low}-{high}" if high else f">= {low}"
    out = _issue(rows.filter(F.lit(bool(low)) & (F.col("n") < low) | F.lit(bool(high)) & (F.col("n") > high)), "RowCountOutOfRange", "Warning", limits, F.col("n"))
    if template.sheet:
        out = out.unionByName(_issue(rows.filter(F.lower("sheet") != template.sheet.lower()), "SheetNameMismatch", "Warning", template.sheet, F.col("sheet")))
    return out


def validate(cells: DataFrame, template: Template, sheet: str | None = None, sample: int | None = profile.SAMPLE) -> DataFrame:
    """All issues of all files against one template: a batch is the same call over more files.

    A template that is wrong itself, or a file without the sheet, gives one
    Critical issue a file and nothing else.
    """
    files = target_sheets(cells, template, sheet)
    failed = lambda df, why: _issue(df.withColumn("name", F.lit(None).cast("string")).withColumn("col_idx", F.lit(None).cast("int")), "Failed", "Critical", None, why)
    problems = template.validate()
    if problems:
        return failed(files, "; ".join(problems))
    mine = cells.join(files.filter("sheet IS NOT NULL"), ["file", "sheet"], "left_semi")
    columns = analysed(mine, sample)
    out = column_issues(mine, columns, template, sample).unionByName(sheet_issues(mine, template)).unionByName(failed(files.filter("sheet IS NULL"), "sheet not found"))
    if not template.allow_extra:
        names = sorted({n.lower() for c in template.columns for n in (c.name, *c.alternatives, c.semantic or c.name)})
        extra = columns.filter(~F.lower("col_name").isin(*names)).withColumn("name", F.col("col_name"))
        out = out.unionByName(_issue(extra, "ExtraColumn", "Info"))
    return out


def reports(files: DataFrame, issues: DataFrame, template: Template) -> DataFrame:
    """One row per file (files: file): errors, warnings, infos, columns passed, failed, missing and extra, and status."""
    count = lambda test: F.count(F.when(test, 1))
    severe = F.col("severity").isin("Error", "Critical")
    totals = issues.groupBy("file").agg(
        count(severe).alias("errors"), count(F.col("severity") == "Warning").alias("warnings"), count(F.col("severity") == "Info").alias("infos"),
        count(F.col("issue") == "MissingColumn").alias("missing"), count(F.col("issue") == "ExtraColumn").alias("extra"), count(F.col("issue") == "Failed").alias("_failed"),
        F.countDistinct(F.when(severe & F.col("col_name").isNotNull(), F.col("col_name"))).alias("failed"))
    out = files.select("file").distinct().join(totals, "file", "left").na.fill(0)
    n = len(template.columns)
    status = F.when(F.col("_failed") > 0, "Failed").when(F.col("errors") > 0, "Invalid").when(F.col("warnings") > 0, "ValidWithWarnings").otherwise("Valid")
    return out.withColumn("passed", F.when(F.col("_failed") > 0, 0).otherwise(n - F.col("failed"))).withColumn("status", status).drop("_failed")


def issues_by_column(issues: DataFrame) -> DataFrame:
    return issues.filter("col_name IS NOT NULL").groupBy("file", "col_name").agg(F.count("*").alias("n"), F.count(F.when(F.col("severity").isin("Error", "Critical"), 1)).alias("errors"))


def batch_totals(reports: DataFrame) -> DataFrame:
    """Files that are valid, valid with warnings, and with errors; sums of errors and warnings."""
    of = lambda *s: F.count(F.when(F.col("status").isin(*s), 1))
    return reports.agg(of("Valid").alias("valid"), of("ValidWithWarnings").alias("with_warnings"), of("Invalid", "Failed").alias("with_errors"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))


def quick_check(columns: DataFrame, template: Template) -> DataFrame:
    """(file, ok): whether all required columns are there, at their places where those are set. columns: file, col_idx, col_name."""
    have = columns.select("file", "col_idx", "col_name", F.lit("Unknown").alias("type"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("currency"), F.lit(0).alias("filled"))
    both = matched(have, template)
    bad = F.col("required") & (F.col("col_idx").isNull() | (F.col("position") >= 0) & (F.col("position") != F.col("col_idx")))
    return both.groupBy("file").agg((~F.bool_or(bad)).alias("ok"))


def template_from(columns: DataFrame, name: str, file: str, sheet: str) -> Template:
    """A template that one sheet fulfils: every column required, at its place, of its type. Its columns are few; they come to the driver."""
    rows = columns.filter((F.col("file") == file) & (F.col("sheet") == sheet)).orderBy("col_idx").select("col_name", "col_idx", "type", "currency").collect()
    expected = tuple(Expected(r.col_name, r.type, int(r.col_idx), True, currency=r.currency if r.type == "Currency" else None) for r in rows)
    rules = tuple(Rule(r.col_name, k) for r in rows for k in ("NotEmpty", "TypeMatch")) + tuple(Rule(r.col_name, "Currency", r.currency) for r in rows if r.type == "Currency" and r.currency)
    return Template(name, expected, rules, sheet=sheet)


def with_semantics(template: Template, names: dict[str, str]) -> Template:
    """The template with semantic names (by column name in any case) on its columns."""
    lower = {k.lower(): v for k, v in names.items()}
    return replace(template, columns=tuple(replace(c, semantic=lower.get(c.name.lower(), c.semantic)) for c in template.columns))
