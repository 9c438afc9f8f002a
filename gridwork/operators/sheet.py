"""Sheets as long cells (file, sheet, row_idx, col_idx, col_name, tag, value, fmt): headers, access, update, selection, order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHEET = ("file", "sheet")
# Severities, the gravest first.
BY_GRAVITY = ("Critical", "Error", "Warning", "Info")
#: Rows of a sheet whose cells of one column meet their name in one task.
STRETCH = 16_384


def unique_names(headers: DataFrame, by: Sequence[str] = SHEET) -> DataFrame:
    """(col_idx, name) with ``col_name``: blank names are ``Column_{col_idx}``, repeated ones get _2, _3 and so on in order of column.

    One row per column of a sheet meets in a task, at most the width of a sheet.
    """
    name = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.concat(F.lit("Column_"), F.col("col_idx").cast("string"))).otherwise(F.col("name"))
    n = F.row_number().over(Window.partitionBy(*by, "_name").orderBy("col_idx"))
    rows = headers.withColumn("_name", name).withColumn("_n", n)
    return rows.withColumn("col_name", F.when(F.col("_n") == 1, F.col("_name")).otherwise(F.concat("_name", F.lit("_"), F.col("_n").cast("string")))).drop("_name", "_n")


def with_headers(cells: DataFrame, by: Sequence[str] = SHEET, tasks: int | None = None) -> DataFrame:
    """Cells under the names of their sheet's first row: columns outside its span go, and rows are numbered by the sheet's own numbers.

    Columns inside the span that the first row leaves blank get a name, too.
    Packed files look small to the planner, which would send all their cells to the
    driver and from there to every executor. So only a row for each sheet is sent
    around, and cells meet their names by a merge join, dealt by sheet, column and
    stretch of rows: no sheet is too long for a task. ``tasks`` is how many tasks the
    cells are dealt to, or more where ``spark.sql.shuffle.partitions`` is; without it
    the planner goes by packed bytes.
    """
    by = list(by)
    top = cells.groupBy(*by).agg(F.min("row_idx").alias("header_row"), F.max("row_idx").alias("last_row"))
    head = cells.join(F.broadcast(top), by).filter("row_idx = header_row")
    # Each name stands for its own column; those that are left blank behind it follow.
    after = F.greatest(F.lead("col_idx").over(Window.partitionBy(*by).orderBy("col_idx")) - 1, F.col("col_idx"))
    every = head.withColumn("_after", after).select(*by, "header_row", "last_row", "value", F.posexplode(F.sequence("col_idx", "_after")).alias("_n", "col_idx"))
    names = unique_names(every.withColumn("name", F.when(F.col("_n") == 0, F.col("value"))), by)
    stretch = lambda row: F.floor(F.col(row) / STRETCH)
    names = names.select(*by, "col_idx", "col_name", "header_row", F.explode(F.sequence(stretch("header_row"), stretch("last_row"))).alias("_stretch"))
    keys = [*by, "col_idx", "_stretch"]
    cells = cells.withColumn("_stretch", stretch("row_idx"))
    return (cells.repartition(tasks, *keys) if tasks else cells).join(names.hint("merge"), keys).drop("_stretch")


def data_rows(cells: DataFrame, header_rows: int = 1) -> DataFrame:
    return cells.filter(F.col("row_idx") >= header_rows)


def cell_at(cells: DataFrame, row: int, column: int) -> DataFrame:
    """The cell at a place: its value, or one row with an empty one where there is none."""
    found = cells.filter((F.col("row_idx") == row) & (F.col("col_idx") == column)).agg(F.first("value").alias("value"), F.first("tag").alias("tag"))
    return found.select(F.coalesce("value", F.lit("")).alias("value"), F.coalesce("tag", F.lit("Empty")).alias("tag"))


def row_at(cells: DataFrame, row: int) -> DataFrame:
    """The cells of one row in order of column; none outside the sheet."""
    return cells.filter(F.col("row_idx") == row).orderBy("col_idx")


def updated(cells: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells with the values of (row_idx, col_idx, value); places without a cell get one, and of repeated changes the greatest value stays."""
    new = changes.groupBy("row_idx", "col_idx").agg(F.max("value").alias("_new"), F.lit(True).alias("_set"))
    both = cells.join(new, ["row_idx", "col_idx"], "full")
    return both.withColumn("value", F.when(F.coalesce("_set", F.lit(False)), F.col("_new")).otherwise(F.col("value"))).drop("_new", "_set")


def counters(cells: DataFrame, header_rows: int = 1, by: Sequence[str] = SHEET) -> DataFrame:
    """rows, data_rows, columns, cells and cells with a number format of each sheet."""
    rows = F.countDistinct("row_idx")
    return cells.groupBy(*by).agg(
        rows.alias("rows"), F.countDistinct(F.when(F.col("row_idx") >= header_rows, F.col("row_idx"))).alias("data_rows"), F.countDistinct("col_idx").alias("columns"),
        F.count(F.when(F.col("value") != "", 1)).alias("cells"), F.count("fmt").alias("formatted"))


def projected(df: DataFrame, included: Sequence[str] | None, names: Mapping[str, str]) -> DataFrame:
    """Included columns (any case; None: all) in their order under their semantic names."""
    wanted = None if included is None else {c.lower() for c in included}
    lower = {k.lower(): v for k, v in names.items()}
    return df.select(*[F.col(f"`{c}`").alias(lower.get(c.lower(), c)) for c in df.columns if wanted is None or c.lower() in wanted])


def visible(hits: DataFrame, hidden: Sequence[str] = (), only: str | None = None) -> DataFrame:
    """Hits of the files that are shown: ``only`` one, or all but the hidden ones."""
    if only is not None:
        return hits.filter(F.col("file_name") == only)
    return hits.filter(~F.col("file_name").isin(*hidden)) if hidden else hits


def errors_by_level(errors: DataFrame, level: str) -> DataFrame:
    return errors.filter(F.col("severity") == level)


def error_flags(errors: DataFrame, by: Sequence[str] = ("file",)) -> DataFrame:
    """has_errors (Error or Critical), has_warnings, has_critical of each file."""
    has = lambda *s: F.coalesce(F.bool_or(F.col("severity").isin(*s)), F.lit(False))
    return errors.groupBy(*by).agg(has("Error", "Critical").alias("has_errors"), has("Warning").alias("has_warnings"), has("Critical").alias("has_critical"))


def load_status(files: DataFrame, errors: DataFrame) -> DataFrame:
    """(file, sheets) with ``status``: without an Error or Critical one Success; else PartialSuccess if there is a sheet, and Failed."""
    flags = error_flags(errors).select("file", "has_errors")
    out = files.join(flags, "file", "left")
    return out.withColumn("status", F.when(~F.coalesce("has_errors", F.lit(False)), "Success").when(F.col("sheets") > 0, "PartialSuccess").otherwise("Failed")).drop("has_errors")


def gravity(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in BY_GRAVITY]), severity)


def by_gravity(issues: DataFrame, order: str) -> DataFrame:
    """Issues with their place, the gravest first and in their own order among equals; a range partitioning, no single task."""
    return issues.orderBy(gravity(F.col("severity")), order)


def narrowed(names: DataFrame, text: str, order: str, keep: int = 10) -> DataFrame:
    """Names (name) that contain a text in any case, distinct in any case, in order: a list of ``keep``."""
    hit = names.filter(F.lower("name").contains(text.lower())) if text else names
    return hit.groupBy(F.lower("name").alias("_key")).agg(F.min_by("name", order).alias("name"), F.min(order).alias("_first")).orderBy("_first").limit(keep).select("name")


def find_header(headers: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted) with the place of its header (header, col_idx): the first that is equal, else the first that is equal trimmed and in any case."""
    key = lambda c: F.lower(F.trim(c))
    exact = headers.groupBy("header").agg(F.min("col_idx").alias("_exact")).withColumnRenamed("header", "wanted")
    loose = headers.groupBy(key(F.col("header")).alias("_key")).agg(F.min("col_idx").alias("_loose"))
    out = wanted.join(exact, "wanted", "left").withColumn("_key", key(F.col("wanted"))).join(loose, "_key", "left")
    return out.select("wanted", F.coalesce("_exact", "_loose", F.lit(-1)).alias("col_idx"))
