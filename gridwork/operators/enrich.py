"""Enrichment of sheets: merges resolved, cells normalised, columns analysed, anomalies as errors; catalogue and comparisons.

Cells are long rows (file, sheet, sheet_idx, row_idx, col_idx, col_name, tag, value, fmt).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.operators.order import numbered
from gridwork.functions import scalars as X
from gridwork.operators import merged, profile

SHEET = ["file", "sheet"]
COLUMN = ("file", "sheet", "col_idx", "col_name")


def normalized(cells: DataFrame, system: str = "1900", mode: str = "reference", integers: bool = False) -> DataFrame:
    """Cells with ``n`` (type, text, number, flag, date, issue) and ``cleaned``, the text of the normalised value."""
    out = cells.withColumn("n", X.normalize(F.col("tag"), F.col("value"), F.col("fmt"), system, mode, integers))
    return out.withColumn("cleaned", X.effective(F.col("tag"), F.col("value"), F.col("n")))


def resolved(cells: DataFrame, ranges: DataFrame, strategy: str = "expand") -> DataFrame:
    """Cells with merges resolved; a covered place that had no content takes the tag of a text."""
    new = merged.resolve(cells.select(*SHEET, "row_idx", "col_idx", "value"), ranges, strategy, SHEET).withColumnRenamed("value", "_value")
    both = cells.join(new, [*SHEET, "row_idx", "col_idx"])
    filled = (F.col("tag") == "Empty") & (F.coalesce("_value", F.lit("")) != "")
    return both.withColumn("tag", F.when(filled, "Text").when(F.col("_value").isNull(), "Empty").otherwise(F.col("tag"))).withColumn("value", F.coalesce("_value", F.lit(""))).drop("_value")


def enrich(cells: DataFrame, ranges: DataFrame | None = None, strategy: str = "expand", sample: int | None = profile.SAMPLE, header_rows: int = 1, mode: str = "reference") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The cells with their cleaned values, the columns with their analysis, and the anomalies as errors.

    Cleaning and analysis look at the first ``sample`` data rows (None: all), the
    analysis at the original values. Columns without any content are left out.
    ``mode`` is that of serial dates.
    """
    if ranges is not None:
        cells = resolved(cells, ranges, strategy)
    data = cells.filter(F.col("row_idx") >= header_rows)
    full = data.filter(F.trim("value") != "").select(*COLUMN).distinct()
    cells = cells.join(full, list(COLUMN), "left_semi")
    inside = (F.col("row_idx") >= header_rows) & (F.lit(True) if sample is None else F.col("row_idx") < header_rows + sample)
    out = normalized(cells, mode=mode).withColumn("cleaned", F.when(inside, F.col("cleaned")).otherwise(F.col("value"))).withColumn("type", X.cell_type(F.col("tag"), F.col("value"), F.col("fmt")))
    seen = out.filter(inside)
    return out, profile.analyse(seen, COLUMN), anomaly_errors(profile.anomalies(seen, COLUMN))


def anomaly_errors(anomalies: DataFrame) -> DataFrame:
    """Anomalies as load errors: file, sheet, severity, place (absolute, A1), message; an Error-level one has the cell's location."""
    place = X.a1(F.col("row_idx"), F.col("col_idx"))
    message = F.format_string("%s!%s: %s (expected %s, found %s)", F.col("sheet"), place, F.col("issue"), F.col("expected"), F.col("actual"))
    return anomalies.select("file", "sheet", "severity", place.alias("place"), message.alias("message"), F.when(F.col("severity") == "Error", place).alias("location"))


def catalog(files: DataFrame, columns: DataFrame) -> DataFrame:
    """Columns (file, sheet, col_idx, col_name, type) of files (file, status) that loaded, blank headers aside, with ``ord`` by place."""
    loaded = files.filter(F.col("status").isin("Success", "PartialSuccess")).select("file")
    rows = columns.join(loaded, "file", "left_semi").filter(F.trim("col_name") != "").withColumn("type", F.coalesce("type", F.lit("Unknown")))
    return numbered(rows, ["file", "sheet", "col_idx"], "ord")


def comparison(cells: DataFrame, hits: DataFrame, name: str | None = None, at: datetime | None = None, header_rows: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of hits (ord, file, sheet, row_idx, col_idx) side by side, and the hits that cannot be taken with the reason.

    Hits of one row are kept as often as they occur. Fewer than two hits make no comparison.
    """
    if len(hits.select("ord").take(2)) < 2:
        raise ValueError("a comparison needs at least two rows")
    name = name or f"Comparison {(at or datetime.now()):%H:%M:%S}"
    sheets = cells.groupBy("file", "sheet").agg(F.max("row_idx").alias("last"))
    both = hits.join(sheets, ["file", "sheet"], "left")
    why = (F.when((F.col("row_idx") < 0) | (F.col("col_idx") < 0), "not a cell").when(F.col("last").isNull(), "no such sheet")
           .when(F.col("row_idx") < header_rows, "a header row").when(F.col("row_idx") > F.col("last"), "beyond the sheet"))
    both = both.withColumn("reason", why)
    good = both.filter("reason IS NULL").select("ord", "file", "sheet", "row_idx")
    rows = good.join(cells, ["file", "sheet", "row_idx"]).withColumn("comparison", F.lit(name))
    return rows, both.filter("reason IS NOT NULL").select("ord", "file", "sheet", "row_idx", "reason")
