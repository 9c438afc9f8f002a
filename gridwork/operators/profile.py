"""Column profiles: types, confidence, currencies, anomalies, local context, samples.

Cells come as long rows (row_idx, type, ...) of columns that ``by`` names: col_name
within one sheet, and file and sheet before it over many. Ties are broken by
first appearance, that is by the smallest row_idx.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwork.functions.scalars import currency_code

# What an anomaly takes from a column's confidence, and severities in order.
PENALTIES = {"Warning": 0.02, "Error": 0.05, "Critical": 0.10}
SEVERITIES = ("Info", "Warning", "Error", "Critical")
SAMPLE = 100
COLUMN = ("col_name",)


def type_distribution(cells: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """The column, type, n and first_row."""
    return cells.groupBy(*by, "type").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))


def _best():
    """The most frequent type, Unknown and Error aside; the first seen of equal ones; Unknown if there is none."""
    sound = F.when(~F.col("type").isin("Unknown", "Error"), F.struct("n", -F.col("first_row")))
    return F.coalesce(F.max_by("type", sound), F.lit("Unknown"))


def dominant_type(cells: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """The dominant type of each column, and its number of cells."""
    return type_distribution(cells, by).groupBy(*by).agg(_best().alias("dominant"), F.sum("n").alias("total"))


def profile(cells: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """dominant, total, n_dominant, mismatches, errors and confidence within 0 and 1 of each column.

    One aggregate over the cells gives a column's few types; the rest is made of those.
    """
    types = F.collect_list(F.struct("type", "n"))  # at most one entry a type
    out = type_distribution(cells, by).groupBy(*by).agg(_best().alias("dominant"), F.sum("n").alias("total"), types.alias("types"))
    count = lambda test: F.aggregate("types", F.lit(0).cast("long"), lambda t, x: t + F.when(test(x["type"]), x["n"]).otherwise(0))
    out = out.withColumn("n_dominant", count(lambda t: t == F.col("dominant"))).withColumn("errors", count(lambda t: t == "Error"))
    out = out.withColumn("mismatches", count(lambda t: ~t.isin("Unknown", "Error") & (t != F.col("dominant"))))
    raw = F.col("n_dominant") / F.col("total") - F.col("mismatches") * PENALTIES["Error"] - F.col("errors") * PENALTIES["Warning"]
    confidence = F.when(F.col("dominant") == "Unknown", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return out.select(*by, "dominant", "total", "n_dominant", "mismatches", "errors", confidence.alias("confidence"))


def currencies(cells: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """Distinct currencies of each column's formats (``fmt``) in order of first appearance; the first is the column's."""
    seen = cells.withColumn("currency", currency_code(F.col("fmt"))).filter("currency IS NOT NULL").groupBy(*by, "currency").agg(F.min("row_idx").alias("first_row"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_row", "currency"))), lambda x: x["currency"])
    return seen.groupBy(*by).agg(listed.alias("currencies")).withColumn("currency", F.get("currencies", F.lit(0)))


def analyse(cells: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """The whole profile: a Number column with any currency counts as Currency, and its confidence is that of its Currency cells."""
    found = type_distribution(cells, by).groupBy(*by).agg(_best().alias("dominant"), F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("types"))
    out = found.join(currencies(cells, by), list(by), "left")
    out = out.withColumn("type", F.when((F.col("dominant") == "Number") & F.col("currency").isNotNull(), "Currency").otherwise(F.col("dominant")))
    of = lambda t: F.coalesce(F.try_element_at("types", t), F.lit(0).cast("long"))
    errors = of(F.lit("Error"))
    mismatches = F.col("total") - errors - of(F.lit("Unknown")) - F.when(F.col("type") == "Unknown", 0).otherwise(of(F.col("type")))
    raw = of(F.col("type")) / F.col("total") - mismatches * PENALTIES["Error"] - errors * PENALTIES["Warning"]
    confidence = F.when(F.col("type") == "Unknown", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    return out.select(*by, "type", "total", mismatches.alias("mismatches"), errors.alias("errors"), (mismatches + errors).alias("warnings"), confidence.alias("confidence"), "currency", F.coalesce(F.size("currencies"), F.lit(0)).alias("n_currencies"))


def anomalies(cells: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """Cells that are errors, or of another type than their column: row_idx, issue, severity, expected, actual."""
    both = cells.join(dominant_type(cells, by), list(by))
    error = F.col("type") == "Error"
    odd = (F.col("type") != "Unknown") & (F.col("type") != F.col("dominant"))
    return both.filter(error | odd).select(
        *by, "row_idx", F.when(error, "InconsistentFormat").otherwise("TypeMismatch").alias("issue"),
        F.when(error, "Warning").otherwise("Error").alias("severity"), F.col("dominant").alias("expected"), F.col("type").alias("actual"))


def warning_count(issues: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """Anomalies of severity Warning and above, by column."""
    return issues.filter(F.col("severity").isin(*SEVERITIES[1:])).groupBy(*by).agg(F.count("*").alias("warnings"))


def mixed_currencies(cells: DataFrame, by: Sequence[str] = COLUMN) -> DataFrame:
    """Cells whose currency is not their column's most frequent one (the first seen of equal ones): row_idx, currency, expected."""
    seen = cells.filter(F.col("currency").isNotNull()).groupBy(*by, "currency").agg(F.count("*").alias("n"), F.min("row_idx").alias("first_row"))
    best = seen.groupBy(*by).agg(F.max_by("currency", F.struct("n", -F.col("first_row"))).alias("expected"))
    return cells.join(best, list(by)).filter(F.col("currency") != F.col("expected")).select(*by, "row_idx", "currency", "expected")


def local_context(cells: DataFrame, around: int = 3, block: int = 4096, by: Sequence[str] = COLUMN) -> DataFrame:
    """Types of the cells within ``around`` rows of each cell, itself and Unknown aside: how many, and the most frequent of them.

    Columns are cut into blocks of row numbers; a cell near a block's edge also
    goes to the neighbour as a guest. So one exchange moves each cell about once,
    and no column is ordered in one task.
    """
    if block < around:
        raise ValueError("a block is at least as long as the context")
    at = F.floor(F.col("row_idx") / block)
    inside = F.col("row_idx") - at * block
    places = F.filter(F.array(at, F.when(inside < around, at - 1), F.when(inside >= block - around, at + 1)), lambda b: b.isNotNull())
    rows = cells.select(*by, "row_idx", "type", at.alias("_home"), F.explode(places).alias("_block"))
    window = Window.partitionBy(*by, "_block").orderBy("row_idx").rangeBetween(-around, around)
    near = F.collect_list(F.when(F.col("type") != "Unknown", F.struct("row_idx", "type"))).over(window)  # the few cells around
    rows = rows.withColumn("_near", near).filter("_home = _block").withColumn("_near", F.filter("_near", lambda x: x["row_idx"] != F.col("row_idx")))
    kinds = F.array_distinct(F.transform("_near", lambda x: x["type"]))
    scored = F.transform(kinds, lambda k: F.struct(F.size(F.filter("_near", lambda x: x["type"] == k)).alias("n"), (-F.array_min(F.transform(F.filter("_near", lambda x: x["type"] == k), lambda x: x["row_idx"]))).alias("first"), k.alias("type")))
    return rows.select(*by, "row_idx", F.array_max(scored)["type"].alias("local_type"), F.size("_near").cast("long").alias("neighbours"))


def first_sample(cells: DataFrame, header_rows: int = 1, size: int = SAMPLE) -> DataFrame:
    """The first ``size`` data rows: a filter that reaches the scan, no window."""
    return cells.filter((F.col("row_idx") >= header_rows) & (F.col("row_idx") < header_rows + size))


def interning_saving(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bytes that interning would save: 60 for every repeated text."""
    return df.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("v")).filter("v IS NOT NULL").agg(((F.count("v") - F.countDistinct("v")) * 60).alias("bytes_saved"))
