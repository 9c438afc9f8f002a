"""Row comparison: extraction of rows, alignment by header, verdicts per cell, structural warnings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.functions.scalars import intensity
from gridwork.operators.order import numbered


def extract_rows(rows: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Full rows of cell hits; repeated hits of a row give it once."""
    keys = hits.filter(F.col("row_key") >= 0).select(F.col("row_key").alias(key)).distinct()
    return rows.join(keys, key, "left_semi")


def missing_rows(rows: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Hits whose row does not exist."""
    return hits.join(rows.select(F.col(key).alias("row_key")), "row_key", "left_anti")


def header_union(sheets: Sequence[DataFrame]) -> DataFrame:
    """Rows of several sheets under the union of their headers; what a sheet lacks is null."""
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def first_filled(*columns: Column) -> Column:
    """The first value of a header group that is not empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def value_frequency(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Trimmed values that are not empty, by group: value and count."""
    v = F.trim("value")
    return cells.withColumn("value", v).filter(v != "").groupBy(*by, "value").agg(F.count("*").alias("freq"))


def verdicts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Verdict of each cell within its group (one comparison and column): verdict, freq, total, intensity.

    Empty among others is Missing; all empty, or one value, is Match; otherwise
    Different, more intense the rarer the value. Groups are compared by
    aggregates that are joined back, never gathered.
    """
    by = list(by)
    cells = cells.withColumn("value", F.coalesce(F.trim("value"), F.lit("")))
    counts = cells.groupBy(*by, "value").agg(F.count("*").alias("freq"))
    totals = counts.groupBy(*by).agg(F.sum("freq").alias("rows"), F.count(F.when(F.col("value") != "", 1)).alias("groups"), F.sum(F.when(F.col("value") != "", F.col("freq"))).alias("filled"))
    # A value's rank is its place among all values, less that of its group's first: no task orders all values, and none those of one group or frequency.
    placed = numbered(counts.filter("value <> ''"), [*by, -F.col("freq"), "value"], "_place")
    first = placed.groupBy(*by).agg(F.min("_place").alias("_first"))
    ranks = placed.join(first, by).select(*by, "value", (F.col("_place") - F.col("_first")).alias("rank"))
    stats = counts.join(totals, by).join(ranks, [*by, "value"], "left")
    out = cells.join(stats, [*by, "value"])
    filled, groups = F.coalesce("filled", F.lit(0)), F.coalesce("groups", F.lit(0))
    empty = F.col("value") == ""
    verdict = F.when(empty & (filled > 0), "Missing").when(groups <= 1, "Match").otherwise("Different")
    return out.withColumn("verdict", verdict).select(
        *cells.columns, "verdict",
        F.when(verdict == "Missing", 0).when(empty, F.col("rows")).when(verdict == "Match", filled).otherwise(F.col("freq")).alias("freq"),
        F.when(empty & (filled == 0), F.col("rows")).otherwise(filled).alias("total"),
        F.when(verdict == "Missing", 0.5).when(verdict == "Match", 0.0).otherwise(intensity(F.col("rank"), groups)).alias("intensity"))


def structural_warnings(catalog: DataFrame) -> DataFrame:
    """Headers that files lack or have elsewhere, from (file_name, col_name, col_idx): col_name, issue, files.

    A header's own place is its place in the union of headers, by first
    appearance over files in order of name.
    """
    first = catalog.groupBy("col_name").agg(F.min(F.struct("file_name", "col_idx")).alias("f"))
    order = numbered(first, ["f"]).select("col_name", "place")
    n = catalog.agg(F.countDistinct("file_name").alias("n_files"))
    seen = catalog.groupBy("col_name").agg(F.countDistinct("file_name").alias("have"))
    missing = seen.join(F.broadcast(n)).filter("have < n_files").select("col_name", F.lit("Missing").alias("issue"), (F.col("n_files") - F.col("have")).alias("files"))
    moved = catalog.join(order, "col_name").filter("col_idx <> place").groupBy("col_name").agg(F.countDistinct("file_name").alias("files"))
    return missing.unionByName(moved.select("col_name", F.lit("Position").alias("issue"), "files"))


def comparisons_without(comparisons: DataFrame, file_name: str) -> DataFrame:
    """Comparisons after a file is removed; those with fewer than two rows left go."""
    left = comparisons.filter(F.col("file_name") != file_name)
    enough = left.groupBy("comparison_id").agg(F.count("*").alias("n")).filter("n >= 2").select("comparison_id")
    return left.join(enough, "comparison_id", "left_semi")
