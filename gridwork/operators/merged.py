"""Merged ranges over long cells (row_idx, col_idx, value) and ranges (ord, r0, c0, r1, c1).

``by`` names the sheet that both belong to (file and sheet, over many workbooks).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def covered(cells: DataFrame, ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(row_idx, col_idx) of the cells within a range, with its ord, r0, c0; of overlapping ranges the last wins.

    An index of intervals, not a list of cells: a range is held in the tiles of
    its own size, the powers of two next to its height and width, of which it
    meets four at most, whatever it covers. A cell looks into one tile of each
    size that its sheet has.
    """
    by = list(by)
    power = lambda n: F.ceil(F.log2(n.cast("double"))).cast("int")
    sized = ranges.withColumn("_h", power(F.col("r1") - F.col("r0") + 1)).withColumn("_w", power(F.col("c1") - F.col("c0") + 1))
    tile = lambda c, p: F.expr(f"shiftright(CAST({c} AS BIGINT), {p})")
    held = sized.withColumn("_tr", F.explode(F.sequence(tile("r0", "_h"), tile("r1", "_h")))).withColumn("_tc", F.explode(F.sequence(tile("c0", "_w"), tile("c1", "_w"))))
    sizes = sized.select(*by, "_h", "_w").distinct()  # few a sheet: at most 21 heights by 15 widths
    places = cells.select(*by, "row_idx", "col_idx")
    asked = (places.join(sizes, by) if by else places.join(F.broadcast(sizes))).withColumn("_tr", tile("row_idx", "_h")).withColumn("_tc", tile("col_idx", "_w"))
    met = asked.join(held, [*by, "_h", "_w", "_tr", "_tc"]).filter("row_idx BETWEEN r0 AND r1 AND col_idx BETWEEN c0 AND c1")
    return met.groupBy(*by, "row_idx", "col_idx").agg(F.max(F.struct("ord", "r0", "c0")).alias("m")).select(*by, "row_idx", "col_idx", "m.*")


def resolve(cells: DataFrame, ranges: DataFrame, strategy: str = "expand", by: Sequence[str] = ()) -> DataFrame:
    """Cells with merges resolved: ``expand`` gives all the first one's value, ``keep`` only the first, ``flatten`` the first one all values joined by a blank."""
    by = list(by)
    tagged = cells.join(covered(cells, ranges, by), [*by, "row_idx", "col_idx"], "left")
    first = (F.col("row_idx") == F.col("r0")) & (F.col("col_idx") == F.col("c0"))
    if strategy == "expand":
        corners = ranges.select(*by, "r0", "c0").distinct()
        heads = cells.select(*by, F.col("row_idx").alias("r0"), F.col("col_idx").alias("c0"), F.col("value").alias("_head")).join(corners, [*by, "r0", "c0"], "left_semi")
        out = tagged.join(heads, [*by, "r0", "c0"], "left").withColumn("value", F.when(F.col("ord").isNotNull(), F.col("_head")).otherwise(F.col("value")))
    elif strategy == "keep":
        out = tagged.withColumn("value", F.when(F.col("ord").isNull() | first, F.col("value")))
    elif strategy == "flatten":
        texts = tagged.filter("ord IS NOT NULL").groupBy(*by, "ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "col_idx", "value"))), lambda x: x["value"]), " ").alias("_all"))
        out = tagged.join(texts, [*by, "ord"], "left").withColumn("value", F.when(F.col("ord").isNull(), F.col("value")).when(first, F.col("_all")))
    else:
        raise ValueError(strategy)
    return out.select(*by, "row_idx", "col_idx", "value")


def complexity(ranges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ranges, cells, percent of the bounding box, vertical, horizontal, level and recommended strategy of each sheet.

    A range is vertical if it has more rows than columns, horizontal if it has
    more columns, and a square is neither.
    """
    h, w = F.col("r1") - F.col("r0") + 1, F.col("c1") - F.col("c0") + 1
    out = ranges.groupBy(*by).agg(
        F.count("*").alias("ranges"), F.coalesce(F.sum(h * w), F.lit(0)).alias("cells"), ((F.max("r1") + 1) * (F.max("c1") + 1)).alias("box"),
        F.count(F.when(h > w, 1)).alias("vertical"), F.count(F.when(w > h, 1)).alias("horizontal"))
    out = out.withColumn("percent", F.when(F.col("box") > 0, F.col("cells") / F.col("box")).otherwise(0.0))
    level = F.when((F.col("percent") > 0.2) & (F.col("ranges") >= 5), "Chaos").when(F.col("vertical") > 0, "Complex").otherwise("Simple")
    advice = F.when((level == "Chaos") | (F.col("vertical") > 2 * F.col("horizontal")), "KeepTopLeft").otherwise("ExpandValue")
    return out.select(*by, "ranges", "cells", "percent", "vertical", "horizontal", level.alias("level"), advice.alias("advice"))
