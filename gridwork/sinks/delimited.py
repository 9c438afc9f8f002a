"""Tables as delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.functions.scalars import csv_guard, display


def shown(df: DataFrame, date_format: str = "yyyy-MM-dd", guard: bool = True) -> DataFrame:
    """All columns as texts: dates by format, booleans as TRUE and FALSE, texts guarded against formulas."""

    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind in ("date", "timestamp", "timestamp_ntz"):
            c = F.date_format(c, date_format)
        elif kind == "boolean":
            c = F.upper(c.cast("string"))
        elif kind == "string" and guard:
            c = csv_guard(c)
        return c.cast("string").alias(name)

    return df.select(*[text(n, t) for n, t in df.dtypes])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", date_format: str = "yyyy-MM-dd", guard: bool = True, names: dict[str, str] | None = None, bom: bool = False) -> None:
    """RFC 4180 files, one per partition, each with a header under ``names``; with ``bom`` a byte order mark comes first."""
    out = shown(df, date_format, guard)
    header = [(names or {}).get(c, c) for c in out.columns]
    if bom and header:
        header[0] = "\ufeff" + header[0]
    out.toDF(*header).write.csv(path, header=True, sep=delimiter, quote='"', escape='"', emptyValue="")


def comparison_table(rows: DataFrame, headers: list[str]) -> DataFrame:
    """Compared cells (ord, file, sheet, row_idx, col_name, tag, value, fmt) as a table: Source File, Sheet, Row (1-based), then the headers with what is shown of each cell."""
    text = display(F.col("tag"), F.col("value"), F.col("fmt"))
    wide = rows.groupBy("ord", "file", "sheet", "row_idx").pivot("col_name", headers).agg(F.first(text))
    return wide.orderBy("ord").select(F.regexp_extract("file", r"([^/\\\\]*)$", 1).alias("Source File"), F.col("sheet").alias("Sheet"), (F.col("row_idx") + 1).alias("Row"), *[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers])
