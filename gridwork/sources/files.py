"""Files of several formats in one load: dispatch by extension, errors as rows, a status for each file."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.functions.scalars import csv_guard, csv_number, csv_number_format, infer_text
from gridwork.operators.sheet import load_status, with_headers
from gridwork.sources.delimited import read_texts
from gridwork.sources.xls import read_xls
from gridwork.sources.xlsx import read_workbooks

# The extensions that are read.
WORKBOOKS, OLD_WORKBOOKS, TEXTS = ("xlsx", "xlsm", "xltx", "xltm"), ("xls", "xlt"), ("csv",)
CELLS = ("file", "sheet", "sheet_idx", "row_idx", "col_idx", "value", "tag", "fmt")
#: Bytes of files, as they are stored, whose cells a task holds.
TASK_BYTES = 4 * 2**20


def kind_of(path: str) -> str | None:
    """How a file is read by its extension, in any case; None if it isn't."""
    if not path or not path.strip():
        raise ValueError("a path is needed")
    end = path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return "workbook" if end in WORKBOOKS else "old workbook" if end in OLD_WORKBOOKS else "text" if end in TEXTS else None


def text_cells(rows: DataFrame) -> DataFrame:
    """Cells of ``read_texts``: sheet Data, numbers with the format that they suggest, texts guarded against formulas."""
    fmt = F.when(F.col("row_idx") > 0, csv_number_format(F.col("value")))
    number = F.when(fmt.isNotNull(), csv_number(F.col("value")).cast("string"))
    return rows.filter("kind = 'cell'").select(
        "file", F.lit("Data").alias("sheet"), F.lit(0).alias("sheet_idx"), "row_idx", "col_idx", F.coalesce(number, csv_guard(F.col("value"))).alias("value"),
        F.when(number.isNotNull(), "FloatingPoint").when(F.col("row_idx") == 0, "Text").otherwise(infer_text(F.col("value"))).alias("tag"), fmt.alias("fmt"))


def load(spark: SparkSession, folder: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All files under a folder, or of a list: cells with column names, errors (file, severity, message), and files with their status.

    Workbooks are read in one scan, old workbooks and texts in one each. A file
    of another format is Failed, as is one that no reader says anything about, and
    one broken file fails no other. The cells are dealt to as many tasks as the
    files' bytes ask for, so a task's share doesn't grow with the folder.
    """
    known = (*WORKBOOKS, *OLD_WORKBOOKS, *TEXTS)
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # Scans pass over files without a byte; the index of the folder has their names, too.
    listed = there.select(F.col("path").alias("file")).union(spark.createDataFrame([(re.sub("^file:///", "file:/", unquote(f)),) for f in there.inputFiles()], "file string")).distinct()
    end = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    unknown = listed.filter(~end.isin(*known)).select("file", F.lit("Critical").alias("severity"), F.lit("only these are read: " + ", ".join(known)).alias("message"))
    old, texts = read_xls(spark, folder), read_texts(spark, folder)
    typed = F.when((F.col("kind") == "cell") & (F.col("tag") == "Text") & (F.col("row_idx") > 0), infer_text(F.col("value"))).otherwise(F.col("tag"))
    rows = read_workbooks(spark, folder).unionByName(old.withColumn("tag", typed))
    tasks = max(1, -(-(there.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    cells = with_headers(rows.filter("kind = 'cell'").select(*CELLS).unionByName(text_cells(texts)), tasks=tasks).drop("header_row")
    errors = unknown.unionByName(rows.filter("kind = 'error'").select("file", "severity", F.col("value").alias("message")))
    errors = errors.unionByName(texts.filter("kind IN ('error', 'broken')").select("file", F.when(F.col("kind") == "broken", "Critical").otherwise("Info").alias("severity"), F.col("value").alias("message")))
    sheets = rows.filter("kind = 'sheet'").select("file", "sheet").unionByName(texts.filter("kind = 'sheet'").select("file", F.lit("Data").alias("sheet")))
    files = listed.join(sheets.groupBy("file").agg(F.countDistinct("sheet").alias("sheets")), "file", "left").na.fill(0)
    silent = files.filter("sheets = 0").join(errors.select("file"), "file", "left_anti").select("file", F.lit("Critical").alias("severity"), F.lit("nothing was read").alias("message"))
    errors = errors.unionByName(silent)
    return cells, errors, load_status(files, errors)
