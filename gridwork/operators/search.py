"""Search over cells, and what is made of its hits."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwork.functions.scalars import rc
from gridwork.operators.order import numbered


@dataclass(frozen=True)
class Options:
    """How texts match: a regular expression, else exactly, else by containing."""

    case_sensitive: bool = False
    exact: bool = False
    regex: bool = False


def valid_regex(pattern: str) -> bool:
    """Whether Java compiles the pattern; asked on the driver, before any job."""
    from pyspark import SparkContext

    context = SparkContext._active_spark_context
    try:
        if context is not None and context._jvm is not None:
            context._jvm.java.util.regex.Pattern.compile(pattern)
        else:
            re.compile(pattern)
    except Exception:
        return False
    return True


def matches(text: Column, query: str, options: Options = Options()) -> Column:
    """The predicate; an invalid expression falls back to containing it in any case."""
    if options.regex and valid_regex(query):
        return text.rlike(query if options.case_sensitive else f"(?iu){query}")
    if options.regex:
        return F.lower(text).contains(query.lower())
    if options.exact:
        return text == query if options.case_sensitive else F.lower(text) == query.lower()
    return text.contains(query) if options.case_sensitive else F.lower(text).contains(query.lower())


def search_sheet(df: DataFrame, query: str, options: Options = Options(), key: str | None = None, columns: Sequence[str] | None = None,
                 file_name: str = "", sheet_name: str = "Data", all_columns: Sequence[str] | None = None) -> DataFrame:
    """Hits of one typed table: file_name, sheet_name, row_key, col_idx, col_name, value, row_header.

    ``columns`` are searched (None: all, empty: none) and chosen before cells are
    made, so the scan reads no other. Rows without any hit are dropped
    before cells are made.
    """
    names = list(all_columns or df.columns)
    key = key or names[0]
    wanted = [c for c in names if columns is None or c.lower() in {x.lower() for x in columns}]
    if not query.strip():
        wanted = []
    texts = {c: F.col(c).cast("string") for c in wanted}
    base = df.select(F.col(key).alias("row_key"), F.col(names[0]).cast("string").alias("_header"), *[t.alias(f"c_{c}") for c, t in texts.items()])
    if not wanted:
        none = F.lit(None).cast("string")
        return base.filter(F.lit(False)).select(F.lit(file_name).alias("file_name"), F.lit(sheet_name).alias("sheet_name"), "row_key", F.lit(0).alias("col_idx"), none.alias("col_name"), none.alias("value"), none.alias("row_header"))
    hit = [matches(F.col(f"c_{c}"), query, options) for c in wanted]
    any_hit = hit[0]
    for h in hit[1:]:
        any_hit = any_hit | h
    cells = F.filter(F.array(*[F.when(h, F.struct(F.lit(names.index(c)).alias("col_idx"), F.lit(c).alias("col_name"), F.col(f"c_{c}").alias("value"))) for c, h in zip(wanted, hit)]), lambda x: x.isNotNull())
    out = base.filter(any_hit).select("row_key", "_header", F.explode(cells).alias("x"))
    return out.select(
        F.lit(file_name).alias("file_name"), F.lit(sheet_name).alias("sheet_name"), "row_key", "x.col_idx", "x.col_name", "x.value",
        F.when(F.col("x.col_idx") > 0, F.col("_header")).alias("row_header"))


def search_files(tables: dict[str, DataFrame], query: str, options: Options = Options(), columns: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Hits over several tables, with a hit for each file name and sheet name that matches (row_key and col_idx -1)."""
    parts = []
    for name, df in tables.items():
        wanted = (columns or {}).get(name, [c for c, t in df.dtypes if t == "string"])
        hits = search_sheet(df, query, options, columns=wanted, file_name=name)
        parts.append(hits.select("file_name", "sheet_name", F.col("row_key").cast("long").alias("row_key"), "col_idx", "col_name", "value"))
    spark = next(iter(tables.values())).sparkSession
    # All names in one relation of constants.
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("file_name"), F.lit("Data").alias("sheet_name"), F.lit(-1).cast("long").alias("row_key"), F.lit(-1).alias("col_idx"), F.lit(k).alias("col_name"), F.lit(v).alias("value")) for n in tables for k, v in (("FileName", n), ("SheetName", "Data"))]))
    out = spark.range(1).select(names.alias("x")).select("x.*").filter(matches(F.col("value"), query, options))
    for p in parts:
        out = out.unionByName(p)
    return out


def coordinates(hits: DataFrame) -> DataFrame:
    """Hits with their cell coordinates as text."""
    return hits.withColumn("coordinates", rc(F.col("row_key"), F.col("col_idx")))


def comparable(hits: DataFrame) -> DataFrame:
    """Only cell hits can be compared."""
    return hits.filter((F.col("row_key") >= 0) & (F.col("col_idx") >= 0))


def group_by_value(hits: DataFrame, total_files: int) -> DataFrame:
    """Hits by value in any case: number of hits, of files, and whether every loaded file has it."""
    return hits.groupBy(F.lower("value").alias("value")).agg(F.count("*").alias("hits"), F.countDistinct("file_name").alias("files")).withColumn("found_in_all", F.col("files") == total_files)


def capped_history(hits: DataFrame, by: Sequence[str], order: Sequence[str], cap: int = 100) -> DataFrame:
    """The first ``cap`` hits of each group, with the group's true total.

    The rank is limited where it is computed, so Spark keeps only ``cap`` rows of
    a group on each task before the exchange; totals come from their own aggregate.
    """
    totals = hits.groupBy(*by).agg(F.count("*").alias("total"))
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= cap)
    return first.join(totals, list(by))


def recent_queries(history: DataFrame, query: str, at: str, keep: int = 5) -> DataFrame:
    """The last ``keep`` distinct queries in any case, newest first."""
    last = history.groupBy(F.lower(query).alias("query")).agg(F.max(at).alias("at"))
    return last.orderBy(F.desc("at"), "query").limit(keep)


def suggestions(df: DataFrame, column: str, order: str, query: str, around: int = 10, keep: int = 10) -> DataFrame:
    """Fragments of ``around`` characters about the first match in a value, distinct in any case, the first ``keep``."""
    if len(query.strip()) < 2:
        return df.select(F.lit("").alias("fragment")).filter(F.lit(False))
    at = F.locate(query.lower(), F.lower(F.col(column)))
    start = F.greatest(at - around, F.lit(1))
    end = F.least(at + len(query) + around, F.length(column) + 1)
    fragment = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(F.col(column), start, end - start), F.when(end <= F.length(column), "...").otherwise(""))
    found = df.filter(at > 0).select(fragment.alias("fragment"), F.col(order).alias("_order"))
    first = found.groupBy(F.lower("fragment").alias("_key")).agg(F.min_by("fragment", "_order").alias("fragment"), F.min("_order").alias("_order"))
    return first.orderBy("_order").limit(keep).select("fragment")


def suggestions_of_sheets(cells: DataFrame, query: str, around: int = 10, keep: int = 10) -> DataFrame:
    """Suggestions over (file_name, sheet_name, value, ord): file names, then sheet names, then fragments of values, distinct in any case, the first ``keep``."""
    if len(query.strip()) < 2:
        return cells.select(F.col("value").alias("suggestion")).filter(F.lit(False))
    named = lambda c, k: cells.filter(F.lower(c).contains(query.lower())).groupBy(F.lower(c).alias("_key")).agg(F.min_by(F.col(c), "ord").alias("suggestion"), F.struct(F.lit(k).alias("k"), F.min("ord").alias("ord")).alias("_order"))
    low = F.locate(query.lower(), F.lower("value"))
    begin, end = F.greatest(low - around, F.lit(1)), F.least(low + len(query) + around, F.length("value") + 1)
    fragment = F.concat(F.when(begin > 1, "...").otherwise(""), F.substring(F.col("value"), begin, end - begin), F.when(end <= F.length("value"), "...").otherwise(""))
    found = cells.filter(low > 0).select(fragment.alias("suggestion"), "ord").groupBy(F.lower("suggestion").alias("_key")).agg(F.min_by("suggestion", "ord").alias("suggestion"), F.struct(F.lit(2).alias("k"), F.min("ord").alias("ord")).alias("_order"))
    every = named("file_name", 0).unionByName(named("sheet_name", 1)).unionByName(found)
    first = every.groupBy("_key").agg(F.min_by("suggestion", "_order").alias("suggestion"), F.min("_order").alias("_order"))
    return first.orderBy("_order").limit(keep).select("suggestion")


def without_file(hits: DataFrame, file_name: str) -> DataFrame:
    return hits.filter(F.col("file_name") != file_name)


def group_tree(hits: DataFrame) -> DataFrame:
    """Hits by value in any case, file and sheet: the leaves of the result tree."""
    return hits.groupBy(F.lower("value").alias("value"), "file_name", "sheet_name").agg(F.count("*").alias("hits"))


def groups_in_order(groups: DataFrame) -> DataFrame:
    """Groups of ``group_by_value`` with their place: those that not every file has first, then by value as a dictionary has it (accents and case aside, ``_`` before letters)."""
    return numbered(groups, ["found_in_all", F.collate("value", "UNICODE"), "value"])


def distinct_lists(hits: DataFrame) -> DataFrame:
    """The files and the terms (any case) that occur, each list in order and joined by commas."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return hits.agg(joined(F.col("file_name")).alias("files"), joined(F.lower("value")).alias("terms"))
