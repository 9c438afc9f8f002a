"""Column links: physical columns that mean the same under names that differ in case or blanks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.operators.order import numbered


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def column_links(catalog: DataFrame) -> DataFrame:
    """Groups of (col_name, type, file_name, ord) by name: semantic_name, dominant, columns, sources, case_variants, type_variants, warning."""
    named = catalog.withColumn("_key", name_key(F.col("col_name")))
    by_type = named.groupBy("_key", "type").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    best = by_type.groupBy("_key").agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("dominant"), F.array_sort(F.collect_set("type")).alias("types"))
    links = named.groupBy("_key").agg(
        F.min_by("col_name", "ord").alias("semantic_name"), F.count("*").alias("columns"), F.countDistinct(F.lower("file_name")).alias("sources"),
        F.array_sort(F.collect_set("col_name")).alias("_names"))
    out = links.join(best, "_key")
    case_note = F.when(F.size("_names") > 1, F.concat(F.lit("case: "), F.array_join(F.slice("_names", 1, 3), ", ")))
    type_note = F.when(F.size("types") > 1, F.concat(F.lit("types: "), F.array_join("types", ", ")))
    return out.select(
        "semantic_name", "dominant", "columns", "sources", F.size("_names").alias("case_variants"), F.size("types").alias("type_variants"),
        F.nullif(F.concat_ws("; ", case_note, type_note), F.lit("")).alias("warning"))


def merge_links(catalog: DataFrame, target: str, source: str) -> DataFrame:
    """The catalog with the group of ``source`` counted under the name of ``target``."""
    key = name_key(F.col("col_name"))
    return catalog.withColumn("link", F.when(key == source.strip().lower(), target).otherwise(F.col("col_name")))


def ungroup(links: DataFrame, members: str = "members") -> DataFrame:
    """One row per member of each link."""
    return links.select("*", F.explode(members).alias("member")).drop(members)


def semantic_lookup(headers: DataFrame, links: DataFrame) -> DataFrame:
    """headers (header) with the semantic name of the first link (ord) that has it as name or member, else the header itself."""
    names = links.select("semantic_name", "ord", F.explode(F.array_union(F.array("semantic_name"), F.col("members"))).alias("name"))
    best = names.groupBy(name_key(F.col("name")).alias("_key")).agg(F.min_by("semantic_name", "ord").alias("semantic_name"))
    out = headers.withColumn("_key", name_key(F.col("header"))).join(best, "_key", "left")
    return out.select("header", F.coalesce("semantic_name", "header").alias("semantic_name"))


def header_groups(headers: DataFrame, included: Sequence[str] | None = None) -> DataFrame:
    """(header, display, ord) grouped by display name in any case, in order of first appearance: display, headers, place."""
    if included is not None:
        headers = headers.filter(F.lower("header").isin(*[x.lower() for x in included]))
    rows = headers.groupBy(F.lower("display").alias("_key")).agg(F.min_by("display", "ord").alias("display"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "header"))), lambda x: x["header"]), "|").alias("headers"), F.min("ord").alias("place"))
    return rows.drop("_key")


def invert_selection(catalog: DataFrame) -> DataFrame:
    return catalog.withColumn("included", ~F.col("included"))


def links_by_name(links: DataFrame) -> DataFrame:
    """Links in order of their semantic name in capitals, so that ``_`` follows the letters, then as written, with their place."""
    return numbered(links, [F.upper("semantic_name"), "semantic_name"])


def merge_groups(members: DataFrame, target: str, sources: Sequence[str]) -> DataFrame:
    """(link, col_name, type, ord) after links are merged: the members of ``sources`` go to ``target``, whose name stays."""
    return members.withColumn("link", F.when(F.lower("link").isin(*[s.lower() for s in sources]), target).otherwise(F.col("link")))


def rename_link(members: DataFrame, old: str, new: str) -> DataFrame:
    return members.withColumn("link", F.when(F.lower("link") == old.lower(), new).otherwise(F.col("link")))


def add_member(members: DataFrame, columns: DataFrame, link: str) -> DataFrame:
    """The members of (link, col_name, type, ord), and the columns (col_name, type, ord) under ``link`` unless they are members already."""
    new = columns.select(F.lit(link).alias("link"), "col_name", "type", "ord")
    return members.unionByName(new.join(members.filter(F.lower("link") == link.lower()).select("ord"), "ord", "left_anti"))


def remove_member(members: DataFrame, link: str, col_name: str) -> DataFrame:
    """A member leaves its link and is a link of its own, under its own name."""
    leaves = (F.lower("link") == link.lower()) & (F.col("col_name") == col_name)
    return members.withColumn("link", F.when(leaves, F.col("col_name")).otherwise(F.col("link")))


def group_types(members: DataFrame) -> DataFrame:
    """Dominant type and size of each link, from its members: the most frequent type, the first one of equals."""
    by = members.groupBy("link", "type").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return by.groupBy("link").agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("dominant"), F.sum("n").alias("columns"))


def resolve_headers(headers: DataFrame, names: Mapping[str, str] | Callable[[Column], Column] | None = None) -> DataFrame:
    """headers (header) with ``semantic_name``: by a dictionary (exact names), by a function of the column, or none at all; else the header itself."""
    header = F.col("header")
    if names is None:
        found = F.lit(None).cast("string")
    elif callable(names):
        found = names(header)
    else:
        rows = [(k, v) for k, v in names.items()]
        if not rows:
            return headers.withColumn("semantic_name", header)
        found = F.create_map(*[F.lit(x) for pair in rows for x in pair])[header]
    return headers.withColumn("semantic_name", F.coalesce(found, header))


def semantic_names(columns: DataFrame, links: DataFrame) -> DataFrame:
    """(file_name, col_name, semantic_name) of the columns that a link renames; a name that differs in case alone is none."""
    found = semantic_lookup(columns.select(F.col("col_name").alias("header")).distinct(), links)
    both = columns.join(found.withColumnRenamed("header", "col_name"), "col_name")
    return both.filter(F.lower("semantic_name") != F.lower("col_name")).select("file_name", "col_name", "semantic_name")


def highlighted(columns: DataFrame, template_columns: Sequence[str], source_file: str) -> DataFrame:
    """The columns (file_name, col_name) with whether a template that came from ``source_file`` has them."""
    names = [c.lower() for c in template_columns]
    return columns.withColumn("highlighted", F.lower("col_name").isin(*names) & (F.lower("file_name") == source_file.lower()))


def included_names(catalog: DataFrame) -> DataFrame:
    """Included columns with the name they go by: the semantic one, else their own."""
    return catalog.filter("included").select("col_name", F.coalesce("semantic_name", "col_name").alias("shown"))


def select_all(catalog: DataFrame, included: bool = True) -> DataFrame:
    return catalog.withColumn("included", F.lit(included))
