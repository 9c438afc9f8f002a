"""Templates: expected columns and rules, and validation of tables against them."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.functions.scalars import currency_code, infer_text

# Severities in order.
SEVERITIES = ("Info", "Warning", "Error", "Critical")


@dataclass(frozen=True)
class Expected:
    name: str
    type: str = "Unknown"
    position: int = -1
    required: bool = True
    alternatives: tuple[str, ...] = ()
    min_confidence: float = 0.8
    currency: str | None = None
    semantic: str | None = None


@dataclass(frozen=True)
class Rule:
    """A check of one column: kind is one of RULES, argument what it needs."""

    column: str
    kind: str
    argument: str = ""


@dataclass(frozen=True)
class Template:
    name: str
    columns: tuple[Expected, ...]
    rules: tuple[Rule, ...] = ()
    min_rows: int | None = None
    max_rows: int | None = None
    allow_extra: bool = True
    sheet: str | None = None
    problems: list[str] = field(default_factory=list, compare=False)

    def validate(self) -> list[str]:
        """What is wrong with the template itself."""
        found = []
        if not self.name.strip():
            found.append("name is empty")
        if not self.columns:
            found.append("no columns")
        names = [c.name.lower() for c in self.columns]
        found += [f"column {n} repeats" for n in sorted({n for n in names if names.count(n) > 1})]
        places = [c.position for c in self.columns if c.position >= 0]
        found += [f"position {p} repeats" for p in sorted({p for p in places if places.count(p) > 1})]
        if self.min_rows is not None and self.max_rows is not None and self.min_rows > self.max_rows:
            found.append("least rows above most rows")
        return found

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> Template:
        raw = json.loads(text)
        columns = tuple(Expected(**(c | {"alternatives": tuple(c["alternatives"])})) for c in raw.pop("columns"))
        return Template(columns=columns, rules=tuple(Rule(**r) for r in raw.pop("rules")), **raw)


def passes(column: Column, kind: str, argument: str = "") -> Column:
    """Whether a value keeps a rule; empty values keep all rules but NotEmpty and Required."""
    text = column.cast("string")
    number = column.try_cast("double")
    empty = text.isNull() | (F.trim(text) == "")
    if kind in ("NotEmpty", "Required"):
        return ~empty
    if kind == "Numeric":
        ok = number.isNotNull()
    elif kind == "Positive":
        ok = number > 0
    elif kind == "NonNegative":
        ok = number >= 0
    elif kind == "InRange":
        low, high = (float(x) if x else None for x in argument.split("|"))
        ok = F.lit(True) if low is None else number >= low
        ok = ok if high is None else ok & (number <= high)
    elif kind == "Pattern":
        ok = text.rlike(argument)
    elif kind == "MinLength":
        ok = F.length(text) >= int(argument)
    elif kind == "MaxLength":
        ok = F.length(text) <= int(argument)
    elif kind == "InList":
        ok = F.lower(text).isin(*[x.strip().lower() for x in argument.split(",")])
    elif kind == "TypeMatch":
        found = infer_text(text)
        ok = F.when(found.isin("Integer", "FloatingPoint"), F.lit(argument in ("Number", "Currency", "Percentage"))).when(found == "DateTime", F.lit(argument == "Date")).otherwise(found == argument)
    elif kind == "Currency":  # the sign or code that the text bears
        ok = F.coalesce(currency_code(text), F.when(text.rlike(r"\b[A-Z]{3}\b"), F.regexp_extract(text, r"\b([A-Z]{3})\b", 1))) == argument.upper()
    elif kind == "DateFormat":
        ok = F.try_to_timestamp(text, F.lit(argument)).isNotNull()
    else:
        raise ValueError(f"rule {kind} is not a row check")
    return F.when(empty, True).otherwise(F.coalesce(ok, F.lit(False)))


def rule_violations(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows that break each rule, counted in one pass: col_name, rule, violations. Unique counts the rows beyond the first of each value in any case."""

    def broken(r: Rule) -> Column:
        if r.kind == "Unique":
            text = F.nullif(F.col(r.column).cast("string"), F.lit(""))
            return F.count(text) - F.countDistinct(F.lower(text))
        return F.sum(F.when(passes(F.col(r.column), r.kind, r.argument), 0).otherwise(1))

    sums = df.agg(*[broken(r).cast("long").alias(f"r{i}") for i, r in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(r.column).alias("col_name"), F.lit(r.kind).alias("rule"), F.coalesce(F.col(f"r{i}"), F.lit(0).cast("long")).alias("violations")) for i, r in enumerate(rules)])
    return sums.select(F.explode(entries).alias("x")).select("x.*")


def duplicates(df: DataFrame, column: str, order: str, keep: int = 5) -> DataFrame:
    """Values that occur more than once in any case, the most frequent first: value (as first seen), n; a report of ``keep``."""
    text = F.col(column).cast("string")
    by = df.filter(text.isNotNull() & (text != "")).groupBy(F.lower(text).alias("_key")).agg(F.count("*").alias("n"), F.min_by(text, order).alias("value"), F.min(order).alias("_first"))
    return by.filter("n > 1").orderBy(F.desc("n"), "_first").limit(keep).select("value", "n")


def not_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of cells with content for each column, in one pass."""
    sums = df.agg(*[F.count(F.when(F.trim(F.col(c).cast("string")) != "", 1)).alias(c) for c in columns])
    return sums.unpivot([], columns, "col_name", "filled")


def expected_frame(catalog: DataFrame, template: Template) -> DataFrame:
    rows = [(i, c.name, c.type, c.position, c.required, [c.name, *c.alternatives]) for i, c in enumerate(template.columns)]
    return catalog.sparkSession.createDataFrame(rows, "ord int, expected string, want string, position int, required boolean, names array<string>")


def structure_issues(catalog: DataFrame, template: Template) -> DataFrame:
    """Issues of (file_name, col_name, col_idx, type) against a template: file_name, column, issue, severity."""
    want = expected_frame(catalog, template)
    names = want.select("ord", "expected", "want", "position", "required", F.explode("names").alias("n")).withColumn("_key", F.lower("n"))
    files = catalog.select("file_name").distinct()
    actual = catalog.select("file_name", "col_name", "col_idx", "type", F.lower("col_name").alias("_key"))
    met = actual.join(names, "_key")
    first = met.groupBy("file_name", "ord").agg(F.min_by(F.struct("col_name", "col_idx", "type", "expected", "want", "position"), "col_idx").alias("m"))
    wrong_place = first.filter("m.position >= 0 AND m.col_idx <> m.position").select("file_name", F.col("m.expected").alias("column"), F.lit("WrongPosition").alias("issue"), F.lit("Warning").alias("severity"))
    wrong_type = first.filter("m.want <> 'Unknown' AND m.type <> m.want").select("file_name", F.col("m.expected").alias("column"), F.lit("TypeMismatch").alias("issue"), F.lit("Error").alias("severity"))
    every = files.crossJoin(want.select("ord", "expected", "required"))  # files by a template's few columns
    gone = every.join(first.select("file_name", "ord"), ["file_name", "ord"], "left_anti").select("file_name", F.col("expected").alias("column"), F.lit("MissingColumn").alias("issue"), F.when(F.col("required"), "Error").otherwise("Warning").alias("severity"))
    out = wrong_place.unionByName(wrong_type).unionByName(gone)
    if not template.allow_extra:
        extra = actual.join(names, "_key", "left_anti").select("file_name", F.col("col_name").alias("column"), F.lit("ExtraColumn").alias("issue"), F.lit("Info").alias("severity"))
        out = out.unionByName(extra)
    return out


def report(issues: DataFrame) -> DataFrame:
    """Totals per file: errors, warnings, infos and status."""
    count = lambda *s: F.count(F.when(F.col("severity").isin(*s), 1))
    out = issues.groupBy("file_name").agg(count("Error", "Critical").alias("errors"), count("Warning").alias("warnings"), count("Info").alias("infos"))
    return out.withColumn("status", F.when(F.col("errors") > 0, "Invalid").when(F.col("warnings") > 0, "ValidWithWarnings").otherwise("Valid"))


def error_summary(issues: DataFrame) -> DataFrame:
    """Issues in all, by severity, and by context, from one scan: severity, context, n."""
    return issues.groupingSets([["severity"], ["file_name"], []], "severity", "file_name").agg(F.count("*").alias("n")).withColumnRenamed("file_name", "context")
