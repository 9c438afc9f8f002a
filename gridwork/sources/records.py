"""What is kept beside the data: templates, load logs, settings, and errors as JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.functions.scalars import a1, a1_column, a1_row, log_filename
from gridwork.operators.template import Template

ERROR = "struct<code:string,severity:string,message:string,context:string,cellReference:string,isRecoverable:boolean>"
LOG = "file string, at timestamp, status string, sheets int, errors array<string>"


def _fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def template_path(folder: str, name: str) -> str:
    """Where a template of a name lies: only letters, digits, blank, ``-`` and ``_`` of the name are kept."""
    clean = re.sub(r"[^\w \-]+", "_", name).strip() or "template"
    return f"{folder.rstrip('/')}/{clean}.json"


def save_template(folder: str, template: Template, overwrite: bool = False) -> str:
    path = template_path(folder, template.name)
    if template_exists(folder, template.name) and not overwrite:
        raise FileExistsError(path)
    store, inner = _fs(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as out:
        out.write(template.to_json().encode())
    return path


def template_exists(folder: str, name: str) -> bool:
    store, inner = _fs(template_path(folder, name))
    return store.get_file_info([inner])[0].is_file


def delete_template(folder: str, name: str) -> bool:
    """Whether there was one."""
    there = template_exists(folder, name)
    if there:
        store, inner = _fs(template_path(folder, name))
        store.delete_file(inner)
    return there


def load_templates(spark: SparkSession, folder: str) -> list[Template]:
    """All templates of a folder by name in any case; files that are no template are skipped."""
    found = []
    for row in spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).toLocalIterator():
        try:
            found.append(Template.from_json(row.value))
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return sorted(found, key=lambda t: t.name.lower())


def error_json(kind: Column, severity: Column, message: Column, context: Column, row: Column, column: Column) -> Column:
    """An error as JSON: FILE, SHEET, CELL or UNKNOWN by what its context begins with; errors below Critical are recoverable."""
    code = (F.when(kind.isin("File", "Sheet", "Cell"), F.upper(kind)).otherwise("UNKNOWN"))
    place = F.when(row.isNotNull() & column.isNotNull(), a1(row, column))
    return F.to_json(F.struct(code.alias("code"), severity.alias("severity"), message.alias("message"), context.alias("context"), place.alias("cellReference"), (severity != "Critical").alias("isRecoverable")))


def error_of(text: Column) -> Column:
    """The fields of ``error_json``, and row and column of its cell; all null where the text is no such JSON."""
    e = F.from_json(text, ERROR)
    place = e["cellReference"]
    return F.struct(e["code"].alias("code"), e["severity"].alias("severity"), e["message"].alias("message"), e["context"].alias("context"), e["isRecoverable"].alias("recoverable"),
                    F.when(place.isNotNull(), a1_row(place)).alias("row"), F.when(place.isNotNull(), a1_column(place)).alias("column"))


def write_logs(logs: DataFrame, folder: str) -> None:
    """Appends load logs (see ``LOG``) as JSON lines; Spark's committer shows a file only when it is whole."""
    logs.withColumn("name", log_filename(F.col("file"), F.col("at"))).write.mode("append").json(folder)


def read_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Load logs, damaged lines aside."""
    return spark.read.schema(f"{LOG}, name string, _damaged string").option("columnNameOfCorruptRecord", "_damaged").json(folder).filter("_damaged IS NULL AND file IS NOT NULL").drop("_damaged")


def log_history(logs: DataFrame, file: str) -> DataFrame:
    """A file's logs, newest first."""
    return logs.filter(F.lower("file") == file.lower()).orderBy(F.desc("at"))


def latest_logs(logs: DataFrame) -> DataFrame:
    """Each file's newest log."""
    return logs.groupBy(F.lower("file").alias("_key")).agg(F.max_by(F.struct("file", "at", "status"), "at").alias("x")).select("x.*")


def kept_logs(logs: DataFrame, days: int, now: Column) -> DataFrame:
    """The logs of the last ``days`` days."""
    return logs.filter(F.col("at") >= now - F.make_dt_interval(days=F.lit(days)))


def without_logs(logs: DataFrame, file: str) -> DataFrame:
    return logs.filter(F.lower("file") != file.lower())


@dataclass
class Settings:
    header_rows: int = 1
    output_folder: str = "exports"
    date_format: str = "yyyy-MM-dd"
    semantic_names: bool = True

    @staticmethod
    def load(text: str | None) -> Settings:
        """Settings from JSON: what is missing, of the wrong type or out of range (header rows 1 to 10, an empty folder) is the default."""
        try:
            raw = json.loads(text) if text else {}
        except ValueError:
            raw = {}
        base = Settings()
        for f in fields(Settings):
            value = raw.get(f.name) if isinstance(raw, dict) else None
            if value is not None and type(value) is type(getattr(base, f.name)):
                setattr(base, f.name, value)
        if not 1 <= base.header_rows <= 10:
            base.header_rows = 1
        if not base.output_folder.strip():
            base.output_folder = "exports"
        return base
