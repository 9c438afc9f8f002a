"""Loads that read only what is new: a ledger of files by content, with versions that appear as a whole or not at all.

A store has a folder of data for each load and a folder of commits. A load
compares the files there are with those of the last version, by path, length and time;
only of files that differ in these is the content hashed (SHA-256), and only
files whose hash is new are read. What was read is written to a data folder of
its own, and then the version's commit is created, which fails if someone else's
is there. Data without a commit is never seen, so a load that dies before it
leaves the last version as it was; ``swept`` removes what such loads left.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.sources.files import load

FILES = "file string, length long, modified timestamp, hash string, status string, sheets long, version long"


class Conflict(RuntimeError):
    """Another load has committed this version."""


class Ledger:
    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.store).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *names: str):
        return self._hadoop.Path("/".join([self.store, *names]))

    def versions(self) -> list[tuple[int, str]]:
        """(version, data folder) of each commit, the oldest first."""
        place = self._path("commits")
        if not self._fs.exists(place):
            return []
        found = []
        for status in self._fs.listStatus(place):
            name = status.getPath().getName()
            if name.endswith(".json") and not name.startswith((".", "_")):
                text = self.spark.read.text(status.getPath().toString(), wholetext=True).first().value
                found.append((int(name[:-5]), json.loads(text)["data"]))
        return sorted(found)

    def _commit(self, version: int, data: str) -> None:
        try:
            out = self._fs.create(self._path("commits", f"{version:020d}.json"), False)
        except Exception as e:  # the store says that it is there
            raise Conflict(f"version {version}") from e
        out.write(bytearray(json.dumps({"data": data}).encode()))
        out.close()

    def _read(self, table: str, schema: str | None = None) -> DataFrame | None:
        paths = [f"{self.store}/data/{data}/{table}" for _, data in self.versions()]
        return self.spark.read.parquet(*paths) if paths else None

    def files(self) -> DataFrame:
        """The files of the last version, each as its last load saw it."""
        rows = self._read("files")
        if rows is None:
            return self.spark.createDataFrame([], FILES)
        last = rows.groupBy("file").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "file"]), "version").alias("x")).select("file", "x.*")
        return last.filter("status <> 'Removed'").select(*[c.split()[0] for c in FILES.split(", ")])

    def _rows(self, table: str) -> DataFrame | None:
        """Rows of the files of the last version, each from the load that read the content it has now."""
        rows = self._read(table)
        return None if rows is None else rows.join(self.files().select("file", F.col("hash").alias("_now")), "file").filter("hash = _now").drop("_now", "hash").dropDuplicates()

    def cells(self) -> DataFrame | None:
        return self._rows("cells")

    def errors(self) -> DataFrame | None:
        return self._rows("errors")

    def load(self, folder: str) -> dict[str, int]:
        """Brings the store to what the folder holds: numbers of files read, met again under another time or place, and removed."""
        spark, before = self.spark, self.files()
        version = max([v for v, _ in self.versions()], default=-1) + 1
        listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        there = listing.load(folder).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))
        known = before.select("file", "length", "modified")
        changed = [r.file for r in there.join(known, ["file", "length", "modified"], "left_anti").select("file").collect()]  # names of new files
        gone = before.join(there.select("file"), "file", "left_anti")
        n_gone = gone.count()
        if not changed and not n_gone:
            return {"read": 0, "met": 0, "removed": 0}
        data = f"v{version}-{uuid.uuid4().hex}"
        place = lambda t: f"{self.store}/data/{data}/{t}"
        out = gone.withColumn("status", F.lit("Removed")).withColumn("version", F.lit(version).cast("long"))
        met = new = 0
        if changed:
            hashed = listing.load(_exactly(changed)).select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"))
            hashed.write.parquet(place("hashes"))
            hashed = spark.read.parquet(place("hashes"))
            same = hashed.join(before.select("file", "hash", "status", "sheets"), ["file", "hash"])
            fresh = hashed.join(before.select("file", "hash"), ["file", "hash"], "left_anti")
            names = [r.file for r in fresh.select("file").collect()]
            met, new = same.count(), len(names)
            out = out.unionByName(same.withColumn("version", F.lit(version).cast("long")))
            if names:
                cells, errors, status = load(spark, _exactly(names))
                own = fresh.select("file", "hash")
                cells.join(F.broadcast(own) if new < 10_000 else own, "file").write.parquet(place("cells"))
                errors.join(own, "file").write.parquet(place("errors"))
                out = out.unionByName(fresh.join(status, "file").withColumn("version", F.lit(version).cast("long")).select(*out.columns))
        out.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in FILES.split(", ")]).write.parquet(place("files"))
        for table, schema in (("cells", None), ("errors", None)):
            if not self._fs.exists(self._path("data", data, table)):  # a version without new content has empty tables
                empty = load(spark, folder)[0 if table == "cells" else 1].limit(0).withColumn("hash", F.lit("").cast("string"))
                empty.write.parquet(place(table))
        self._commit(version, data)
        return {"read": new, "met": met, "removed": n_gone}

    def swept(self) -> int:
        """Removes the data of loads that have no commit; how many there were. Not while a load runs."""
        kept, n = {data for _, data in self.versions()}, 0
        if self._fs.exists(self._path("data")):
            for status in self._fs.listStatus(self._path("data")):
                if status.getPath().getName() not in kept:
                    self._fs.delete(status.getPath(), True)
                    n += 1
        return n


def _exactly(files: list[str]) -> list[str]:
    """Paths that mean these files alone, whatever marks of patterns their names have."""
    return ["".join("\\" + c if c in "{}[]*?\\" else c for c in f) for f in files]
