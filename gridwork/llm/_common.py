"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch. The default of 256 MB would be held by an executor, outside its heap, and its Python workers alike.
BATCH_BYTES = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Where it is unset, a session within one process (master local, as in tests)
    gets a folder of its own; any other one raises, as a folder of one machine
    would lose rows on a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="gridwork-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/gridwork-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; its path goes to ``scratch``.

    This cuts the lineage: a lost executor costs a re-read of files that are
    still there, never a recomputation of the stages before.
    """
    path = fresh_path(df.sparkSession, name)
    if scratch is not None:
        scratch.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def in_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of at most BATCH_BYTES; workers give freed memory back when a partition ends."""
    from gridwork.llm._chunks import settle, trim

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def released(batches):
        settle()
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(released, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
