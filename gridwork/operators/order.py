"""Places in an order of all rows, without a task that holds them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that an order is cut into at least, and rows of smallest hash for each that show where.
RANGES, SHOWN = 100, 20


def numbered(df: DataFrame, order: Sequence[Column | str], to: str = "place") -> DataFrame:
    """``df`` with the place (from 0) of each row in an order; rows that are equal in it get any places among themselves.

    Splitters come from the rows whose keys have the smallest hashes, so they
    depend on the rows alone and are the same whenever a part is computed again.
    There are as many ranges as a shuffle has partitions. Rows are numbered within
    their range, and a range's offset is the count of all before it. A table of
    few rows is one range. Splitters are found at the call.
    """
    spark = df.sparkSession
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    keyed = df.withColumn("_key", key)
    shown = keyed.select("_key").orderBy(F.xxhash64("_key")).limit(SHOWN * ranges)
    in_order = shown.groupBy("_key").count().orderBy("_key").select("_key").collect()  # bounded by the number of ranges
    bucket = F.lit(0)
    if len(in_order) >= SHOWN * ranges / 2:
        cuts = in_order[:: max(1, len(in_order) // ranges)][1:]
        table = spark.createDataFrame(cuts, shown.schema).agg(F.sort_array(F.collect_list("_key")).alias("_cuts"))
        keyed = keyed.join(F.broadcast(table))  # one row
        bucket = _at_most("_cuts", len(cuts), F.col("_key"))
    keyed = keyed.withColumn("_range", bucket).drop("_cuts")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = keyed.groupBy("_range").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("_range").orderBy("_key")) - 1
    return keyed.withColumn("_own", own).join(F.broadcast(offsets), "_range").withColumn(to, F.col("_before") + F.col("_own")).drop("_range", "_key", "_own", "_before")


def _at_most(cuts: str, n: int, x: Column) -> Column:
    """How many of n sorted splitters are at most x, by halving."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["a"] + s["b"]) / 2).cast("int")
        right = (s["a"] < s["b"]) & (F.get(F.col(cuts), middle) <= x)
        return F.struct(F.when(right, middle + 1).otherwise(s["a"]).alias("a"), F.when(right | (s["a"] >= s["b"]), s["b"]).otherwise(middle).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("a"), F.lit(n).alias("b")), halve, lambda s: s["a"])
