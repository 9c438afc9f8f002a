"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Each source's documents, in a seeded random order, are cut into blocks. The
mix is a sequence of slots, one block each. In an ideal, fluid mix every source
that still has blocks advances at a rate in proportion to its weight; block i
of a source may not start before the slot in which the fluid mix begins it (its
release) and must be placed by the slot in which the fluid mix ends it (its
deadline). Earliest deadline first over the released blocks then keeps every
source less than one block from the fluid mix at every slot.

Scheduling is sequential, so the slots are cut into frames of a fixed number of
slots, and each frame is scheduled by itself in one row: at a frame's edge every
source has placed the fluid amount rounded up or down (blocks of earliest
deadline are the ones rounded up). Above MOST_SOURCES sources, those without a
weight of their own are dealt into bundles; bundles are mixed like sources, and a
bundle's slots are mixed among its sources in the same way. A source is then
less than one block from its share of the bundle, and the bundle less than one
from its share of the whole. Every document is placed exactly once; when
a source runs out, the others share its rate. Text moves through two exchanges:
one that deals documents to buckets of a source's random order, and the final
range partitioning by place.

Defined results: a null source is the source '' in the plan; sources without a
weight get ``default_weight``; weights must be finite and positive; ties and
repeated rows are ordered by all of doc_id and text and are documents of their
own; an empty table gives no rows; other columns are carried along, but those
named as the results (block, slot, release, deadline, position) are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents in a block, slots in a frame, documents in a bucket of a source's order.
BLOCK, FRAME, BUCKET = 32, 256, 1024
#: A plan has an entry for each source, and each frame looks at all of them. Above so many that takes long; the result is of the same kind.
MOST_SOURCES = 10_000


def weight_of(source: Column, weights: Mapping[str, float], default_weight: float) -> Column:
    if any(not 0 < w < float("inf") for w in [*weights.values(), default_weight]):
        raise ValueError("weights must be finite and positive")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in (pair[0], float(pair[1]))]) if weights else None
    return F.coalesce(known[source], F.lit(float(default_weight))) if known is not None else F.lit(float(default_weight))


def dealt(docs: DataFrame, source: str, seed: int, n_docs: int) -> tuple[DataFrame, DataFrame]:
    """The documents with (_source, _rank): places in the source's random order; and the sources' sizes.

    A source's order is that of a 64-bit hash, so equal ranges of hashes are
    equal buckets. Ranks are counted inside a bucket and bucket totals are
    summed per source: no task sees a whole source.
    """
    buckets = max(1, -(-n_docs // BUCKET))
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    rows = docs.withColumn("_source", F.coalesce(F.col(source).cast("string"), F.lit(""))).withColumn("_key", key)
    rows = rows.withColumn("_bucket", F.floor((F.shiftrightunsigned("_key", 33)) * F.lit(buckets) / F.lit(2**31)).cast("long"))
    return rows, buckets


def fluid(sizes: DataFrame) -> DataFrame:
    """One row a group: the sources' names, block counts and weights, as an array, and the total."""
    one = F.struct(F.col("_source").alias("name"), F.col("blocks").alias("n"), F.col("w").alias("w"))
    return sizes.groupBy("_group").agg(F.sort_array(F.collect_list(one)).alias("s"), F.sum("blocks").alias("total"))  # an entry for each source


def schedule(sizes: DataFrame, weights: Mapping[str, float], default_weight: float, frame: int = FRAME) -> DataFrame:
    """Slots for (_source, blocks), one row per source: name, block (from 1), slot, release, deadline."""
    sizes = sizes.select("_source", "blocks", weight_of(F.col("_source"), weights, default_weight).alias("w"))
    return _slots(sizes.withColumn("_group", F.lit("")), frame).drop("_group")


def _slots(sizes: DataFrame, frame: int) -> DataFrame:
    """Slots of each group (_group, _source, blocks, w): _group, name, block, slot, release, deadline."""
    plan = fluid(sizes)
    # Virtual time v: a source with n blocks and weight w has given min(n, w v). Sources end at n / w.
    ends = F.array_sort(F.array_distinct(F.transform("s", lambda x: x["n"] / x["w"])))
    plan = plan.withColumn("ends", F.concat(F.array(F.lit(0.0)), ends))
    given = lambda v: F.aggregate("s", F.lit(0.0), lambda a, x: a + F.least(x["n"].cast("double"), x["w"] * v))
    plan = plan.withColumn("marks", F.transform("ends", given))  # slots at which the rates change

    def at_slot(t: Column) -> Column:
        """Virtual time at a slot: linear between the marks."""
        k = F.greatest(F.lit(1), F.size(F.filter("marks", lambda m: m < t)))
        a, b = F.element_at("marks", k), F.element_at("marks", F.least(k + 1, F.size("marks")))
        va, vb = F.element_at("ends", k), F.element_at("ends", F.least(k + 1, F.size("ends")))
        return F.when(b > a, va + (vb - va) * (t - a) / (b - a)).otherwise(vb)

    tiny = 1e-7

    def slots_until(t: Column) -> Column:
        """Blocks of each source before slot t: the fluid amount rounded down, and up for those of earliest deadline."""
        v = F.transform(F.array(at_slot(t.cast("double"))), lambda x: x)
        low = F.flatten(F.transform(v, lambda v: F.transform("s", lambda x, i: F.struct(
            F.floor(F.least(x["n"].cast("double"), x["w"] * v) + tiny).alias("n"),
            # the virtual time at which the block under way ends; none under way: last
            F.when(F.abs(F.least(x["n"].cast("double"), x["w"] * v) - F.round(F.least(x["n"].cast("double"), x["w"] * v))) < tiny, F.lit(1e300))
            .otherwise((F.floor(F.least(x["n"].cast("double"), x["w"] * v) + tiny) + 1) / x["w"]).alias("d"), i.alias("i")))))
        return low

    frames = sizes.groupBy("_group").agg(F.floor((F.sum("blocks") - 1) / frame).alias("_last")).filter("_last >= 0")
    frames = frames.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / 4096))))
    frames = frames.select("_group", F.explode(F.sequence(F.col("_k") * 4096, F.least(F.col("_last"), F.col("_k") * 4096 + 4095))).alias("f")).repartition("_group", "f")
    frames = frames.join(F.broadcast(plan), "_group")  # a row
    frames = frames.withColumn("from", F.col("f") * frame).withColumn("to", F.least(F.col("total"), (F.col("f") + 1) * frame))
    for name in ("from", "to"):
        frames = frames.withColumn(f"_{name}", slots_until(F.col(name)))
        short = F.col(name) - F.aggregate(f"_{name}", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        due = lambda x: F.struct(x["d"].alias("d"), x["i"].alias("i"))
        frames = frames.withColumn("_cut", F.get(F.array_sort(F.transform(f"_{name}", due)), (short - 1).cast("int")))  # the last one rounded up; null if none is
        frames = frames.withColumn(f"_{name}", F.transform(f"_{name}", lambda x: x["n"] + F.coalesce(due(x) <= F.col("_cut"), F.lit(False)).cast("long")))
    # Blocks of the frame, with windows in slots: released where the fluid mix begins them, due where it ends them.
    give = lambda v: F.aggregate("s", F.lit(0.0), lambda a, y: a + F.least(y["n"].cast("double"), y["w"] * v))
    blocks = F.flatten(F.transform("s", lambda x, i: F.when(
        F.element_at("_to", i + 1) > F.element_at("_from", i + 1),
        F.transform(F.sequence(F.element_at("_from", i + 1) + 1, F.element_at("_to", i + 1)), lambda b: F.struct(
            F.ceil(give(b / x["w"]) - tiny).alias("deadline"), F.floor(give((b - 1) / x["w"]) + tiny).alias("release"), x["name"].alias("name"), b.alias("block"))),
    ).otherwise(F.array().cast("array<struct<deadline:bigint,release:bigint,name:string,block:bigint>>"))))
    frames = frames.withColumn("blocks", F.array_sort(blocks))
    kind = "array<struct<deadline:bigint,release:bigint,name:string,block:bigint>>"
    start = F.struct(F.col("blocks").alias("left"), F.array().cast(kind).alias("placed"))

    def step(state: Column, t: Column) -> Column:
        # blocks stay sorted by deadline: the first released one is due first; if none is released, the first to be
        ready = F.filter(state["left"], lambda b: b["release"] <= t)
        pick = F.when(F.size(ready) > 0, F.element_at(ready, 1)).otherwise(F.array_min(F.transform(state["left"], lambda b: F.struct(b["release"], b["deadline"], b.alias("b"))))["b"])
        return F.transform(F.array(pick), lambda p: F.struct(
            F.filter(state["left"], lambda b: (b["name"] != p["name"]) | (b["block"] != p["block"])).alias("left"),
            F.concat(state["placed"], F.array(p)).alias("placed")))[0]

    done = F.aggregate(F.sequence(F.col("from"), F.col("to") - 1), start, step, lambda s: s["placed"])
    return frames.select("_group", "from", F.posexplode(done).alias("k", "b")).select(
        "_group", F.col("b.name").alias("name"), F.col("b.block").alias("block"), (F.col("from") + F.col("k")).alias("slot"),
        F.col("b.release").alias("release"), F.col("b.deadline").alias("deadline"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, default_weight: float = 1.0, source: str = "source", block: int = BLOCK, frame: int = FRAME, seed: int = 7) -> DataFrame:
    """Every row and column of ``docs`` with block, slot, release, deadline and position.

    ``position`` is the place in the mix: slots in order, documents of a block in
    the source's random order. A block may be short at its source's end, so
    positions have gaps there and no ties.
    """
    docs = docs.drop(*(c for c in ("block", "slot", "release", "deadline", "position") if c != source))
    n_docs = docs.count()
    rows, _ = dealt(docs, source, seed, n_docs)
    counts = rows.groupBy("_source", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sizes = counts.groupBy("_source").agg(F.ceil(F.sum("_n") / block).alias("blocks"))
    slots = schedule(sizes, weights or {}, default_weight, frame)

    inside = Window.partitionBy("_source", "_bucket").orderBy("_key", "doc_id", "text")
    rows = rows.withColumn("_k", F.row_number().over(inside))
    rows = rows.join(counts.select("_source", "_bucket", "_before"), ["_source", "_bucket"])
    rows = rows.withColumn("_rank", F.col("_before") + F.col("_k") - 1).withColumn("block", F.floor(F.col("_rank") / block) + 1)
    rows = rows.join(slots.withColumnRenamed("name", "_source"), ["_source", "block"])
    rows = rows.withColumn("position", F.col("slot") * block + F.col("_rank") % block)
    return rows.select(*docs.columns, "block", "slot", "release", "deadline", "position")


def mix_report(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """doc_id, source, block, slot, release, deadline, position for every document."""
    slim = docs.select("doc_id", "source", F.xxhash64("text").cast("string").alias("text"))
    return mix(slim, weights).drop("text")


def reordered(docs: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The documents in the order of the mix, with their own columns and ``position``.

    Files that are read again don't keep the order of rows; position does.
    """
    return mix(docs, weights).repartitionByRange("position").sortWithinPartitions("position").select(*(c for c in docs.columns if c != "position"), "position")
