"""Chat formatting with perspective rotation, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once with that
speaker as the assistant and all others as named users; only the assistant's
turns are trained on. System turns stay system turns in every perspective and
are nobody's perspective.

The rendering is one row per perspective and turn, with the turn's place in the
dialogue's text, so a conversation of any length never sits in one row or one
task: turns are numbered inside buckets of neighbouring turns, and bucket
totals, not turns, are summed over a whole conversation. A bucket of more than
CROWD turns, as when all turns have one number, is cut further by turn, role and
the text's first characters, and rows that repeat there are counted once.

What a role or text holds cannot forge a turn: ``<|`` is written ``<||``, ``|>`` in a
name ``||>``, and a line end in a name is a space, so a head or an end mark is
only ever the template's (``<||`` read back as ``<|`` gives the text again).

Defined results: turns are ordered by turn, then role, then text, nulls first;
a null text is empty; a null or blank role is the speaker ``unknown``; rows with
a null conv_id form one conversation; repeated rows are turns of their own; texts
of any length are rendered whole; a conversation of system turns alone has no
participant and gives no rows; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwork.llm._common import written

#: Neighbouring turn numbers that share a bucket, rows above which it is cut, and characters of text by which it is cut.
BUCKET, CROWD, PREFIX = 64, 4096, 4
SYSTEM = "system"


def template(label: Column, name: Column, text: Column) -> tuple[Column, Column, Column]:
    """Head, text and tail of a rendered turn, free of marks that aren't the template's."""
    plain = F.regexp_replace(F.replace(F.replace(name, F.lit("<|"), F.lit("<||")), F.lit("|>"), F.lit("||>")), "[\r\n]", " ")
    named = F.when(name.isNotNull(), F.concat(F.lit(" name="), plain)).otherwise(F.lit(""))
    return F.concat(F.lit("<|"), label, named, F.lit("|>\n")), F.replace(text, F.lit("<|"), F.lit("<||")), F.lit("\n<|end|>\n")


def rotate(turns: DataFrame) -> DataFrame:
    """Render (conv_id, turn, role, text) from every participant's perspective.

    Returns conv_id, perspective, seq (place of the turn, from 0), turn, label
    (assistant, user or system), name (of other speakers), rendered,
    begin and end (code points in the dialogue's text, end exclusive),
    target_begin and target_end (the part to learn, null on other turns), mask (1 on
    the assistant's turns).
    """
    speaker = F.when(F.trim("role") == "", None).otherwise(F.col("role"))
    rows = turns.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(speaker, F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    low = F.lit(-(2**63)).cast("long")
    rows = rows.withColumn("b", F.coalesce(F.floor(F.col("turn") / BUCKET), low)).withColumn("times", F.lit(1).cast("long"))
    crowded = written(rows.groupBy("conv_id", "b").agg(F.count("*").alias("n")).filter(F.col("n") > CROWD).select(F.col("conv_id").alias("c"), F.col("b").alias("cb")), "crowded")
    some = not crowded.isEmpty()
    if some:
        rows = rows.groupBy("conv_id", "turn", "role", "text", "b").agg(F.sum("times").alias("times"))
        rows = rows.join(crowded, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("b") == F.col("cb")), "left")
        cut = F.col("cb").isNotNull()
        rows = rows.withColumn("bucket", F.struct("b", F.when(cut, F.coalesce("turn", low)).otherwise(low).alias("t"), F.when(cut, F.col("role")).otherwise("").alias("r"), F.when(cut, F.left("text", F.lit(PREFIX))).otherwise("").alias("p"))).drop("c", "cb")
    else:
        rows = rows.withColumn("bucket", F.struct("b"))
    people = rows.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("c"), F.col("role").alias("perspective")).distinct()
    # By bucket: no task holds a whole conversation.
    places = rows.select(F.col("conv_id").alias("pc"), F.col("bucket").alias("pb")).distinct()
    people = places.join(people, F.col("pc").eqNullSafe(F.col("c"))).drop("c")
    every = rows.join(people, F.col("conv_id").eqNullSafe(F.col("pc")) & (F.col("bucket") == F.col("pb"))).drop("pc", "pb")

    mine = F.col("role") == F.col("perspective")
    label = F.when(F.col("role") == SYSTEM, SYSTEM).when(mine, "assistant").otherwise("user")
    every = every.withColumn("label", label).withColumn("name", F.when(F.col("label") == "user", F.col("role")))
    head, shown, tail = template(F.col("label"), F.col("name"), F.col("text"))
    every = every.withColumn("head", head).withColumn("rendered", F.concat("head", shown, tail)).withColumn("size", F.length("rendered").cast("long"))

    key = ["conv_id", "perspective"]
    totals = every.groupBy(*key, "bucket").agg(F.sum("times").alias("n"), F.sum(F.col("size") * F.col("times")).alias("chars"))
    before = Window.partitionBy(*key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("bucket").alias("tb"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars0"),
    )
    inside = Window.partitionBy(*key, "bucket").orderBy("turn", "role", "text")
    so_far = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = every.withColumn("k", F.coalesce(F.sum("times").over(so_far), F.lit(0))).withColumn("chars", F.coalesce(F.sum(F.col("size") * F.col("times")).over(so_far), F.lit(0)))
    placed = placed.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("bucket") == F.col("tb")))
    again = F.lit(0).cast("long")
    if some:  # repeated rows become rows again, some at a time
        placed = placed.withColumn("k4096", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 4096))))
        placed = placed.withColumn("again", F.explode(F.sequence(F.col("k4096") * 4096, F.least(F.col("times") - 1, F.col("k4096") * 4096 + 4095))))
        again = F.col("again")
    begin = F.col("chars0") + F.col("chars") + again * F.col("size")
    start = begin + F.length("head")
    target = F.col("label") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("n0") + F.col("k") + again).alias("seq"), "turn", "label", "name", "rendered",
        begin.alias("begin"), (begin + F.col("size")).alias("end"),
        F.when(target, start).alias("target_begin"), F.when(target, begin + F.col("size")).alias("target_end"),
        target.cast("int").alias("mask"),
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN role IS NULL OR trim(role) = '' THEN 'unknown' ELSE role END AS role, coalesce(text, '') AS text
  FROM conversations),
p AS (SELECT DISTINCT conv_id AS c, role AS perspective FROM t WHERE role <> 'system'),
e AS (
  SELECT conv_id, perspective, turn, role, text,
    CASE WHEN role = 'system' THEN 'system' WHEN role = perspective THEN 'assistant' ELSE 'user' END AS label
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c),
r AS (
  SELECT *, CASE WHEN label = 'user' THEN role END AS name,
    '<|' || label || CASE WHEN label = 'user' THEN ' name=' || replace(replace(replace(replace(role, '<|', '<||'), '|>', '||>'), chr(13), ' '), chr(10), ' ') ELSE '' END || '|>' || chr(10) AS head
  FROM e),
s AS (SELECT *, head || replace(text, '<|', '<||') || chr(10) || '<|end|>' || chr(10) AS rendered FROM r),
w AS (
  SELECT *, row_number() OVER o - 1 AS seq, CAST(coalesce(sum(length(rendered)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin_at
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, perspective, seq, turn, label, name, rendered, begin_at AS "begin", begin_at + length(rendered) AS "end",
  CASE WHEN label = 'assistant' THEN begin_at + length(head) END AS target_begin,
  CASE WHEN label = 'assistant' THEN begin_at + length(rendered) END AS target_end,
  CASE WHEN label = 'assistant' THEN 1 ELSE 0 END AS mask
FROM w
"""
