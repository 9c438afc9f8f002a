"""How five document filters interact: what each removes in every order of application.

A document's failures are five bits. A table of 32 by 120 holds, for each set of
failures and each order of the filters, the step that removes the document, so
no filter is ever run again: one pass over the texts finds the bits, documents
are counted by part, bits and labels, and inside ``mapInArrow`` the table turns
these counts into removals by part, order and step, which np.bincount adds up.
Tasks give partial arrays, which Spark sums.

Filters (words are maximal runs of ``[^\\x20\\x09-\\x0D]``, case counts):
A  under 200 words
B  100 * distinct words < 50 * words
C  100 * [A-Z] characters > 2 * code points
D  holds any of # $ % & * |
E  identical to the text of any smaller doc_id, of all the table

No group of copies meets in one task: the smallest id of a text is an aggregate,
and each row asks by its own (text, id) whether it is that one. A part, however
large, is at most 128 counts before the table is asked.

Defined results: a null text counts as empty, a null source as the empty string;
a row with a null id is never E and makes none; rows that repeat an id and a text
are each counted, and none of them is E for the other; several labels of a
document count as one that has each mark any of them has; a document without labels has
none; texts of any length are read whole; an empty table gives no rows; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, permutations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwork.llm._chunks import segments, slices
from gridwork.llm._common import in_batches, removed, written

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Filter A's least words; B's and C's shares in percent; D's characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 2, b"#$%&*|"
#: Parts whose arrays a task holds at a time.
PARTS_HELD = 64
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def first_failures():
    """Step (0 to 4, or 5 for none) at which each set of failures is removed in each order: 32 by 120."""
    import numpy as np

    place = np.array([[order.index(f) for f in FILTERS] for order in ORDERS])
    bits = np.arange(32)[:, None] >> np.arange(5) & 1
    return np.where(bits[:, None, :] == 1, place[None], 5).min(axis=2)


def counts_of(texts: pa.Array):
    """Words, code points, capitals and symbols of each text."""
    import numpy as np

    raw = texts.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    start = ~gap
    start[1:] &= gap[:-1]
    begins = ends[:-1][ends[1:] > ends[:-1]]
    start[begins] = ~gap[begins]

    def each(marks):
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return total[ends[1:]] - total[ends[:-1]]

    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    return each(start), each((data & 0xC0) != 0x80), each((data >= 65) & (data <= 90)), each(symbol[data])


def distinct_words(text: bytes) -> int:
    """Distinct words of a text, a piece at a time."""
    known: set[bytes] = set()
    for piece in segments(text, _GAP):
        known.update(piece.split())  # of bytes: at exactly these six characters
    return len(known)


def flagged(docs: DataFrame, part: str = "source") -> DataFrame:
    """doc_id, part, bits (of A to D) and key (a digest of the text) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.sha2("text", 256)))
    names = ["doc_id", "part", "bits", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in slices(batches, "text"):
            words, points, capitals, symbols = counts_of(batch.column(2))
            bits = (words < LEAST_WORDS) + 4 * (100 * capitals > MOST_CAPITALS * points) + 8 * (symbols > 0)
            # A set is needed only where there is more than one word.
            for i in np.flatnonzero(words > 1):
                if 100 * distinct_words(batch.column(2)[i].as_buffer().to_pybytes()) < LEAST_DISTINCT * words[i]:
                    bits[i] += 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.int32()), batch.column(3)], names)

    return in_batches(rows, run, "doc_id long, part string, bits int, key binary")


def cells_of(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """part, bits (of A to E), good, toxic and n: how many documents have them. At most 128 rows a part."""
    scratch: list[str] = []
    rows = written(flagged(docs, part), "flags", scratch)
    first = rows.filter("doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    again = F.col("doc_id").isNotNull() & F.col("first").isNull()
    both = rows.join(marks, "doc_id", "left").join(first, ["key", "doc_id"], "left")
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    cells = both.groupBy("part", (F.col("bits") + F.when(again, 16).otherwise(0)).alias("bits"), mark("good"), mark("toxic")).agg(F.count("*").alias("n"))
    cells = written(cells, "cells")
    removed(docs.sparkSession, scratch)
    return cells


def by_order(cells: DataFrame) -> DataFrame:
    """part, filter_order, step and ``MEASURES`` of every part and order, from counts (see ``cells_of``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = first_failures()
        letter = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])  # filter at each step
        places = np.arange(len(ORDERS))

        def arrays(parts: list[str], p, bits, good, toxic, n) -> pa.RecordBatch:
            size = len(parts)
            at = ((p[:, None] * len(ORDERS) + places) * 6 + table[bits]).ravel()

            def removals(weight):
                found = np.bincount(at, np.repeat(weight, len(ORDERS)), size * len(ORDERS) * 6)
                return found.reshape(size, len(ORDERS), 6)[:, :, :5]

            by_filter = lambda hit: np.stack([np.bincount(p, n * hit(f), size) for f in range(5)], 1)
            gone, total = removals(n), np.bincount(p, n, size)
            fails, only = by_filter(lambda f: bits >> f & 1), by_filter(lambda f: bits == 1 << f)
            share = np.stack([gone[:, letter == f].sum(axis=1) for f in range(5)], 1)
            found = (total[:, None, None] - gone.cumsum(axis=2), gone, fails[:, letter] - gone, only[:, letter], removals(n * good), removals(n * toxic), share[:, letter])
            each = len(ORDERS) * 5
            named = [pa.array(np.repeat(np.array(parts, object), each), pa.string()), pa.array(np.tile(np.repeat(np.array(ORDERS, object), 5), size), pa.string()), pa.array(np.tile(np.arange(1, 6, dtype=np.int32), size * len(ORDERS)))]
            return pa.RecordBatch.from_arrays([*named, *(pa.array(np.rint(x).astype(np.int64).ravel()) for x in found)], ["part", "filter_order", "step", *MEASURES])

        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns))
            groups = [(k, list(g)) for k, g in groupby(rows, lambda r: r[0])]  # rows come sorted by part
            for a in range(0, len(groups), PARTS_HELD):
                some = groups[a : a + PARTS_HELD]
                p = np.repeat(np.arange(len(some)), [len(g) for _, g in some])
                bits, good, toxic, n = np.array([r[1:] for _, g in some for r in g], np.int64).T
                yield arrays([k for k, _ in some], p, bits, good, toxic, n.astype(np.float64))

    ordered = cells.select("part", "bits", "good", "toxic", "n").repartition("part").sortWithinPartitions("part")
    partial = in_batches(ordered, run, f"part string, filter_order string, step int, {', '.join(f'{m} long' for m in MEASURES)}")
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(m).alias(m) for m in MEASURES])


def filter_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part (source), order of the filters and step."""
    return by_order(cells_of(docs, labels))


ORACLE = """
WITH marked AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM marked GROUP BY text),
marks AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
worded AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words FROM marked),
failing AS (
  SELECT w.doc_id, part, coalesce(m.good, false) AS good, coalesce(m.toxic, false) AS toxic,
    len(words) < 200 AS fa, 100 * len(list_distinct(words)) < 50 * len(words) AS fb,
    100 * length(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 2 * length(w.text) AS fc,
    regexp_matches(w.text, '[#$%&*|]') AS fd, coalesce(w.doc_id > f.first_id, false) AS fe
  FROM worded w JOIN firsts f ON f.text = w.text LEFT JOIN marks m ON m.doc_id = w.doc_id),
cells AS (
  SELECT part, concat(CASE WHEN fa THEN 'A' ELSE '' END, CASE WHEN fb THEN 'B' ELSE '' END, CASE WHEN fc THEN 'C' ELSE '' END,
    CASE WHEN fd THEN 'D' ELSE '' END, CASE WHEN fe THEN 'E' ELSE '' END) AS failed, good, toxic, count(*) AS n
  FROM failing GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
steps AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
gone AS (
  SELECT part, failed, good, toxic, n, filter_order,
    (SELECT min(s.step) FROM steps s WHERE s.filter_order = o.filter_order AND contains(c.failed, s.f)) AS gone_at
  FROM cells c, orders o),
counted AS (
  SELECT g.part, s.filter_order, s.step, s.f,
    sum(CASE WHEN gone_at IS NULL OR gone_at > s.step THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN gone_at = s.step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone_at < s.step AND contains(failed, s.f) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = s.f THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN gone_at = s.step AND good THEN n ELSE 0 END) AS good_lost,
    sum(CASE WHEN gone_at = s.step AND toxic THEN n ELSE 0 END) AS toxic_lost
  FROM gone g JOIN steps s ON s.filter_order = g.filter_order GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""
