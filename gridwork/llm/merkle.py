"""Document fingerprints: a Merkle tree over paragraphs and sections, in DataFrame functions alone.

A paragraph is a line with the line ends after it; its digest is the SHA-256 of
its text. A section is a run of paragraphs, ended by a blank line or by a
paragraph whose digest falls on the rule, so an insertion moves no other
section's limits; its digest is the SHA-256 of its paragraphs' digests, and the
root is that of the sections' digests. So equal roots mean equal texts. Each
paragraph also holds short hashes of its pieces (sentences, cut where long), by
which paragraphs that differ are still compared.

Two trees are compared from the root down: equal sections are equal as a
whole, and only what lies below differing ones is looked at. ``likeness`` grades
the common part, ``differing`` locates the edit. Both need nothing but what a
stored fingerprint holds (``parsed`` reads one).

Defined results: a null text counts as empty; an empty text has no paragraph, and
its root is the hash of nothing; likeness is 1 for equal roots, 0 between an empty
and any other text, and below 1 for all other pairs; rows that repeat a doc_id
are documents of their own, in order of their text's hash and text; rows with a
null doc_id come first; with one row, the next document is the row itself; texts
of any length are read whole; an empty table gives no rows; other columns are
left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of the longest piece; hex digits of a digest in a fingerprint.
LONGEST, DIGITS = 32, 16
#: Paragraphs of a section on average, in texts of up to so many paragraphs.
SECTION = ((8, 512), (64, 32_768), (512, None))
#: Names of a list that is searched from its start.
SHORT = 24
#: Documents of a bucket of neighbours, and most limits of buckets.
NEIGHBOURS, MOST_BUCKETS = 1500, 20_000

PIECE = rf"(?<=[.!?\n。])(?![.!?\n。])|(?<=\G.{{{LONGEST}}})"
PARAGRAPH = r"(?<=\n)(?!\n)"


def pieces(text: Column, pattern: str) -> Column:
    """Pieces of a text that join to the text again."""
    return F.filter(F.split(text, pattern), lambda x: x != "")


def tree(text: Column) -> Column:
    """root, and sections: h, n (code points), p (paragraphs: h, n, k: hashes of pieces)."""
    paragraphs = F.transform(pieces(F.coalesce(text, F.lit("")), PARAGRAPH), lambda p: F.struct(
        F.sha2(p, 256).alias("d"), F.length(p).alias("n"), p.endswith("\n\n").alias("ends"),
        F.transform(pieces(p, PIECE), lambda x: F.hash(x)).alias("k")))
    of = lambda p: F.transform(F.array(_ends(p)), lambda e: _sections(p, e))[0]
    sections = F.transform(F.array(paragraphs), of)[0]
    built = lambda s: F.struct(
        F.sha2(F.array_join(F.transform(s, lambda x: x["d"]), ""), 256).alias("root"),
        F.transform(s, lambda x: F.struct(F.left(x["d"], F.lit(DIGITS)).alias("h"), x["n"].alias("n"), x["p"].alias("p"))).alias("s"))
    return F.transform(F.array(sections), built)[0]


def _ends(paragraphs: Column) -> Column:
    """Places (from 1) of the paragraphs that end a section."""
    n = F.size(paragraphs)
    mean = F.lit(SECTION[-1][0])
    for size, most in reversed(SECTION[:-1]):
        mean = F.when(n <= most, size).otherwise(mean)
    marked = F.transform(paragraphs, lambda p, i: F.when(p["ends"] | (i + 1 == n) | (F.pmod(F.xxhash64(p["d"]), mean) == 0), i + 1))
    return F.filter(marked, lambda i: i.isNotNull())


def _sections(paragraphs: Column, to: Column) -> Column:
    since = F.slice(F.concat(F.array(F.lit(0)), to), F.lit(1), F.size(to))

    def one(a: Column, b: Column) -> Column:
        return F.transform(F.array(F.slice(paragraphs, a + 1, b - a)), lambda p: F.struct(
            F.sha2(F.array_join(F.transform(p, lambda x: x["d"]), ""), 256).alias("d"),
            F.aggregate(p, F.lit(0), lambda t, x: t + x["n"]).alias("n"),
            F.transform(p, lambda x: F.struct(F.left(x["d"], F.lit(DIGITS)).alias("h"), x["n"].alias("n"), x["k"].alias("k"))).alias("p")))[0]

    return F.zip_with(since, to, one)


def fingerprint(t: Column) -> Column:
    """A tree as text: the root, then for each section after ``;`` its digest, then for each paragraph after ``,`` digest, length and pieces, all in hex."""
    piece = lambda k: F.lower(F.lpad(F.hex(F.pmod(k.cast("long"), F.lit(2**32))), 8, "0"))
    paragraph = lambda p: F.concat_ws(".", p["h"], F.lower(F.hex(p["n"].cast("long"))), F.array_join(F.transform(p["k"], piece), ""))
    section = lambda s: F.concat_ws(",", s["h"], F.transform(s["p"], paragraph))
    return F.concat_ws(";", t["root"], F.transform(t["s"], section))


def parsed(text: Column) -> Column:
    """The tree that a fingerprint holds."""
    number = lambda x: F.conv(x, 16, 10).cast("long")
    signed = lambda x: F.when(x >= 2**31, x - 2**32).otherwise(x).cast("int")
    hashes = lambda x: F.transform(F.regexp_extract_all(x, F.lit("[0-9a-f]{8}"), F.lit(0)), lambda y: signed(number(y)))
    paragraph = lambda x: F.transform(F.array(F.split(x, r"\.")), lambda f: F.struct(f[0].alias("h"), number(f[1]).cast("int").alias("n"), hashes(f[2]).alias("k")))[0]
    whole = lambda h, p: F.struct(h.alias("h"), F.aggregate(p, F.lit(0), lambda t, x: t + x["n"]).alias("n"), p.alias("p"))
    rest = lambda f: F.transform(F.array(F.transform(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), paragraph)), lambda p: whole(f[0], p))[0]
    section = lambda x: F.transform(F.array(F.split(x, ",")), rest)[0]
    return F.transform(F.array(F.split(text, ";")), lambda f: F.struct(f[0].alias("root"), F.transform(F.slice(f, F.lit(2), F.greatest(F.size(f) - 1, F.lit(0))), section).alias("s")))[0]


def _held(names: Column, name: Column) -> Column:
    """Whether a sorted list holds a name: by halving where it is long, so that texts of many sections take no square of time."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(names) + 1.0)).cast("int"))
    return F.when(F.size(names) <= SHORT, F.array_contains(names, name)).otherwise(F.coalesce(F.get(names, _halved(names, F.size(names), name, steps) - 1) == name, F.lit(False)))


def likeness(a: Column, b: Column) -> Column:
    """Share of pieces that two trees have in common: all of equal sections, and the distinct ones that differing sections share."""
    names = lambda t: F.array_sort(F.transform(t["s"], lambda x: x["h"]))
    n_pieces = lambda s: F.aggregate(s["p"], F.lit(0), lambda t, p: t + F.size(p["k"]))

    def parts(t: Column, other: Column) -> Column:
        equal = F.filter(t["s"], lambda s: _held(other, s["h"]))
        apart = F.filter(t["s"], lambda s: ~_held(other, s["h"]))
        below = F.flatten(F.transform(apart, lambda s: F.flatten(F.transform(s["p"], lambda p: p["k"]))))
        return F.struct(F.aggregate(equal, F.lit(0), lambda n, s: n + n_pieces(s)).alias("n"), F.array_distinct(below).alias("k"))

    def share(x: Column, y: Column) -> Column:
        both = x["n"] + y["n"]
        total = both + F.size(x["k"]) + F.size(y["k"])
        return F.when(total == 0, F.lit(0.0)).otherwise(F.least((both + 2.0 * F.size(F.array_intersect(x["k"], y["k"]))) / total, 1.0 - 1.0 / (1.0 + total)))

    def compare(na: Column, nb: Column) -> Column:
        return F.transform(F.array(parts(a, nb)), lambda x: F.transform(F.array(parts(b, na)), lambda y: share(x, y))[0])[0]

    graded = F.transform(F.array(names(a)), lambda na: F.transform(F.array(names(b)), lambda nb: compare(na, nb))[0])[0]
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(graded)


def _alike(x: Column, y: Column) -> Column:
    """How many leading nodes of two lists have equal digests."""
    at = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p["h"] == q["h"], F.lit(False))), False)
    return F.when(at > 0, at - 1).otherwise(F.size(x)).cast("int")


def _led(x: Column, y: Column) -> Column:
    """Code points of the leading paragraphs that two lists of sections share: down the first branch that differs."""
    chars = lambda nodes, n: F.aggregate(F.slice(nodes, F.lit(1), n), F.lit(0), lambda t, s: t + s["n"])
    none = lambda s: F.coalesce(s["p"], F.array().cast("array<struct<h:string,n:int,k:array<int>>>"))
    below = lambda p, q: chars(p, _alike(p, q))
    return F.transform(F.array(_alike(x, y)), lambda i: chars(x, i) + below(none(F.get(x, i)), none(F.get(y, i))))[0]


def _mirrored(sections: Column) -> Column:
    return F.transform(F.reverse(sections), lambda s: F.struct(s["h"].alias("h"), s["n"].alias("n"), F.reverse(s["p"]).alias("p")))


def differing(a: Column, b: Column) -> Column:
    """begin and end (code points of ``a``, end exclusive) of the branches that differ: before and after them both texts are equal. Null for equal roots."""
    whole = F.aggregate(a["s"], F.lit(0), lambda t, s: t + s["n"])
    other = F.aggregate(b["s"], F.lit(0), lambda t, s: t + s["n"])
    # What leads and what follows may not overlap in either text.
    placed = lambda begin, tail: F.struct(begin.alias("begin"), F.greatest(begin, whole - F.least(tail, other - begin)).alias("end"))
    found = F.transform(F.array(_led(a["s"], b["s"])), lambda begin: placed(begin, _led(_mirrored(a["s"]), _mirrored(b["s"]))))[0]
    return F.when(a["root"] != b["root"], found)


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, tree, next_text, next_tree: each document with the next one by doc_id, after the last the first.

    Ids are cut into ranges of about ``NEIGHBOURS`` documents, and an id that
    fills several of them is cut by hash of text; a range is ordered in one task,
    and the first document of each range also goes to the range before. The
    ranges' limits are the only thing the driver sees: at most MOST_BUCKETS.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    low = F.lit(-(2**63)).cast("long")
    rows = rows.withColumn("_at", F.coalesce("doc_id", low)).withColumn("_h", F.xxhash64("text"))
    n = rows.count()
    buckets = min(MOST_BUCKETS, max(1, n // NEIGHBOURS))
    every = [int(x) for x in rows.approxQuantile("_at", [i / buckets for i in range(1, buckets)], 0.25 / buckets)] if buckets > 1 else []
    limits = sorted(set(every))
    rows = rows.withColumn("_range", F.lit(0)).withColumn("_part", F.lit(0).cast("long"))
    if limits:
        # Text that is folded into one constant, however many limits there are.
        listed = lambda numbers: F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")
        rows = rows.withColumn("_range", _bisect(listed(limits), len(limits), F.col("_at")))
        # An id that is a limit m times gets m parts by hash; the ids after it in its range are a part of their own.
        m = F.get(listed([0, *(every.count(x) for x in limits)]), F.col("_range"))
        part = F.floor((F.col("_h").cast("double") / 2.0**64 + 0.5) * m).cast("long")
        rows = rows.withColumn("_part", F.when((m > 1) & (F.get(listed([0, *limits]), F.col("_range")) == F.col("_at")), F.least(part, m - 1)).when(m > 1, m).otherwise(0))
    rows = rows.withColumn("_bucket", F.struct("_range", "_part")).drop("_range", "_part")
    # The first document of each range, ties by hash of text and then text, and the range before it in use.
    heads = rows.groupBy("_bucket").agg(F.min(F.struct("_at", "_h")).alias("head"))
    around = Window.orderBy("_bucket")  # one row a range
    heads = heads.select("_bucket", "head", F.lag("_bucket").over(around).alias("_before"), F.max("_bucket").over(Window.partitionBy()).alias("_last"))
    heads = heads.select("_bucket", F.col("head._at").alias("_at"), F.col("head._h").alias("_h"), F.coalesce("_before", "_last").alias("_before"), F.col("_before").isNull().alias("_wrap"))
    # One row a range: at most two for each of MOST_BUCKETS limits, some 60 bytes each.
    rows = rows.join(F.broadcast(heads), ["_bucket", "_at", "_h"], "left")
    guest = F.struct(F.col("_before").alias("b"), F.lit(True).alias("guest"))
    home = F.struct(F.col("_bucket").alias("b"), F.lit(False).alias("guest"))
    both = rows.withColumn("_to", F.explode(F.when(F.col("_before").isNull(), F.array(home)).otherwise(F.array(home, guest))))
    # Columns of their own, so that both windows below are of one partitioning and the texts move once.
    both = both.withColumn("_b", F.col("_to.b")).withColumn("_guest", F.col("_to.guest")).drop("_to")
    window = Window.partitionBy("_b").orderBy("_guest", "_at", "_h", "text")
    both = both.withColumn("next_text", F.lead("text").over(window)).withColumn("tree", tree(F.col("text")))
    both = both.withColumn("next_tree", F.lead("tree").over(window)).filter("NOT _guest")
    return both.select("doc_id", "text", "tree", F.coalesce("next_text", "text").alias("next_text"), F.coalesce("next_tree", "tree").alias("next_tree"))


def _bisect(array: Column, n: int, x: Column) -> Column:
    """How many of n sorted limits are at most x."""
    return _halved(array, F.lit(n), x, F.sequence(F.lit(0), F.lit(max(1, n.bit_length()))))


def _halved(array: Column, n: Column, x: Column, steps: Column) -> Column:
    """How many of n sorted values are at most x, by halving."""

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["a"] + state["b"]) / 2).cast("int")
        right = (state["a"] < state["b"]) & (F.get(array, middle) <= x)
        return F.struct(F.when(right, middle + 1).otherwise(state["a"]).alias("a"), F.when(right | (state["a"] >= state["b"]), state["b"]).otherwise(middle).alias("b"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("a"), n.alias("b")), halve, lambda s: s["a"])


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, their likeness and the next text's, and where the edit lies (edit_begin, edit_end; null if nothing changed)."""
    rows = with_next(docs).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), F.expr("left(next_text, cast(floor(length(text) / 4) as int))")))
    rows = rows.withColumn("edited_tree", tree(F.col("edited")))
    mine, theirs = F.col("tree"), F.col("edited_tree")
    rows = rows.withColumn("edit", differing(mine, theirs))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(mine).alias("fingerprint"), fingerprint(theirs).alias("edited_fingerprint"),
        likeness(mine, theirs).alias("near_edited"), likeness(mine, F.col("next_tree")).alias("near_next"),
        F.col("edit.begin").cast("long").alias("edit_begin"), F.col("edit.end").cast("long").alias("edit_end"))
