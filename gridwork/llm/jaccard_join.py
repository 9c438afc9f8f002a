"""N-gram Jaccard join with rare-first prefix filtering.

A document's set is its distinct shingles of ``WORDS`` lower-cased words. Two
documents link when the sets' Jaccard similarity is at least 80 %. The plan:

1. One pass takes each set's size and digest and adds every shingle to a
   count sketch of fixed width over all documents. Documents of equal sets form
   a class; the smallest id represents it.
2. A second pass sorts each set rarest first (by the sketch) and gives out its
   prefix: of a set of n shingles, the n - ceil(0.8 n) + 1 rarest. Linked sets
   share a shingle of both prefixes.
3. Prefix shingles that two classes share are the only meeting places. First
   every document meets one leader per place: the one with the commonest
   prefix, which is mostly the same one at all places that near copies share. Where these links already join all documents of a place there is
   nothing left to find for the classes; elsewhere the pairs of documents that
   are not joined yet are taken, and at crowded places only those that
   share enough of their differences from the leader. Pairs pass the length
   and positional filters, each pair once.
4. Signatures, counts over parts of the hash range, bound the overlap of each
   candidate pair from above. What is left is verified on the whole sets: the
   suffix filter bounds the overlap by halving, then the intersection is counted. Classes are the connected
   components of the links.

The sketch never counts too little, so it tells which shingles may be in many
documents: those meet by aggregation and join (which Spark splits), the others
by a window whose groups the sketch bounds.

Defined results: a null text, and one without words, has an empty set, is
linked with nothing and is a class of its own; fewer words than ``WORDS`` make one
shingle; ids are taken as they are, and rows that repeat an id are one
document whose set is that of each row (rows with equal ids and different texts
are joined as if linked); a null doc_id is a document of its own; an empty
table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwork.llm._chunks import slices
from gridwork.llm._common import in_batches, removed, written

WORDS, PERCENT = 5, 80
#: The sketch has a cell for so many bytes of text, within limits: log2 of its least and greatest width, and of its pieces' width.
#: A task counts in 4 bytes a cell, the driver gets one byte a cell. Wider input makes counts coarser: more candidates, the same result.
CELL_BYTES, LEAST_BITS, MOST_BITS, PIECE_BITS = 256, 16, 24, 14
#: A shingle whose count may be above this meets by join, not in one window.
LIGHT = 2000
#: Places that more unsettled documents share are settled by differences from the leader, others pair by pair.
CROWD = 48
#: Parts of a set's signature.
SIGNATURE = 128
#: Bytes of text hashed at a time (the arrays take some fifty times that), and pairs compared at a time.
SLICE_BYTES, PAIRS = 500_000, 256
#: Ids of documents to verify are broadcast up to this number (8 bytes each), else joined.
BROADCAST_IDS = 2_000_000

_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x):
    """Finalise 64-bit hashes (uint64 arrays)."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list = []


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, up to n."""
    import numpy as np

    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n + 1, 1 << 16)
        with np.errstate(over="ignore"):
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[:] = [np.cumprod(up), np.cumprod(down)]
    return _POWERS


def shingles(texts: list[bytes]):
    """For each text its distinct shingles as hashes, sorted (uint64 arrays).

    A word's hash is a polynomial over its bytes, read off one running sum over
    the joined texts; a shingle's hash is made of its words' hashes in order.
    """
    import numpy as np

    blob = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lower = blob + ((blob >= 65) & (blob <= 90)).astype(np.uint8) * 32
    space = (blob == 32) | ((blob >= 9) & (blob <= 13))
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begin = np.flatnonzero(edge == -1)
    end = np.flatnonzero(edge == 1)[: len(begin)]
    up, down = _powers(len(blob))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower.astype(np.uint64) + np.uint64(1)) * up[: len(blob)])])
        words = _mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
        limits = np.cumsum([len(t) + 1 for t in texts])
        first = np.searchsorted(begin, np.concatenate([[0], limits]))
        # Positions from which WORDS words follow in the same text.
        if len(words) >= WORDS:
            joined = np.zeros(len(words) - WORDS + 1, np.uint64)
            for i in range(WORDS):
                joined = _mix(joined * np.uint64(_BASE) + words[i : len(words) - WORDS + 1 + i])
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= WORDS:
                out.append(np.unique(joined[a : b - WORDS + 1]))
            elif b > a:
                one = np.zeros(1, np.uint64)
                for w in words[a:b]:
                    one = _mix(one * np.uint64(_BASE) + w)
                out.append(one + np.uint64(b - a))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed(n):
    """Least overlap with any set that a set of n needs: ceil(0.8 n)."""
    return -(-n * PERCENT // 100)


def prefix_size(n):
    return n - needed(n) + 1


def overlap(nx, ny):
    """Least overlap of linked sets of nx and ny: 100 o >= 80 (nx + ny - o), rounded up."""
    return -(-PERCENT * (nx + ny) // (100 + PERCENT))


def ordered(found, ranks):
    """Shingles as signed order keys, rarest first: the sketch's rank in the top byte, the hash below."""
    import numpy as np

    low = found & np.uint64((1 << 56) - 1)
    rank = ranks[(low & np.uint64(len(ranks) - 1)).astype(np.int64)].astype(np.uint64)
    return np.sort((rank << np.uint64(56)) | low).view(np.int64)


def signature(found) -> bytes:
    """How many of a set's shingles fall into each of SIGNATURE parts of the hash range, in as few bytes as hold them."""
    import numpy as np

    counts = np.bincount((found >> np.uint64(40)).astype(np.int64) & (SIGNATURE - 1), minlength=SIGNATURE)
    top = int(counts.max())
    return counts.astype("u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def counted(raw: bytes):
    import numpy as np

    return np.frombuffer(raw, {1: "u1", 2: "<u2", 4: "<u4"}[len(raw) // SIGNATURE]).astype(np.int64)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, PAIRS at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, PAIRS):
            yield batch.slice(a, PAIRS)


def _possible(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures allow a link: sets overlap by at most the sum of the lesser counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in parts(batches):
            kept = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = counted(x), counted(y)
                kept.append(int(np.minimum(x, y).sum()) >= overlap(int(x.sum()), int(y.sum())))
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    held = signatures.join(_ids(pairs), "doc", "left_semi").distinct()
    both = (pairs.join(held.select(F.col("doc").alias("b"), F.col("sig").alias("y")), "b")
            .join(held.select(F.col("doc").alias("a"), F.col("sig").alias("x")), "a").select("a", "b", "x", "y"))
    return in_batches(both, run, "a long, b long").distinct()


def _ids(pairs: DataFrame) -> DataFrame:
    """The documents in pairs, broadcast if they are few."""
    ids = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _bits(docs: DataFrame) -> int:
    """log2 of the sketch's width for the texts' bytes."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // CELL_BYTES).bit_length()))


def _statistics(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds: a document's n, digest and signature (row 0), or a task's piece of the sketch (row 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        counts = np.zeros(1 << bits, np.uint32)
        names = ["row", "doc", "n", "k1", "k2", "piece", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingles([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            cells, n = np.unique((every & np.uint64((1 << bits) - 1)).astype(np.int64), return_counts=True)
            counts[cells] += n.astype(np.uint32)
            with np.errstate(over="ignore"):
                k1 = [int(s.sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
                k2 = [int(_mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0 for s in sets]
            m = len(sets)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([0] * m, batch.column(0).to_pylist(), [len(s) for s in sets], k1, k2, [None] * m, [signature(s) if len(s) else None for s in sets]), kinds)], names)
        if counts.any():
            width = 1 << PIECE_BITS
            import zstandard

            pieces = [zstandard.compress(counts[i : i + width].astype("<u8").tobytes(), 1) for i in range(0, len(counts), width)]
            m = len(pieces)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([1] * m, [None] * m, [0] * m, [0] * m, [0] * m, list(range(m)), pieces), kinds)], names)

    return in_batches(docs, run, "row long, doc long, n long, k1 long, k2 long, piece int, counts binary")


def _sketch(pieces: DataFrame, bits: int):
    """Ranks (uint8 array, a byte a cell) by the counts over all documents, from the tasks' pieces."""
    import numpy as np
    import zstandard

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _added(batches)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(held), pa.int32()), "counts": pa.array([zstandard.compress(x.tobytes(), 1) for x in held.values()], pa.binary())})

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _added(batches)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(list(held), pa.int32()), "ranks": pa.array([rank_of(x).tobytes() for x in held.values()], pa.binary())})

    # One row per task and piece becomes one per task, then one per piece: the driver gets a byte a cell, once.
    whole = in_batches(in_batches(pieces, add, "piece int, counts binary").repartition("piece"), ranked, "piece int, ranks binary")
    ranks = np.zeros(1 << bits, np.uint8)
    for row in whole.toLocalIterator():
        ranks[row.piece << PIECE_BITS : (row.piece + 1) << PIECE_BITS] = np.frombuffer(row.ranks, np.uint8)
    return ranks


def _added(batches: Iterator[pa.RecordBatch]) -> dict:
    import numpy as np
    import zstandard

    held: dict = {}
    for batch in batches:
        for piece, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found = np.frombuffer(zstandard.decompress(raw), np.uint64)
            held[piece] = held[piece] + found if piece in held else found
    return held


def rank_of(counts):
    """Counts on a logarithmic scale, one byte each; 7 bits keep order keys positive."""
    import numpy as np

    return np.minimum(127, np.rint(4 * np.log2(1.0 + counts))).astype(np.uint8)


def _prefixes(docs: DataFrame, held) -> DataFrame:
    """doc, n, keys (binary, the prefix's order keys) for each document with a set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingles([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            rows = []
            for d, s in zip(batch.column(0).to_pylist(), sets):
                if len(s) and d is not None:
                    keys = ordered(s, ranks)[: prefix_size(len(s))]
                    rows.append((d, len(s), keys.tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()))], ["doc", "n", "keys"])

    return in_batches(docs, run, "doc long, n int, keys binary")


def _entries(prefixes: DataFrame) -> DataFrame:
    """One row per prefix shingle: key, doc, n, pos, and how rare the whole prefix is (smaller is commoner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for part in parts(batches):
            keys = [np.frombuffer(k, np.int64) for k in part.column(2).to_pylist()]
            sizes = np.array([len(k) for k in keys])
            begin = np.repeat(np.cumsum(sizes) - sizes, sizes)
            rare = np.array([-int((k >> 56).mean() * 16) for k in keys], np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(keys)), pa.array(np.repeat(part.column(0).to_numpy(), sizes)),
                pa.array(np.repeat(part.column(1).to_numpy(), sizes)), pa.array((np.arange(sizes.sum()) - begin).astype(np.int32)),
                pa.array(np.repeat(rare, sizes)),
            ], ["key", "doc", "n", "pos", "rare"])

    return in_batches(prefixes, run, "key long, doc long, n int, pos int, rare int")


def _sets(docs: DataFrame, held) -> DataFrame:
    """doc, keys (binary): whole sets in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = held.value
        for batch in slices(batches, "text", SLICE_BYTES):
            sets = shingles([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([ordered(s, ranks).tobytes() for s in sets], pa.binary())], ["doc", "keys"])

    return in_batches(docs, run, "doc long, keys binary")


def suffix_allows(x, y, allowed: int, depth: int = 2) -> bool:
    """Whether sorted sets may differ in at most ``allowed`` elements: halves must, too, by their sizes."""
    if abs(len(x) - len(y)) > allowed:
        return False
    if not depth or len(y) < 8:
        return True
    middle = len(y) // 2
    cut = int(x.searchsorted(y[middle]))
    left, right = abs(cut - middle), abs((len(x) - cut) - (len(y) - middle))
    if left + right > allowed:
        return False
    return suffix_allows(x[:cut], y[:middle], allowed - right, depth - 1) and suffix_allows(x[cut:], y[middle:], allowed - left, depth - 1)


def linked(x, y) -> bool:
    """Whether two whole sets (sorted int64 arrays) link."""
    import numpy as np

    least = overlap(len(x), len(y))
    if not suffix_allows(x, y, len(x) + len(y) - 2 * least):
        return False
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= least


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in parts(batches):
            kept = [linked(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.filter(pa.array(kept, pa.bool_())).select(["a", "b"])

    both = (pairs.join(sets.select(F.col("doc").alias("b"), F.col("keys").alias("y")), "b")
            .join(sets.select(F.col("doc").alias("a"), F.col("keys").alias("x")), "a").select("a", "b", "x", "y"))
    return in_batches(both, run, "a long, b long").distinct()


def _by_difference(crowd: DataFrame, sets: DataFrame, scratch: list[str]) -> DataFrame:
    """Candidate pairs (a, b) among documents that share a leader at a crowded place: crowd is (a: leader, b: document, root).

    With X and Y the symmetric differences of x and y from their leader L, x
    and y differ in |X| + |Y| - 2 |X and Y| elements; linked, they differ in at
    most (nx + ny) / 9. A pair that is not joined yet has a member, say y, that is
    not linked with L: |Y| > (nL + ny) / 9. So X and Y share more than
    (|X| + (nL - nx) / 9) / 2 elements, at least one of which is in the first
    |X| minus so many, plus one, of X. The order takes what x has beyond L first,
    which few others have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        names = ["lead", "el", "doc", "n", "root", "pos", "size", "first", "far"]
        for batch in parts(batches):
            out = []
            for lead, doc, root, raw_l, raw_x in zip(*(batch.column(i).to_pylist() for i in range(5))):
                l, x = np.frombuffer(raw_l, np.int64), np.frombuffer(raw_x, np.int64)
                added = x[~np.isin(x, l, assume_unique=True)]
                removed = l[~np.isin(l, x, assume_unique=True)]
                d = np.concatenate([added, removed])
                far = len(x) - len(added) < overlap(len(x), len(l))
                shared = int((9 * len(d) + len(l) - len(x)) // 18) + 1
                half = max(0, len(d) - shared + 1)
                kept = len(d) if far else half
                if kept:
                    out.append([np.full(kept, lead), d[:kept], np.full(kept, doc), np.full(kept, len(x), np.int32), np.full(kept, root), np.arange(kept, dtype=np.int32), np.full(kept, len(d), np.int32), np.arange(kept) < half, np.full(kept, far)])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names)

    both = (crowd.join(sets.select(F.col("doc").alias("b"), F.col("keys").alias("x")), "b")
            .join(sets.select(F.col("doc").alias("a"), F.col("keys").alias("l")), "a").select("a", "b", "root", "l", "x"))
    rows = written(in_batches(both, run, "lead long, el long, doc long, n int, root long, pos int, size int, first boolean, far boolean"), "differences", scratch)
    own = ("doc", "n", "root", "pos", "size")
    x = rows.filter("first").select("lead", "el", *(F.col(c).alias(f"{c}_x") for c in own))
    y = rows.filter("far").select("lead", "el", *(F.col(c).alias(f"{c}_y") for c in own))
    nx, ny = F.col("n_x"), F.col("n_y")
    differ = nx + ny - 2 * F.ceil(F.lit(PERCENT) * (nx + ny) / F.lit(100.0 + PERCENT) - 1e-9)
    most = F.least("pos_x", "pos_y") + 1 + F.least(F.col("size_x") - F.col("pos_x") - 1, F.col("size_y") - F.col("pos_y") - 1)
    close = (F.lit(100) * F.least(nx, ny) >= F.lit(PERCENT) * F.greatest(nx, ny)) & (2 * most >= F.col("size_x") + F.col("size_y") - differ)
    return x.join(y, ["lead", "el"]).filter((F.col("root_x") != F.col("root_y")) & close).select(F.least("doc_x", "doc_y").alias("a"), F.greatest("doc_x", "doc_y").alias("b"))


def _passes(nx, ny, i, j):
    """Length and positional filters for sets that share the shingles at places i and j."""
    least = F.ceil(F.lit(PERCENT) * (nx + ny) / F.lit(100.0 + PERCENT) - 1e-9)
    most = F.least(i, j) + 1 + F.least(nx - i - 1, ny - j - 1)
    return (F.lit(100) * F.least(nx, ny) >= F.lit(PERCENT) * F.greatest(nx, ny)) & (most >= least)


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the links (a, b).

    Each round ties all neighbours of a node to the smallest of them, first the
    larger ones, then the smaller: paths shrink by half, stars stay stars. Rounds
    go on until nothing changes; each is written out, and so are the smallest
    neighbours, so that the join of a node with very many can be split.
    """
    spark = links.sparkSession
    scratch: list[str] = []
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges", scratch)
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least", scratch)
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", scratch)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least", scratch)
        small = large.join(least, "u")
        edges = written(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "edges", scratch)
        removed(spark, scratch[:-1])
        scratch = scratch[-1:]
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the smallest id of an equal set) for every row of (doc_id, text)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
    scratch: list[str] = []  # tables that the result doesn't read
    bits = _bits(rows)
    found = written(_statistics(rows, bits), "statistics")
    held = spark.sparkContext.broadcast(_sketch(found.filter("row = 1").select("piece", "counts"), bits))
    sizes = found.filter("row = 0").select("doc", "n", "k1", "k2")
    solo = sizes.filter("n > 0 AND doc IS NOT NULL")
    repeats = not solo.groupBy("doc").count().filter("count > 1").isEmpty()
    # Written, so that the join of a class of very many copies can be split.
    classes = written(solo.groupBy("n", "k1", "k2").agg(F.min("doc").alias("rep")), "classes", scratch)
    member = solo.join(classes, ["n", "k1", "k2"]).select("doc", "n", "rep")
    member = written(member.distinct() if repeats else member, "members")
    reps = member.filter("doc = rep").select("doc", F.col("n").cast("int").alias("m")).distinct()

    prefixes = _prefixes(rows, held).join(reps, "doc").filter("n = m").select("doc", "n", "keys")
    entries = _entries(prefixes)
    light = F.shiftright("key", 56) <= int(rank_of(LIGHT)) - 1
    window = Window.partitionBy("key")
    first = F.struct("rare", "n", "doc", "pos")
    near = entries.filter(light).withColumn("c", F.count("*").over(window)).filter("c > 1").withColumn("lead", F.min(first).over(window)).drop("c")
    heads = entries.filter(~light).groupBy("key").agg(F.count("*").alias("c"), F.min(first).alias("lead")).filter("c > 1").drop("c")
    places = written(near.unionByName(entries.filter(~light).join(heads, "key")).filter("n IS NOT NULL"), "places", scratch)

    leads = places.filter((F.col("doc") != F.col("lead.doc")) & _passes(F.col("n"), F.col("lead.n"), F.col("pos"), F.col("lead.pos")))
    stars = written(leads.select(F.least("doc", "lead.doc").alias("a"), F.greatest("doc", "lead.doc").alias("b")).distinct(), "stars", scratch)
    signatures = found.filter("row = 0 AND n > 0").select("doc", F.col("counts").alias("sig"))
    likely = written(_possible(stars, signatures), "likely", scratch)
    first_links = written(_verified(likely, _sets_of(rows, likely, held, repeats, scratch)), "links", scratch)
    roots = components(first_links.unionByName(_repeats(member)))

    # Places whose documents are not all joined yet.
    named = places.join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    open_keys = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("c")).filter("r0 <> r1").select("key", "c")
    named = written(named.join(open_keys, "key").select("key", "doc", "n", "pos", "root", F.col("lead.doc").alias("lead"), "c"), "open", scratch)
    few = named.filter(F.col("c") <= CROWD)
    left = few.select("key", *(F.col(c).alias(f"{c}_a") for c in ("doc", "n", "pos", "root")))
    right = few.select("key", *(F.col(c).alias(f"{c}_b") for c in ("doc", "n", "pos", "root")))
    more = left.join(right, "key").filter((F.col("doc_a") < F.col("doc_b")) & (F.col("root_a") != F.col("root_b")) & _passes(F.col("n_a"), F.col("n_b"), F.col("pos_a"), F.col("pos_b")))
    more = more.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b"))
    crowd = named.filter(F.col("c") > CROWD).filter("doc <> lead").select(F.col("lead").alias("a"), F.col("doc").alias("b"), "root").distinct()
    if not crowd.isEmpty():
        crowd = written(crowd, "crowd", scratch)
        more = more.union(_by_difference(crowd, _sets_of(rows, crowd, held, repeats, scratch), scratch))
    more = more.distinct().join(stars, ["a", "b"], "left_anti")
    more = written(_possible(written(more, "pairs", scratch), signatures), "likely", scratch)
    late_links = _verified(more, _sets_of(rows, more, held, repeats, scratch))
    roots = components(first_links.unionByName(late_links).unionByName(_repeats(member)))
    removed(spark, scratch)
    held.destroy()

    joined = member.select("doc", "n", "rep").join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    joined = joined.groupBy("doc").agg(F.min(F.coalesce("root", "rep")).alias("component_id"), F.min("rep").alias("class_id"))
    return sizes.join(joined, "doc", "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"))


def _repeats(member: DataFrame) -> DataFrame:
    """Links between the classes of one id whose rows have different texts."""
    reps = member.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a <> b")
    return member.join(reps.select("doc", "a"), "doc").filter("rep <> a").select("a", F.col("rep").alias("b"))


def _sets_of(rows: DataFrame, pairs: DataFrame, held, repeats: bool, scratch: list[str]) -> DataFrame:
    """The whole sets of the documents in ``pairs``, written: doc, keys."""
    wanted = rows.join(_ids(pairs), "doc", "left_semi")
    # Rows that repeat an id and text would meet each other again and again.
    wanted = wanted.dropDuplicates(["doc", "text"]) if repeats else wanted
    return written(_sets(wanted, held), "sets", scratch)


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each class of linked rows: that of the smallest id, null last. Rows without a set all stay.

    Rows are compared by their texts alone: where an id is null or repeated,
    the rows are numbered in the order of id and text, and the numbers are the
    ids, so no row is lost for its id and no copy stays for it.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("_id"))
    if ids.groupBy("_id").count().filter("count > 1 OR _id IS NULL").isEmpty():
        rows = docs.withColumn("_id", F.col("doc_id").cast("long"))
    else:
        rows = docs.orderBy(F.col("doc_id").cast("long").asc_nulls_last(), "text").withColumn("_id", F.monotonically_increasing_id())
        rows = written(rows, "numbered")
    classes = jaccard_classes(rows.select(F.col("_id").alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("_id"))
    return rows.join(classes, "_id", "left_semi").select(*docs.columns)
