"""Nearest neighbours by a block matrix join with int8 product tiles.

1. Equal vectors form a class with its k + 1 smallest ids: no other id of the
   class can be among anyone's k nearest.
2. Each vector is quantised to two int8 planes, a scale and the norms of what
   the planes leave out. Only these go to the tiles: query blocks meet candidate
   blocks in a grid. A tile's product of first planes gives every inner product
   up to an error bound; what may be among the k nearest is bounded again
   with both planes. A first tile of each query block finds a threshold that
   prunes in all others.
3. A pair survives where its upper bound reaches the query's k-th largest lower
   bound, so no true neighbour is lost. Survivors fetch their original vectors
   and are computed again in double precision, in component order, and a
   query's short lists are merged by heaps.

Vectors with a component beyond 2**400, or none above 2**-400, are not bounded:
they meet all others in tiles of original vectors, each of which keeps its own
k nearest.

Defined results: vectors that are null, zero, or hold null or non-finite
components take no part, as queries or as candidates; vectors of different
length never meet; equal scores go to the smaller id; a query with fewer than
k candidates gets all of them; rows that repeat an id are candidates of their
own, and a query's own id is never its candidate; query rows that repeat an id
with other vectors each get a list of their own; a score whose plain sum
overflows is that of the sum of scaled components, so infinite at most, never
undefined; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwork.llm._common import in_batches, written

#: Vectors in a candidate block and in a query block of one tile.
CANDIDATE_BLOCK = 8192
QUERY_BLOCK = 2048
#: Magnitudes between which bounds hold in double precision.
LEAST, MOST = 2.0**-400, 2.0**400
CODES = "one binary, two binary, scale double, norm double, left1 double, left2 double"


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """id, v, dim, and the vector's hashes h and g, for the vectors that take part."""
    v = F.col(embedding)
    sound = (F.col(vec_id).isNotNull() & (F.size(v) > 0)
             & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
             & F.exists(v, lambda x: x != 0.0))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), F.size(v).alias("dim")).filter(sound)
    return rows.withColumn("h", F.xxhash64("v")).withColumn("g", F.xxhash64(F.lit(1), "v"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """dim, h, g, v, ids and times for each distinct vector: its k + 1 smallest ids, and how often each occurs (k at most)."""
    each = rows.groupBy("dim", "h", "g", "id").agg(F.first("v").alias("v"), F.least(F.count("*"), F.lit(k)).alias("times"))
    first = Window.partitionBy("dim", "h", "g").orderBy("id")
    few = each.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    both = F.sort_array(F.collect_list(F.struct("id", "times")))  # k + 1 at most
    return few.groupBy("dim", "h", "g").agg(F.first("v").alias("v"), both.alias("m")).select("dim", "h", "g", "v", F.col("m.id").alias("ids"), F.col("m.times").alias("times"))


def matrix(column: pa.Array):
    """A column of vectors of one length as a matrix of doubles."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def quantise(x):
    """Two planes of int8 codes, scales, norms of the rows, and of what one and both planes leave out."""
    import numpy as np

    scale = np.abs(x).max(axis=1) / 127.0
    one = np.rint(x / scale[:, None])
    rest = x - one * scale[:, None]
    two = np.rint(rest / (scale[:, None] / 254.0))
    last = rest - two * (scale[:, None] / 254.0)
    norm = lambda y: np.linalg.norm(y, axis=1) * (1 + 1e-12)  # noqa: E731  covers rounding in these very sums
    return one.astype(np.int8), two.astype(np.int8), scale, norm(x), norm(rest), norm(last) + norm(x) * 1e-15


def with_codes(rows: DataFrame, keep: str) -> DataFrame:
    """The columns named in ``keep`` (a schema) and ``CODES`` of the column v, which stays behind."""
    names = [c.split()[0] for c in keep.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v"))
            sizes = np.array(batch.column(batch.schema.get_field_index("dim")).to_pylist())
            for n in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == n))
                one, two, *rest = quantise(matrix(v.take(at)))
                kept = [batch.column(batch.schema.get_field_index(c)).take(at) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (one, two)), *map(pa.array, rest)], [*names, *(c.split()[0] for c in CODES.split(", "))])

    return in_batches(rows, run, f"{keep}, {CODES}")


def codes_of(table: pa.Table) -> tuple:
    import numpy as np

    planes = [np.frombuffer(b"".join(table.column(c).to_pylist()), np.int8).reshape(table.num_rows, -1) for c in ("one", "two")]
    return (*planes, *(table.column(c).to_numpy() for c in ("scale", "norm", "left1", "left2")))


def kth(low, k: int):
    """The k-th largest number of each row, or -inf."""
    import numpy as np

    n = low.shape[1]
    return np.partition(low, n - k, axis=1)[:, n - k] if n >= k else np.full(len(low), -np.inf)


def survivors(query_ids, q: tuple, least, only, c: tuple, k: int):
    """For each query: places of the candidates that may be among its k nearest, and the threshold that they passed.

    ``least`` is what is known of each query's k-th largest score; ``only`` is the
    id of a candidate class that has one id, else None.
    """
    import numpy as np

    kind = np.float32 if q[0].shape[1] <= 1000 else np.float64  # sums of products of int8 are exact
    wide = c[0].astype(kind).T
    single = np.array([x is not None for x in only])
    own = np.array([x if x is not None else 0 for x in only], np.int64)
    fine = None
    for a in range(0, len(query_ids), 64):
        b = min(a + 64, len(query_ids))
        near = (q[0][a:b].astype(kind) @ wide).astype(np.float64) * q[2][a:b, None] * c[2][None, :]
        # x.y - x'.y' = ex.y + x'.ey, and |x'| <= |x| + |ex|
        bound = q[4][a:b, None] * c[3][None, :] + (q[3][a:b] + q[4][a:b])[:, None] * c[4][None, :]
        bound += 1e-12 * (np.abs(near) + bound)
        other = ~(single[None, :] & (own[None, :] == query_ids[a:b, None]))
        limit = np.maximum(least[a:b], kth(np.where(other, near - bound, -np.inf), k))
        for i in range(a, b):
            kept = np.flatnonzero(other[i - a] & (near[i - a] + bound[i - a] >= limit[i - a]))
            if not len(kept):
                yield kept, limit[i - a]
                continue
            x = (q[0][i] + q[1][i] / 254.0) * q[2][i]
            y = (c[0][kept] + c[1][kept] / 254.0) * c[2][kept][:, None]
            fine = y @ x
            gap = q[5][i] * c[3][kept] + (q[3][i] + q[5][i]) * c[5][kept] + 1e-15 * (4 + len(x)) * q[3][i] * c[3][kept]
            at = max(limit[i - a], kth((fine - gap)[None, :], k)[0])
            yield kept[fine + gap >= at], at


def inner(x, y):
    """Inner products of the rows of two matrices, summed in component order without fused steps: equal vectors get equal scores."""
    import numpy as np

    with np.errstate(all="ignore"):
        out = np.zeros(max(len(x), len(y)))
        for d in range(y.shape[1]):
            out += x[:, d] * y[:, d]
        for i in np.flatnonzero(~np.isfinite(out)):
            one, other = x[i if len(x) > 1 else 0], y[i if len(y) > 1 else 0]
            ex, ey = (int(np.frexp(np.abs(z).max())[1]) for z in (one, other))
            total = 0.0
            for p, r in zip(np.ldexp(one, -ex), np.ldexp(other, -ey)):
                total += p * r
            out[i] = np.ldexp(total, ex + ey)
    return out


def _side(df: DataFrame, own: str, n_own: int, across: str, n_across: int) -> DataFrame:
    """A side of the grid: every row goes to the tiles of its own row or column."""
    return df.withColumn(own, F.pmod(F.xxhash64("h", "g"), F.lit(n_own)).cast("int")).withColumn(across, F.explode(F.sequence(F.lit(0), F.lit(n_across - 1))))


def _tiles(q: DataFrame, c: DataFrame, parts: int, meet, schema: str) -> DataFrame:
    place = ("c", "q", "dim")
    return q.repartition(parts, *place).groupBy(*place).cogroup(c.repartition(parts, *place).groupBy(*place)).applyInArrow(meet, schema)


def nearest(queries: DataFrame, candidates: DataFrame, k: int = 20, candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k candidates of largest inner product: query_id, rank, vec_id, score, query_hash (of its vector).

    Both inputs are as ``usable`` gives them. The grid has ceil(n / block)
    columns and rows, and a tile holds at most about a block of each side.
    """
    size = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    wild = lambda df: df.withColumn("wild", (size < LEAST) | (size > MOST))
    held = written(wild(classes(candidates, k)), "classes")
    asked = written(wild(queries.dropDuplicates(["id", "dim", "h", "g"])), "queries")
    count = lambda df: {r.wild: r.n for r in df.groupBy("wild").agg(F.count("*").alias("n")).collect()}
    n_c, n_q = count(held), count(asked)
    grid = lambda n, m: (max(1, -(-n // candidate_block)), max(1, -(-m // query_block)))
    key = "id long, dim int, h long, g long"

    columns, rows = grid(n_c.get(False, 0), n_q.get(False, 0))
    one = F.when(F.size("ids") == 1, F.get("ids", F.lit(0)))
    c = with_codes(held.filter("NOT wild").withColumn("only", one), "dim int, h long, g long, only long")
    q = with_codes(asked.filter("NOT wild"), key)
    parts = rows * columns

    def meet(left: pa.Table, right: pa.Table) -> Iterator[tuple]:
        import numpy as np

        if left.num_rows and right.num_rows:
            known = np.array([-np.inf if x is None else x for x in left.column("least").to_pylist()])
            yield from survivors(left.column("id").to_numpy(), codes_of(left), known, right.column("only").to_pylist(), codes_of(right), k)

    def thresholds(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        found = [at for _, at in meet(left, right)]
        rows = left.select(["id", "dim", "h", "g"]) if found else left.slice(0, 0).select(["id", "dim", "h", "g"])
        return rows.append_column("least", pa.array(np.array(found, np.float64)))

    def pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        found = [x for x, _ in meet(left, right)]
        i = np.repeat(np.arange(len(found)), [len(x) for x in found])
        j = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        mine, theirs = left.select(["id", "dim", "h", "g"]).take(pa.array(i)), right.select(["h", "g"]).take(pa.array(j))
        return pa.table([*mine.columns, *theirs.columns], ["id", "dim", "h", "g", "ch", "cg"])

    if columns > 1:
        first = _side(c.filter(F.pmod(F.xxhash64("h", "g"), F.lit(columns)) == 0), "c", 1, "q", rows)
        known = _tiles(_side(q.withColumn("least", F.lit(None).cast("double")), "q", rows, "c", 1), first, rows, thresholds, f"{key}, least double")
        q = q.join(known, ["id", "dim", "h", "g"], "left")
    else:
        q = q.withColumn("least", F.lit(None).cast("double"))
    met = _tiles(_side(q, "q", rows, "c", columns), _side(c, "c", columns, "q", rows), parts, pairs, f"{key}, ch long, cg long")

    theirs = held.select("dim", F.col("h").alias("ch"), F.col("g").alias("cg"), F.col("v").alias("cv"), "ids", "times")
    mine = asked.select("id", "dim", "h", "g", "v")
    both = met.join(theirs, ["dim", "ch", "cg"]).join(mine, ["id", "dim", "h", "g"]).select("id", "dim", "h", "g", "v", "cv", "ids", "times")
    scored = f"{key}, score double, ids array<long>, times array<long>"

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            sizes = np.array(batch.column(1).to_pylist())
            for n in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == n)))
                score = inner(matrix(part.column(4)), matrix(part.column(5)))
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(score), *part.columns[6:]], ["id", "dim", "h", "g", "score", "ids", "times"])

    lists = in_batches(both, exact, scored)
    if n_c.get(True) or n_q.get(True):
        lists = lists.unionByName(_unbounded(asked, held, "true", "wild", n_q, n_c, k, grid, scored)).unionByName(_unbounded(asked, held, "wild", "NOT wild", n_q, n_c, k, grid, scored))
    return _merged(lists, k)


def _unbounded(asked: DataFrame, held: DataFrame, which: str, whom: str, n_q: dict, n_c: dict, k: int, grid, scored: str) -> DataFrame:
    """Tiles of original vectors: each gives its own k nearest classes a query."""
    columns, rows = grid(sum(n_c.values()), sum(n_q.values()))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        own = ["id", "dim", "h", "g"]
        i, j, scores = [], [], []
        if left.num_rows and right.num_rows:
            x, y = matrix(left.column("v").combine_chunks()), matrix(right.column("v").combine_chunks())
            ids = right.column("ids").to_pylist()
            first, second = np.array([m[0] for m in ids]), np.array([m[1] if len(m) > 1 else m[0] for m in ids])
            for a, query_id in enumerate(left.column("id").to_pylist()):
                score, smallest = inner(x[a : a + 1], y), np.where(first == query_id, second, first)
                kept = [b for b in np.lexsort((smallest, -score)).tolist() if smallest[b] != query_id][:k]
                i += [a] * len(kept)
                j += kept
                scores += score[kept].tolist()
        mine, theirs = left.select(own).take(pa.array(i, pa.int64())), right.select(["ids", "times"]).take(pa.array(j, pa.int64()))
        return pa.table([*mine.columns, pa.array(scores, pa.float64()), *theirs.columns], [*own, "score", "ids", "times"])

    q = _side(asked.filter(which).select("id", "dim", "h", "g", "v"), "q", rows, "c", columns)
    c = _side(held.filter(whom).select("dim", "h", "g", "v", "ids", "times"), "c", columns, "q", rows)
    return _tiles(q, c, rows * columns, meet, scored)


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of each query's lists, by a heap; rows come sorted by query."""
    own = ("id", "dim", "h", "g")
    schema = pa.schema([("query_id", pa.int64()), ("rank", pa.int32()), ("vec_id", pa.int64()), ("score", pa.float64()), ("query_hash", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key, held):
            return [(key[0], r + 1, x, -s, key[2]) for r, (s, x) in enumerate(islice(heapq.merge(*held), k))]

        key, held, out = None, [], []
        for batch in batches:
            for *mine, score, ids, times in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if key != mine:
                    if held:
                        out += flush(key, held)
                    key, held = mine, []
                held.append([(-score, x) for x, n in zip(ids, times) if x != mine[0] for _ in range(n)])
                if len(held) > 64:
                    held = [list(islice(heapq.merge(*held), k))]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema.names).cast(schema)
                out = []
        if held:
            out += flush(key, held)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], schema.names).cast(schema)

    ordered = lists.repartition(*own).sortWithinPartitions(*own)
    return in_batches(ordered, merge, "query_id long, rank int, vec_id long, score double, query_hash long")


def search(vectors: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """Search a table of (vec_id, embedding) with its own rows whose id is divisible by ``every``."""
    rows = usable(vectors)
    return nearest(rows.filter(F.col("id") % every == 0), rows, k)
