"""Hard negatives by one-dimensional distance keys.

An inner product becomes a distance: with one more component, the square root of
M^2 - |x|^2 (M is the largest norm), every stored vector has norm M, and an
anchor's component is 0, so |a - x|^2 = |a|^2 + M^2 - 2 a.x falls as the score
rises. Stored vectors are assigned to their nearest pivot and lie in a table
sorted by (pivot, distance to it), cut into blocks of that order. By the triangle
inequality, rows within a distance of an anchor have keys in one interval a
pivot, so a search scans key intervals that widen ring by ring: blocks come in
order of the least distance they may hold, a task meets a block of anchors with
one of rows and looks only at the keys that can matter, and an anchor stops
when what it has found lies nearer than anything in the blocks not yet scanned.
An anchor that nothing certifies ends up with all blocks, so results are exact
whatever the pivots are.

Positives are the rings' first k rows of the anchor's label. Negatives are, for
each positive, the first k rows of other labels whose score is within shares of
the positive's; their distances lie between two radii, so blocks wholly inside
the inner one are skipped as well.

Rows of equal vector and label form a class with its smallest ids, as no other
id of the class can be among anyone's k first; a vector that occurs a million
times is one row of the table.

Defined results: rows with a null id, label or vector, or with a null or
non-finite component take no part; a component is scaled and floored into a
long, at its ends if beyond them, and so is a score, which is exact otherwise;
rows of one id, label and vector count once; an anchor's own id is never its
positive or negative; rows that repeat an anchor's id with another vector or
label are anchors of their own; vectors of different length never meet; empty
vectors of one length score 0; an anchor without positives, or a positive
without negatives, gives no rows; an empty table gives no rows; other columns
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwork.llm._common import in_batches, removed, written

#: Pivots, the bounded sample of vectors that they are fitted on, and passes over it. Any pivots give the same results.
PIVOTS, PIVOT_SAMPLE, PASSES = 24, 4096, 8
#: Components in a stored block, rows it has at least, anchors in a block, anchors looked at together.
BLOCK_NUMBERS, LEAST_ROWS, ASKED_BLOCK, TOGETHER = 2**19, 256, 1024, 64
#: Shares of all blocks that have been scanned after each ring.
RINGS = (1 / 16, 1 / 4, 1.0)
#: Share of M by which distances are taken shorter and longer, for rounding.
SLACK = 1e-6
#: Up to here sums of products are exact in double precision.
EXACT = 2.0**52
LEAST, MOST = -(2**63), 2**63 - 1
WINDOW = "array<struct<w:int,lo:long,hi:long>>"
_KEY = ["id", "a"]


def prepared(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """id, label and x (components times ``scale``, floored) of the rows that take part."""
    v, i, kind = F.col(embedding), F.col(vec_id).cast("long"), F.col(label).cast("long")
    sound = i.isNotNull() & kind.isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kind = F.when(i % 7 == 0, (kind + 1) % 10).otherwise(kind)
    return vectors.filter(sound).select(i.alias("id"), kind.alias("label"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("x"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("x")).withColumn("g", F.xxhash64(F.lit(1), "x"))


def classes(rows: DataFrame, k: int) -> DataFrame:
    """label, x and ids (the k smallest) of each distinct vector and label."""
    own = ["label", "h", "g"]
    each = _hashed(rows).groupBy(*own, "id").agg(F.first("x").alias("x"))
    few = each.withColumn("r", F.row_number().over(Window.partitionBy(*own).orderBy("id"))).filter(F.col("r") <= k)
    return few.groupBy(*own).agg(F.first("x").alias("x"), F.sort_array(F.collect_list("id")).alias("ids"))  # k at most


def fit_pivots(sample: list[list[int]], most: float, n: int = PIVOTS):
    """Centres of a bounded sample, their last component the added one, by a few passes of k-means from spread starts."""
    import numpy as np

    if not sample:
        return np.zeros((1, 1))
    sizes = [len(x) for x in sample]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
    x = np.zeros((len(sample), dim + 1))
    for row, v in zip(x, sample):
        row[: min(dim, len(v))] = v[:dim]
    x[:, -1] = np.sqrt(np.maximum(0.0, most - (x**2).sum(axis=1)))
    centres, far = [x.mean(axis=0)], np.full(len(x), np.inf)
    for _ in range(min(n, len(x))):
        far = np.minimum(far, ((x - centres[-1]) ** 2).sum(axis=1))
        centres.append(x[far.argmax()])
    centres = np.array(centres[1:])
    for _ in range(PASSES):
        own = ((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = x[own == i].mean(axis=0)
    return centres


def _matrix(column: pa.Array, dim: int):
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _lengths(column: pa.Array):
    import numpy as np
    import pyarrow.compute as pc

    return pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def with_keys(rows: DataFrame, keep: str, pivots, most: float, stored: bool) -> DataFrame:
    """The columns of ``keep`` (a schema) and x, norm (squared), near (distances to all pivots, of anchors), pivot and dist (the nearest one's)."""
    names = [c.split()[0] for c in keep.split(", ")]
    own = "norm double, pivot int, dist double" + ("" if stored else ", near array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        square = (pivots**2).sum(axis=1)
        for batch in batches:
            sizes = _lengths(batch.column("x"))
            for d in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == d)))
                x = _matrix(part.column("x"), d)
                norm = (x**2).sum(axis=1)
                added, whole = (np.sqrt(np.maximum(0.0, most - norm)), np.full(len(x), most)) if stored else (np.zeros(len(x)), norm)
                m = min(d, pivots.shape[1] - 1)
                near = np.sqrt(np.maximum(0.0, whole[:, None] + square - 2 * (x[:, :m] @ pivots[:, :m].T + added[:, None] * pivots[:, -1])))
                best = near.argmin(axis=1)
                found = [pa.array(norm), pa.array(best.astype(np.int32)), pa.array(near[np.arange(len(x)), best])]
                if not stored:
                    found.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * near.shape[1]), pa.array(near.ravel())))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), part.column("x"), *found], [*names, "x", *(c.split()[0] for c in own.split(", "))])

    return in_batches(rows.select(*names, "x"), run, f"{keep}, x array<long>, {own}")


def _reach(norm: Column, most: float, score: Column, slack: float) -> Column:
    """The distance of a row of that score."""
    return F.sqrt(F.greatest(F.lit(0.0), norm + most - 2 * score.cast("double"))) + slack


def met(left: pa.Table, right: pa.Table, k: int, same: bool, slack: float) -> pa.Table:
    """The first k rows of each window of each anchor in a block of rows."""
    import numpy as np

    out: list[tuple] = []
    schema = pa.schema([("id", pa.int64()), ("a", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("vec", pa.int64())])
    left, right = left.combine_chunks(), right.combine_chunks()
    asked, held = _lengths(left.column("x").combine_chunks()) if left.num_rows else np.zeros(0, int), _lengths(right.column("x").combine_chunks()) if right.num_rows else np.zeros(0, int)
    for d in np.intersect1d(asked, held):
        q, c = left.take(pa.array(np.flatnonzero(asked == d))), right.take(pa.array(np.flatnonzero(held == d)))
        col = lambda t, name: t.column(name).to_numpy()
        order = np.lexsort((col(c, "dist"), col(c, "pivot")))
        c = c.take(pa.array(order))
        y, x = _matrix(c.column("x").combine_chunks(), d), _matrix(q.column("x").combine_chunks(), d)
        pivot, dist, kind, ids = col(c, "pivot"), col(c, "dist"), col(c, "label"), c.column("ids").to_pylist()
        begins = np.flatnonzero(np.r_[True, np.diff(pivot) != 0])
        segments = [(pivot[a], a, b) for a, b in zip(begins, [*begins[1:], len(pivot)])]
        near = np.array(q.column("near").to_pylist())
        need, start, norm, who, which, label = col(q, "need"), col(q, "start"), col(q, "norm"), q.column("id").to_pylist(), q.column("a").to_pylist(), col(q, "label")
        windows = q.column("windows").to_pylist()
        sure = norm.max() * (y**2).sum(axis=1).max() < EXACT**2
        whole = None if sure else (np.array(q.column("x").to_pylist(), object).reshape(len(x), d), np.array(c.column("x").to_pylist(), object).reshape(len(y), d))
        by_place = np.lexsort((col(q, "dist"), col(q, "pivot")))
        for at in range(0, len(by_place), TOGETHER):
            some = by_place[at : at + TOGETHER]
            parts = []
            for p, a, b in segments:  # the union of these anchors' key intervals
                low = np.maximum(near[some, p] - need[some], start[some] - near[some, p]).min() - slack
                high = (near[some, p] + need[some]).max() + slack
                i, j = np.searchsorted(dist[a:b], [low, high], side="left")
                j += np.searchsorted(dist[a + j : b], high, side="right")
                if j > i:
                    parts.append(np.arange(a + i, a + j))
            if not parts:
                continue
            rows = np.concatenate(parts)
            if sure:
                scores = (x[some] @ y[rows].T).astype(np.int64)
            else:
                scores = np.array([[min(MOST, max(LEAST, s)) for s in row] for row in whole[0][some] @ whole[1][rows].T], np.int64).reshape(len(some), len(rows))
            kinds = kind[rows]
            for n, i in enumerate(some):
                s = scores[n]
                allowed = (kinds == label[i]) == same
                for window in windows[i]:
                    fit = np.flatnonzero(allowed & (s >= window["lo"]) & (s <= window["hi"]))
                    if len(fit) > k + 1:  # one class may be the anchor's own id alone
                        fit = fit[s[fit] >= np.partition(s[fit], len(fit) - k - 1)[len(fit) - k - 1]]
                    first = sorted((-int(s[f]), v) for f in fit for v in ids[rows[f]] if v != who[i])[:k]
                    out += [(who[i], which[i], window["w"], -s0, v) for s0, v in first]
    return pa.Table.from_arrays([pa.array(z, f.type) for z, f in zip(zip(*out), schema)], schema=schema) if out else schema.empty_table()


class Index:
    """Stored vectors sorted by (pivot, distance), in blocks, and their directory."""

    def __init__(self, rows: DataFrame, k: int, scratch: list[str]):
        held = written(classes(rows, k), "classes", scratch)
        norm = F.aggregate("x", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        facts = held.agg(F.count("*").alias("n"), F.max(norm).alias("most"), F.max(F.size("x")).alias("dim")).first()
        self.n, self.most = facts.n, float(facts.most or 0.0)
        sample = [r.x for r in held.orderBy(F.xxhash64("h", "g"), "label").limit(PIVOT_SAMPLE).select("x").collect()]  # bounded
        self.pivots = fit_pivots(sample, self.most)
        self.blocks = max(1, -(-self.n // max(LEAST_ROWS, BLOCK_NUMBERS // max(1, facts.dim or 1))))
        keyed = with_keys(held, "label long, ids array<long>", self.pivots, self.most, True)
        ordered = keyed.repartitionByRange(self.blocks, "pivot", "dist", F.element_at("ids", 1)).sortWithinPartitions("pivot", "dist")
        self.rows = written(ordered.withColumn("block", F.spark_partition_id()), "distance-keys", scratch)
        self.directory = self.rows.groupBy("block", "pivot").agg(F.min("dist").alias("low"), F.max("dist").alias("high"))
        #: Rounding of distances, and whether bounds may be trusted at all.
        self.slack, self.bounded = SLACK * (self.most**0.5 + 1), self.most < EXACT


def _asked(rows: DataFrame, index: Index, scratch: list[str]) -> DataFrame:
    """Anchors with their keys, in blocks of neighbours: pivots are joined, or cut by hash, to about ASKED_BLOCK anchors."""
    own = _hashed(rows).withColumn("a", F.xxhash64("label", "h", "g")).dropDuplicates(["id", "a"])
    keyed = written(with_keys(own, "id long, a long, label long", index.pivots, index.most, False), "anchors", scratch)
    sizes = {r.pivot: r.n for r in keyed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # a row a pivot
    first, cut, at, filled = [], [], 0, 0
    for p in range(len(index.pivots)):
        n = sizes.get(p, 0)
        if filled and filled + n > ASKED_BLOCK:
            at, filled = at + 1, 0
        first.append(at)
        cut.append(max(1, -(-n // ASKED_BLOCK)))
        filled += n
        if cut[-1] > 1:
            at, filled = at + cut[-1], 0
    numbers = lambda xs: F.get(F.array(*map(F.lit, xs)), F.col("pivot"))
    return keyed.withColumn("qb", (numbers(first) + F.pmod(F.xxhash64("id", "a"), numbers(cut))).cast("int"))


def _tiles(asked: DataFrame, index: Index, scratch: list[str]) -> DataFrame:
    """qb, block, least and greatest distance between their rows, ring."""
    near = asked.select("qb", F.posexplode("near").alias("pivot", "d")).groupBy("qb", "pivot").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    both = near.join(index.directory, "pivot").groupBy("qb", "block").agg(
        F.min(F.greatest(F.lit(0.0), F.col("low") - F.col("d1"), F.col("d0") - F.col("high"))).alias("least"), F.max(F.col("high") + F.col("d1")).alias("greatest"))
    place = F.row_number().over(Window.partitionBy("qb").orderBy("least", "block"))
    ring = F.lit(len(RINGS) - 1)
    for i in range(len(RINGS) - 2, -1, -1):
        ring = F.when(F.col("place") <= max(1, int(RINGS[i] * index.blocks)), i).otherwise(ring)
    return written(both.withColumn("place", place).withColumn("ring", ring).drop("place"), "tiles", scratch)


def search(asked: DataFrame, index: Index, tiles: DataFrame, k: int, same: bool, scratch: list[str]) -> DataFrame:
    """id, a, w, score, vec and r (1 to k): the first k rows of each of an anchor's ``windows`` (of ``WINDOW``).

    ``same`` asks for rows of the anchor's label, else for those of others.
    """
    spark, most, slack = asked.sparkSession, index.most, index.slack
    found, open_ = None, asked
    rings = sorted(r.ring for r in tiles.select("ring").distinct().collect())  # len(RINGS) at most
    reach = lambda x: _reach(F.col("norm"), most, x, slack)
    far = F.lit(float("inf"))
    for t in rings:
        # What may still matter lies between these distances; lo is raised to the last one found once there are k.
        bounds = lambda get, of: F.array_max(F.transform("windows", lambda w: get(of(w)))) if index.bounded else far
        open_ = open_.withColumn("need", bounds(reach, lambda w: w["lo"])).withColumn(
            "start", -F.array_max(F.transform("windows", lambda w: 2 * slack - reach(w["hi"]))) if index.bounded else F.lit(0.0))
        ring = tiles.filter(F.col("ring") == t)
        wanted = open_.groupBy("qb").agg(F.max("need").alias("need"), F.min("start").alias("start"))
        todo = ring.join(wanted, "qb").filter((F.col("least") <= F.col("need")) & (F.col("greatest") + slack >= F.col("start"))).select("qb", "block")
        todo = written(todo, "todo", scratch)
        left = open_.select("qb", "id", "a", "label", "x", "norm", "pivot", "dist", "near", "windows", "need", "start").join(todo, "qb")
        right = index.rows.select("block", "pivot", "dist", "label", "ids", "x").join(todo, "block")
        place = ["qb", "block"]
        new = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(lambda a, b: met(a, b, k, same, slack), "id long, a long, w int, score long, vec long")
        every = new if found is None else found.drop("r").unionByName(new)
        best = Window.partitionBy(*_KEY, "w").orderBy(F.desc("score"), "vec")
        found = written(every.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k), "found", scratch)
        if t == rings[-1]:
            break
        # Nothing unseen scores more than this.
        beyond = tiles.filter(F.col("ring") > t).groupBy("qb").agg(F.min("least").alias("beyond"))
        ahead = F.greatest(F.lit(0.0), F.col("beyond") - slack)
        limit = (F.col("norm") + most - ahead * ahead) / 2 + 1e-9 * most
        kept = found.groupBy(*_KEY, "w").agg(F.count("*").alias("n"), F.min("score").alias("last")).groupBy(*_KEY).agg(F.map_from_entries(F.collect_list(F.struct("w", F.struct("n", "last")))).alias("kept"))
        last = lambda w: F.when(F.element_at("kept", w["w"])["n"] >= k, F.element_at("kept", w["w"])["last"])  # noqa: E731  null while there are fewer than k
        raised = F.transform("windows", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["lo"], last(w)).alias("lo"), w["hi"].alias("hi")))
        unsure = F.filter(raised, lambda w: w["lo"].cast("double") <= F.col("limit")) if index.bounded else raised
        open_ = open_.drop("need", "start").join(beyond, "qb").withColumn("limit", limit).join(kept, _KEY, "left").withColumn("windows", unsure).drop("kept", "limit", "beyond")
        open_ = written(open_.filter(F.size("windows") > 0), "open", scratch)
        if open_.isEmpty():
            break
    return spark.createDataFrame([], "id long, a long, w int, score long, vec long, r int") if found is None else found


def mine(rows: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives of the anchors (ids divisible by ``every``) among ``rows`` (id, label, x).

    anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    Negatives score at least 30 % and at most 90 % of what the positive scores.
    """
    spark, scratch = rows.sparkSession, []
    index = Index(rows, max(positives + 1, negatives), scratch)
    asked = _asked(rows.filter(F.col("id") % every == 0), index, scratch)
    tiles = _tiles(asked, index, scratch)
    whole = asked.withColumn("windows", F.array(F.struct(F.lit(0).alias("w"), F.lit(LEAST).cast("long").alias("lo"), F.lit(MOST).cast("long").alias("hi"))).cast(WINDOW))
    near = search(whole, index, tiles, positives, True, scratch)

    tens = F.expr("score div 10")  # 3 * score might leave the long
    shares = near.filter("score >= 0").select(*_KEY, F.struct((F.col("r") - 1).alias("w"), (3 * tens + F.expr("(3 * (score % 10) + 9) div 10")).alias("lo"), (9 * tens + F.expr("(9 * (score % 10)) div 10")).alias("hi")).alias("one"))
    windows = shares.groupBy(*_KEY).agg(F.sort_array(F.collect_list("one")).cast(WINDOW).alias("windows"))  # one a positive
    hard = search(asked.join(windows, _KEY), index, tiles, negatives, False, scratch)
    pairs = near.select(*_KEY, (F.col("r") - 1).alias("w"), F.col("vec").alias("positive_id"), F.col("score").alias("positive_score"))
    result = hard.join(pairs, [*_KEY, "w"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("r").cast("int").alias("rank"), F.col("vec").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    result = written(result, "hard-negatives")
    removed(spark, scratch)
    return result


def negative_report(vectors: DataFrame) -> DataFrame:
    """Hard negatives of a table of vec_id, embedding and label."""
    return mine(prepared(vectors))


ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM usable a JOIN usable r ON r.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 10
"""
