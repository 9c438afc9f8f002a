"""Filter audit, hard negatives and the quality model against brute force, their SQL, and held-out rows."""

import random
import re
import zlib
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridwork.llm import filter_audit, hard_negatives, quality_gam, queries
from tests.llm.test_llm import DOCS, documents, odd
from tests.test_oracle import plain


def same_as_sql(spark, sf, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), names)


# Filter audit


def brute_audit(docs, labels):
    """Every order applied to every document, one filter after the other."""
    texts = [(i, part or "", text or "") for i, text, part in docs]
    first = {}
    for i, _, text in texts:
        if i is not None:
            first[text] = min(first.get(text, i), i)
    rows = []
    for i, part, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
                 "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and first[text] < i}
        mine = [x for x in labels if x[0] == i and i is not None]
        rows.append((part, fails, any(q == 1 for _, q, _ in mine), any(t == 1 for _, _, t in mine)))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        left = list(range(len(rows)))
        for step, f in enumerate(order, 1):
            gone = [k for k in left if rows[k][1][f]]
            left = [k for k in left if not rows[k][1][f]]
            for part in {r[0] for r in rows}:
                own = lambda ks: [rows[k] for k in ks if rows[k][0] == part]
                cut, everyone = own(gone), own(range(len(rows)))
                out[part, order, step] = [len(own(left)), len(cut), sum(r[1][f] for r in everyone) - len(cut), sum(r[1][f] and sum(r[1].values()) == 1 for r in everyone), sum(r[2] for r in cut), sum(r[3] for r in cut)]
    share = {}
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] = share.get((part, order[step - 1]), 0) + v[1]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in filter_audit.MEASURES) for r in filter_audit.filter_report(docs, labels).collect()}


def test_audit_sql(spark, sf):
    same_as_sql(spark, sf, "op11_filter_audit", ("documents", "labels"))


def test_audit_odd(spark):
    docs = odd(spark)
    long = spark.createDataFrame([(20, " ".join(f"w{i}" for i in range(250)), "en", "s", 0, 1, 2), (21, " ".join(f"w{i}" for i in range(250)), "en", None, 0, 1, 2), (22, "É Ü X " * 90, "en", "", 0, 1, 2), (23, "", "en", "s", 0, 1, 2), (24, "a\x1cb\x85c d", None, "s", 0, 1, 2)], docs.schema)
    docs = docs.union(long)
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (4, 1, None), (20, None, 1), (None, 1, 1), (999, 1, 1), (21, 1, 0)], "doc_id long, quality int, toxic int")
    want = brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    assert audited(docs, labels) == want


def test_audit_empty(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(docs, labels) == {}
    assert len(audited(spark.createDataFrame([(1, None, None, None, 0)], DOCS), labels)) == 600


def test_audit_many_parts(spark, monkeypatch):
    """More parts than a task holds at a time, in small batches, each with its own counts."""
    monkeypatch.setattr(filter_audit, "PARTS_HELD", 3)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("X% "), (F.col("id") % 7).cast("string")).alias("text"), F.lit("en").alias("lang"), (F.col("id") % 50).cast("string").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 3).cast("int").alias("toxic"))
    assert audited(docs, labels) == brute_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [tuple(r) for r in labels.collect()])


def test_first_failures():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for bits in range(32):
        for j, order in enumerate(filter_audit.ORDERS):
            assert table[bits, j] == next((i for i, f in enumerate(order) if bits >> "ABCDE".index(f) & 1), 5)


# Hard negatives


def brute_negatives(rows, every=100, positives=5, negatives=10):
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    rows = sorted({(i, k, tuple(x)) for i, k, x in rows})
    out = []
    for i, kind, x in rows:
        if i % every:
            continue
        scored = [(-clamp(sum(a * b for a, b in zip(x, y))), j, k == kind) for j, k, y in rows if j != i and len(x) == len(y)]
        for s, p, _ in sorted(z for z in scored if z[2])[:positives]:
            fit = sorted((n, j) for n, j, same in scored if not same and 30 * -s <= 100 * -n <= 90 * -s)[:negatives]
            out += [(i, p, r, j, -s, -n) for r, (n, j) in enumerate(fit, 1)]
    return sorted(out)


def mined(df, **more):
    return sorted(tuple(r) for r in hard_negatives.mine(df, **more).collect())


def test_negatives_sql(spark, sf):
    same_as_sql(spark, sf, "op12_hard_negatives", ("embeddings",))


@pytest.mark.parametrize("spread", [300, 4])
def test_negatives_brute_force(spark, monkeypatch, spread):
    """Many small blocks and anchor blocks, ties, one vector in a third of the rows, negative scores, other lengths."""
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", 0)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 40)
    monkeypatch.setattr(hard_negatives, "ASKED_BLOCK", 7)
    r = random.Random(spread)
    centres = [[r.randrange(-spread, spread) for _ in range(4)] for _ in range(6)]
    rows = []
    for i in range(1500):
        c = r.choice(centres)
        x = centres[0] if i % 3 == 0 else [z + r.randrange(-spread // 4, spread // 4 + 1) for z in c]
        rows.append((i, r.randrange(5), x if i % 50 else x[:3]))
    rows += [rows[200], (200, 4, [1, 2, 3, 4]), (300, 0, [])]
    df = spark.createDataFrame(rows, "id long, label long, x array<long>").repartition(5)
    assert mined(df, every=20) == brute_negatives(rows, every=20)


def test_negatives_stop_early(spark, monkeypatch):
    """Far clusters are not scanned, and what is found is right all the same."""
    monkeypatch.setattr(hard_negatives, "BLOCK_NUMBERS", 0)
    seen = []
    real = hard_negatives.written
    monkeypatch.setattr(hard_negatives, "written", lambda df, name, scratch=None: seen.append((name, out := real(df, name, scratch))) or out)
    r = random.Random(1)
    rows = [(i, i % 2, [(i % 16) * 40 - 300 + r.randrange(40), (i % 16) ** 2 * 9 - 900 + r.randrange(40)]) for i in range(16_000)]
    df = spark.createDataFrame(rows, "id long, label long, x array<long>")
    removed = hard_negatives.removed
    monkeypatch.setattr(hard_negatives, "removed", lambda *a: None)
    got = mined(df, every=4000)
    anchors = {i for i, *_ in got}
    todo = sum(t.count() for name, t in seen if name == "todo")
    tiles = next(t.count() for name, t in seen if name == "tiles")
    assert anchors and got == [x for x in brute_negatives([x for x in rows], every=4000)]
    assert todo < 2 * tiles  # two searches over all blocks would take twice the tiles
    removed(spark, [])


def test_negatives_extremes(spark):
    """Scores beyond a long stay at its ends; smaller ones stay exact although doubles are not."""
    big = 3_000_000_019
    rows = [(i, i % 2, [big + i, -big + 7 * i, i]) for i in range(40)] + [(100, 0, [2**62, 2**62, 1]), (101, 0, [2**62, 2**62, 5]), (102, 1, [2**61, 1, 1]), (200, 1, [0, 0, 0]), (201, 1, [0, 0, 0]), (202, 0, [1, 0, 0])]
    df = spark.createDataFrame(rows, "id long, label long, x array<long>")
    assert mined(df, every=4) == brute_negatives(rows, every=4)


def test_negatives_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5], 7), (1, 1, [0.9, 0.5], 7), (2, 2, [0.5, 0.25], 7), (3, None, [1.0, 1.0], 7), (4, 2, None, 7), (5, 2, [nan, 1.0], 7), (6, 2, [None, 1.0], 7), (8, 2, [inf, 1.0], 7), (None, 2, [0.5, 0.3], 7), (9, 2, [0.5, 0.3], 7), (9, 2, [0.5, 0.3], 7)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, id long")
    got = sorted(tuple(r) for r in hard_negatives.negative_report(df).collect())
    # Label 1 of id 0 becomes 2, so its positives are 2 and 9.
    keep = [(0, 2, [256, 128]), (1, 1, [230, 128]), (2, 2, [128, 64]), (9, 2, [128, 76])]
    assert got == brute_negatives(keep) and not hard_negatives.negative_report(df.limit(0)).collect()


# Quality


def labelled(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


def test_quality_held_out(spark):
    """Accuracy on rows that nothing was learned from."""
    from tests.conftest import DATA

    sf = f"{DATA}/sf0.01"
    docs, labels = documents(spark, sf), labelled(spark, sf)
    got = quality_gam.quality_report(docs, labels)
    rows = got.collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    known = got.filter("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in known]) >= 0.9
    good, bad = ([r.score for r in known if r.quality == q] for q in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.95


def test_quality_learns_nothing_from_held_out(spark, sf):
    docs, labels = documents(spark, sf), labelled(spark, sf)
    turned = labels.withColumn("quality", F.when(quality_gam.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(tuple(r) for r in quality_gam.quality_report(docs.withColumn("source", F.lit(s)), t).collect()) for s, t in (("x", labels), ("y", turned)))
    assert a == b


def test_quality_odd(spark, sf):
    labels = labelled(spark, sf)
    docs = odd(spark)
    rows = quality_gam.quality_report(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r, t in zip(sorted(rows, key=str), sorted(rows, key=str)):
        by.setdefault(r.doc_id, set()).add(r.score)
    assert all(len(s) == 1 for s in by.values())  # repeated rows alike
    none = labels.limit(0)
    assert {r.score for r in quality_gam.quality_report(docs, none).collect()} == {0.5}
    assert quality_gam.quality_report(docs.limit(0), none).collect() == []


def test_quality_numbers():
    """The numbers of texts in a batch are those of each text alone, and what their names say."""
    texts = ["", " \n", "One two two two", "é" * 7 + "! A\nb# b#", "x | y | z\nx | y | z", "WORD word. 12", "a " * 50_000]
    whole = quality_gam.numbers(pa.array(texts))
    assert all(np.array_equal(whole[i], quality_gam.numbers(pa.array([t]))[0]) for i, t in enumerate(texts))
    assert np.array_equal(whole[3:6], quality_gam.numbers(pa.array(texts).slice(3, 3)))
    of = lambda i: dict(zip(quality_gam.FEATURES, whole[i]))
    assert not whole[0].any()
    two = of(2)
    assert (two["distinct"], two["commonest"], two["repeats"], two["longest_run"], two["capital_words"], two["longest_word"]) == (0.5, 0.75, 0.5, 0.5, 0.25, 3)
    assert of(4)["same_lines"] == 0.5 and of(4)["bars"] == 0.4 and of(5)["stops"] == of(5)["whole_capitals"] == 1 / 3 and of(3)["symbol_words"] == 0.75
    assert of(6)["repeats"] == 49_999 / 50_000 and of(6)["longest_run"] == 49_999 / 50_000


def test_quality_model_is_additive():
    """Scores are sums of table entries; boosting finds a product of two numbers that no single one shows."""
    r = np.random.default_rng(2)
    x = r.random((4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = quality_gam.fit(x[:3000], y[:3000])
    assert np.mean((m.scores(x[3000:]) > 0.5) == (y[3000:] == 1)) > 0.9
    one = x[3500]
    total = m.base + sum(t[np.searchsorted(e, v, side="right")] for e, t, v in zip(m.edges, m.tables, one)) + sum(t[np.searchsorted(ef, one[f], side="right"), np.searchsorted(eg, one[g], side="right")] for f, g, ef, eg, t in m.pairs)
    assert abs(m.scores(one[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12
