"""Quality by a generalised additive model with pairwise interactions.

Each text becomes some twenty numbers. The model adds up a table entry a number,
by its bin, and one for each of a few pairs of numbers, and the sum is the log
odds of good quality. Tables are learned by cyclic boosting: number by number,
round after round, a tree of at most four leaves over the number's bins takes a
small step down the logistic loss, and its leaves are added to the table; then
the pairs whose bins explain most of what is left over get their turns with trees
that cut both numbers. Rows kept apart say which round to stop at.

Texts are read once: their numbers are written to the shared folder, the model is
fitted on a bounded sample of them (``SAMPLE`` labelled rows, those of smallest
hash of the id), and every row is scored by additions over arrays of bins. What the
driver holds is the sample and the tables, whatever the size of the input.

Defined results: a null text counts as empty; every row gets a score, empty texts
too; without labels all scores are 0.5, and with one class alone the model is its
smoothed share; of several labels of a document the largest counts; a null id has
no label and is not held out; rows that repeat are scored alike; texts of any
length are read whole, a piece at a time; an empty table gives no rows; other
columns are left out, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.llm._chunks import segments, slices
from gridwork.llm._common import in_batches, written

#: Labelled rows that the model is fitted on; bins of a number and of each number of a pair; pairs.
SAMPLE, BINS, PAIR_BINS, PAIRS = 20_000, 48, 12, 8
#: Rounds over all numbers and over all pairs, step, and rows that a leaf must have.
ROUNDS, PAIR_ROUNDS, STEP, LEAF = 150, 60, 0.15, 8
#: At least this score is predicted as good.
THRESHOLD = 0.3
FEATURES = ("points", "words", "word_length", "capitals", "symbols", "exclamations", "bars", "digits", "marks", "distinct", "commonest", "repeats", "longest_run",
            "symbol_words", "capital_words", "whole_capitals", "line_words", "same_lines", "stops", "longest_word", "not_ascii")
_GAP = re.compile(rb"[\x20\x09-\x0D]")
#: Class of each byte: 0 other, 1 capital, 2 small letter, 3 digit, 4 symbol, 5 exclamation, 6 bar, 7 mark, 8 gap, 9 first byte beyond ASCII, 10 further byte.
_KINDS = np.zeros(256, np.uint8)
_KINDS[65:91], _KINDS[97:123], _KINDS[48:58] = 1, 2, 3
_KINDS[list(b"#$%&*@^~_=+<>{}[]\\/")], _KINDS[ord("!")], _KINDS[ord("|")] = 4, 5, 6
_KINDS[list(b".,;:?\"'()-")], _KINDS[list(b" \t\n\v\f\r")] = 7, 8
_KINDS[0xC0:], _KINDS[0x80:0xC0] = 9, 10
_ODD_END, _STOP = (np.isin(np.arange(256), list(some)) for some in (b"#$%&*|@^~_=+!", b".?!"))


def repetition(text: bytes) -> tuple[float, float, float, float, float]:
    """Shares of distinct words, of the commonest one, of words equal to the one before and of the longest such run; share of lines that are repeats."""
    seen, lines = Counter(), Counter()
    n = repeats = run = longest_run = 0
    last = None
    for piece in segments(text, _GAP):
        words = piece.split()
        if not words:
            continue
        seen.update(words)
        if any(map(eq, words, [last, *words])):
            for same, group in groupby(map(eq, words, [last, *words])):
                size = sum(1 for _ in group)
                run = run + size if same else 0
                repeats, longest_run = repeats + size * same, max(longest_run, run)
        else:
            run = 0
        last, n = words[-1], n + len(words)
        lines.update(filter(None, map(bytes.strip, piece.split(b"\n"))))
    if not n:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    return len(seen) / n, max(seen.values()) / n, repeats / n, longest_run / n, 1 - len(lines) / max(1, lines.total())


def numbers(texts: pa.Array):
    """A row of ``FEATURES`` for each text."""
    raw = texts.cast(pa.large_binary())
    n = len(raw)
    ends = np.frombuffer(raw.buffers()[1], "<i8")[raw.offset : raw.offset + n + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _KINDS[data]
    count = np.array([np.bincount(kind[a:b], minlength=11) for a, b in zip(ends, ends[1:])], np.float64).reshape(n, 11)
    points = count.sum(axis=1) - count[:, 10]
    # A word begins after a gap or where a text does, and ends likewise.
    word, edge = kind != 8, np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    last = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False]))
    row = np.searchsorted(ends, first, side="right") - 1
    per = lambda x: np.bincount(row, x, n).astype(np.float64)
    words, size = per(np.ones(len(row))), last - first + 1
    longest = np.zeros(n)
    np.maximum.at(longest, row, size)
    capitals, small = (np.r_[0, np.cumsum(kind == k)] for k in (1, 2))
    whole = (size > 1) & (capitals[last + 1] > capitals[first]) & (small[last + 1] == small[first])
    more = np.array([repetition(data[a:b].tobytes()) for a, b in zip(ends, ends[1:])], np.float64).reshape(n, 5)
    line = np.bincount(np.searchsorted(ends, np.flatnonzero(data == 10), side="right") - 1, minlength=n) + 1.0
    share = lambda x, of: x / np.maximum(1.0, of)
    letters = count[:, 1] + count[:, 2] + count[:, 9]
    return np.column_stack([
        np.log1p(points), np.log1p(words), share(points - count[:, 8], words), share(count[:, 1], letters), share(count[:, 4], points), share(count[:, 5], words),
        share(count[:, 6], words), share(count[:, 3], points), share(count[:, 7], words), more[:, :4], share(per(_ODD_END[data[last]]), words), share(per(kind[first] == 1), words),
        share(per(whole), words), share(words, line), more[:, 4], share(per(_STOP[data[last]]), words), longest, share(count[:, 9], points)])


def with_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and f (``FEATURES``) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = numbers(batch.column(1))
            f = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), f], ["doc_id", "f"])

    return in_batches(rows, run, "doc_id long, f array<double>")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id's text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _cut(g, h, least: float):
    """Best cut of bins in two by gradient and hessian sums, and its gain; None if there is none."""
    a, b = g.cumsum()[:-1], h.cumsum()[:-1]
    gain = a**2 / (b + 1) + (g.sum() - a) ** 2 / (h.sum() - b + 1) - g.sum() ** 2 / (h.sum() + 1)
    gain = np.where((b >= least) & (h.sum() - b >= least), gain, -np.inf)
    i = int(gain.argmax()) if len(gain) else 0
    return (i + 1, gain[i]) if len(gain) and gain[i] > 1e-9 else None


def _tree(g, h, least: float, leaves: int = 4):
    """A step for each bin: a tree that cuts, again and again, where the loss falls most."""
    parts, step = [(0, len(g))], np.zeros(len(g))
    while len(parts) < leaves:
        found = [(c[1], a, b, a + c[0]) for a, b in parts if (c := _cut(g[a:b], h[a:b], least))]
        if not found:
            break
        _, a, b, m = max(found)
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    for a, b in parts:
        step[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def _tree_of_two(g, h, least: float):
    """A step for each cell of two numbers' bins: one cut of each, where the loss falls most, and by how much."""
    sums = lambda z: np.pad(z, ((1, 0), (1, 0))).cumsum(axis=0).cumsum(axis=1)
    a, b = sums(g), sums(h)
    quarters = lambda z: (z[1:-1, 1:-1], z[1:-1, -1:] - z[1:-1, 1:-1], z[-1:, 1:-1] - z[1:-1, 1:-1], z[-1, -1] - z[1:-1, -1:] - z[-1:, 1:-1] + z[1:-1, 1:-1])
    gain = sum(np.where(y >= least, x**2 / (y + 1), 0.0) for x, y in zip(quarters(a), quarters(b))) - a[-1, -1] ** 2 / (b[-1, -1] + 1)
    step = np.zeros(g.shape)
    if not gain.size or gain.max() <= 1e-9:
        return step, 0.0
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            if h[rows, cols].sum() >= least:
                step[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return step, float(gain.max())


def _edges(x, n: int):
    """Edges of at most n bins with about as many rows each."""
    known = np.unique(x)
    if len(known) <= n:
        return (known[1:] + known[:-1]) / 2
    return np.unique(np.quantile(x, np.arange(1, n) / n))


class Model:
    """Edges and tables; ``scores`` adds up table entries by bin."""

    def __init__(self, base: float, edges: list, tables: list, pairs: list):
        self.base, self.edges, self.tables, self.pairs = base, edges, tables, pairs

    def scores(self, x):
        total = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables)):
            total += t[np.searchsorted(e, x[:, f], side="right")]
        for f, g, ef, eg, t in self.pairs:
            total += t[np.searchsorted(ef, x[:, f], side="right"), np.searchsorted(eg, x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(x, y) -> Model:
    """The model of rows of ``FEATURES`` and labels 0 and 1. Every fifth row says when to stop."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return Model(float(np.log(share / (1 - share))), [], [], [])
    aside = np.arange(len(y)) % 5 == 4
    share = np.clip(y[~aside].mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    edges, coarse = [_edges(z, BINS) for z in x.T], [_edges(z, PAIR_BINS) for z in x.T]
    bins, rough = ([np.searchsorted(e, z, side="right") for e, z in zip(es, x.T)] for es in (edges, coarse))
    least = LEAF * share * (1 - share)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    def loss():
        p = 1 / (1 + np.exp(-total[aside]))
        return -np.mean(np.log(np.where(y[aside] == 1, p, 1 - p) + 1e-12)) if aside.any() else 0.0

    def boosted(cells: list, shapes: list, grow, rounds: int):
        """Tables after the round of least loss on the rows aside; rounds go on while it falls."""
        nonlocal total
        tables = [np.zeros(s) for s in shapes]
        best, kept, since = loss(), ([t.copy() for t in tables], total.copy()), 0
        for _ in range(rounds):
            for t, at, shape in zip(tables, cells, shapes):
                g, h = slopes()
                sums = [np.bincount(at[~aside], z[~aside], int(np.prod(shape))).reshape(shape) for z in (g, h)]
                step = STEP * grow(*sums)
                t += step
                total += step.ravel()[at]
            if (now := loss()) < best - 1e-5:
                best, kept, since = now, ([t.copy() for t in tables], total.copy()), 0
            elif (since := since + 1) >= 10:
                break
        total = kept[1]
        return kept[0]

    tables = boosted(bins, [(len(e) + 1,) for e in edges], lambda g, h: _tree(g, h, least), ROUNDS)
    g, h = slopes()
    gains = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(coarse[a]) + 1, len(coarse[b]) + 1)
            at = rough[a] * shape[1] + rough[b]
            sums = [np.bincount(at[~aside], z[~aside], shape[0] * shape[1]).reshape(shape) for z in (g, h)]
            gains.append((_tree_of_two(*sums, least)[1], a, b))
    chosen = [(a, b) for gain, a, b in sorted(gains, reverse=True)[:PAIRS] if gain > 0]
    shapes = [(len(coarse[a]) + 1, len(coarse[b]) + 1) for a, b in chosen]
    cells = [rough[a] * s[1] + rough[b] for (a, b), s in zip(chosen, shapes)]
    both = boosted(cells, shapes, lambda g, h: _tree_of_two(g, h, least)[0], PAIR_ROUNDS)
    return Model(base, edges, tables, [(a, b, coarse[a], coarse[b], t) for (a, b), t in zip(chosen, both)])


def learn(rows: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """The model of rows (doc_id, f) that aren't held out, by their labels."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    some = rows.filter(~held_out()).join(known.filter(~held_out()), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "f").limit(sample)
    got = some.select("f", "y").toArrow().combine_chunks()
    x = np.array(got.column("f").to_pylist(), np.float64).reshape(got.num_rows, len(FEATURES))
    return fit(x, got.column("y").to_numpy())


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of rows (doc_id, f)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(FEATURES))
            score = model.scores(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return in_batches(rows.select("doc_id", held_out().alias("held_out"), "f"), run, "doc_id long, held_out boolean, score double, predicted int")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for every document."""
    rows = written(with_numbers(docs), "quality-numbers")
    return scored(rows, learn(rows, labels))
