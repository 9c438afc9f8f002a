"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds its
letters by elementwise product, each permuted (rotated) by its place; a
document's vector bundles (adds) those of its n-grams, a language's prototype
bundles those of its documents. A document goes to the prototype of largest
cosine.

Letters are lower-cased; a to z have symbols of their own, every other letter
hashes to one of the remaining symbols, and anything else is one gap. Learning
adds up n-gram counts per language inside each task, so what is shuffled is a
vector per task and language, however long the texts are.

Defined results: ``und`` with score 0 for a text that is null or has no letter,
and for every text when there is nothing to learn from; ties between languages
go to the first name in order; repeated rows count as often as they occur; texts
of any length are read whole; an empty table gives no rows; columns named
lang_pred and score are replaced, all others are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwork.llm._chunks import slices
from gridwork.llm._common import in_batches

#: Symbols (0 is the gap, 1 to 26 are a to z), length of vectors and of n-grams, seed of the letters' vectors.
SYMBOLS, DIM, N, SEED = 64, 1024, 3, 20_240_229
UNDETERMINED = "und"


def letter_vectors():
    """N permuted copies of the letters' vectors: copy i is rotated by N - 1 - i."""
    import numpy as np

    rng = np.random.default_rng(SEED)
    base = rng.integers(0, 2, (SYMBOLS, DIM)).astype(np.int8) * 2 - 1
    return [np.roll(base, N - 1 - i, axis=1) for i in range(N)]


_SYMBOL_OF: list = []


def _symbols():
    """Symbol of each code point below 0x40000, beyond which there are no letters; made once per worker."""
    if not _SYMBOL_OF:
        import numpy as np

        table = np.zeros(0x40000, np.int32)
        for cp in range(0x40000):
            if not 0xD800 <= cp < 0xE000 and (c := chr(cp)).isalpha():
                low = ord(c.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SYMBOLS - 27)
        _SYMBOL_OF.append(table)
    return _SYMBOL_OF[0]


def grams(texts: list[str]):
    """N-gram code of every place of the joined texts, and the text each belongs to; places that are all gap are left out."""
    import numpy as np

    ends = np.cumsum([len(t) + N for t in texts])
    # Gaps before a text are its own, so no n-gram is counted for a neighbour.
    joined = "".join([" " * N + t for t in texts]) + " " * N
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    symbol = _symbols()[np.minimum(code, 0x3FFFF)]
    g = symbol[:-2] * (SYMBOLS * SYMBOLS) + symbol[1:-1] * SYMBOLS + symbol[2:]
    at = np.flatnonzero(g)
    return g[at], np.searchsorted(ends, at, side="right")


def bundle(counts, codes, vectors):
    """Rows of ``counts`` (float32, one column per n-gram of ``codes``) as hypervectors."""
    import numpy as np

    bound = vectors[0][codes // (SYMBOLS * SYMBOLS)] * vectors[1][codes // SYMBOLS % SYMBOLS] * vectors[2][codes % SYMBOLS]
    return counts @ bound.astype(np.float32)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[float]]:
    """Prototypes by language from every row with text and language.

    The result has one vector of ``DIM`` numbers per language: its size is
    bounded by the number of language names, not by the input.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        totals: dict[str, object] = {}
        for batch in slices(batches, "text"):
            by: dict[str, list[str]] = {}
            for name, t in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                by.setdefault(name, []).append(t)
            for name, texts in by.items():
                g, _ = grams(texts)
                found = np.bincount(g, minlength=SYMBOLS**N)
                totals[name] = totals[name] + found if name in totals else found
        vectors = letter_vectors()
        for name, found in totals.items():
            codes = np.flatnonzero(found)
            whole = np.zeros(DIM)
            for a in range(0, len(codes), 20_000):
                part = codes[a : a + 20_000]
                whole += bundle(found[None, part].astype(np.float64), part, vectors)[0]
            yield pa.RecordBatch.from_pydict({"lang": [name], "hv": pa.array([whole.tolist()], pa.list_(pa.float64()))})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    parts = in_batches(rows, run, "lang string, hv array<double>")
    sums = parts.select("lang", F.posexplode("hv").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    whole = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("hv"))  # DIM numbers a language
    found = {}
    for row in whole.select("lang", "hv.x").collect():
        norm = sum(x * x for x in row.x) ** 0.5
        if norm:
            found[row.lang] = [x / norm for x in row.x]
    return found


def predict(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text") -> DataFrame:
    """Every column of ``docs`` with lang_pred and score (the cosine, at least 0)."""
    docs = docs.drop(*(c for c in ("lang_pred", "score") if c != text))
    names = sorted(prototypes)
    held = docs.sparkSession.sparkContext.broadcast([prototypes[n] for n in names])
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    schema["score"].nullable = schema["lang_pred"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        vectors, profile = letter_vectors(), np.array(held.value, np.float32).T
        for batch in slices(batches, text, 1_000_000):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            pred, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for a in range(0, len(texts) if names else 0, 256):
                some = texts[a : a + 256]
                g, doc = grams(some)
                codes, col = np.unique(g, return_inverse=True)
                hv = np.zeros((len(some), DIM), np.float32)
                counts = np.bincount(doc * max(1, len(codes)) + col, minlength=len(some) * len(codes)).reshape(len(some), -1).astype(np.float32)
                for b in range(0, len(codes), 8192):
                    hv += bundle(counts[:, b : b + 8192], codes[b : b + 8192], vectors)
                norm = np.linalg.norm(hv, axis=1)
                cosine = (hv @ profile) / np.maximum(norm, 1e-9)[:, None]
                letters = counts.sum(axis=1) > 0
                best = cosine.argmax(axis=1)
                for i in np.flatnonzero(letters):
                    pred[a + i] = names[best[i]]
                    score[a + i] = float(min(1.0, max(0.0, cosine[i, best[i]])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return in_batches(docs, run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    prototypes = learn(docs.filter(~held_out()))
    rows = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), prototypes)
    return rows.select("doc_id", "held_out", "lang_pred", "score")
