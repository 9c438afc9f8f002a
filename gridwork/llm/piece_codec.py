"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; the normaliser, the metaspace marker,
the scores (unigram pieces, or merges ranked by score) and byte fallback are
rebuilt as a ``tokenizers.Tokenizer``. Texts are encoded in batches, many
chunks at a time with the library's own threads. Parity with the sentencepiece
library is checked on every distinct chunk a worker meets; as texts are cut
only where no piece can cross, chunk parity is text parity. A chunk that differs
takes that library's ids and is counted.

Defined results: a null text encodes to null and decodes to null; an empty text
encodes to no ids and decodes to an empty text. U+2581 in a text stands for a
space, as in the sentencepiece library itself. Ids out of range raise. Texts of
any length are encoded whole, a segment at a time; repeated rows are encoded
alike; an empty table gives no rows; a column named as the result is replaced,
all others are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridwork.llm._chunks import ChunkMemory, by_separator, released, segments, slices
from gridwork.llm._common import in_batches

MARK = "▁"
#: Fixed values of the model file: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
CUT = "<|cut|>"
#: The first space of a run.
EDGE = re.compile("(?<! ) ")


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number and varint, fixed or length-delimited value."""
    i, n = 0, len(buf)

    def varint(i: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = buf[i]
            value |= (b & 127) << shift
            i, shift = i + 1, shift + 7
            if b < 128:
                return value, i

    while i < n:
        key, i = varint(i)
        wire = key & 7
        if wire == 0:
            value, i = varint(i)
        elif wire == 2:
            size, i = varint(i)
            value, i = buf[i : i + size], i + size
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            value, i = buf[i : i + size], i + size
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, value


@lru_cache(maxsize=4)
def parse_model(path: str) -> dict:
    """Pieces (text, score, kind) and the settings that encoding depends on."""
    import struct

    with open(path, "rb") as f:
        raw = f.read()
    model = {"pieces": [], "type": UNIGRAM, "byte_fallback": False, "charsmap": b"", "dummy_prefix": True, "strip": True}
    for number, value in _fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode("utf-8")
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            model["pieces"].append((piece, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    model["type"] = v
                elif k == 35:
                    model["byte_fallback"] = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    model["charsmap"] = v
                elif k == 3:
                    model["dummy_prefix"] = bool(v)
                elif k == 4:
                    model["strip"] = bool(v)
    return model


def build_tokenizer(path: str, whole_texts: bool = True, cut_token: bool = False):
    """The model as a ``tokenizers.Tokenizer``.

    ``whole_texts`` False leaves out the leading marker: the caller gives chunks
    that bear it already. With ``cut_token`` the special token ``CUT`` keeps chunks apart.
    """
    from tokenizers import AddedToken, Tokenizer, decoders, models, normalizers

    m = parse_model(path)
    unk = next((i for i, p in enumerate(m["pieces"]) if p[2] == UNKNOWN), None)
    if m["type"] == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m["pieces"]], unk_id=unk, byte_fallback=m["byte_fallback"])
    elif m["type"] == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m["pieces"])}
        merges = []
        for piece, score, kind in m["pieces"]:
            if kind in (NORMAL, USER_DEFINED):
                for k in range(1, len(piece)):
                    if piece[:k] in vocab and piece[k:] in vocab:
                        merges.append((-score, vocab[piece], vocab[piece[:k]], piece[:k], piece[k:]))
        merges.sort(key=lambda x: x[:3])
        model = models.BPE(vocab, [(a, b) for *_, a, b in merges], unk_token=m["pieces"][unk][0] if unk is not None else None, byte_fallback=m["byte_fallback"], fuse_unk=True)
    else:
        raise ValueError(f"model type {m['type']} is not supported")
    tokenizer = Tokenizer(model)
    steps = [normalizers.Precompiled(m["charsmap"])] if m["charsmap"] else []
    if m["strip"]:
        steps += [normalizers.Strip(), normalizers.Replace(pattern("  +"), " ")]
    if whole_texts and m["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    if cut_token:
        tokenizer.add_special_tokens([AddedToken(CUT, special=True, normalized=False)])
    own = [AddedToken(p, normalized=False) for p, _, k in m["pieces"] if k == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


def pattern(text: str):
    from tokenizers import Regex

    return Regex(text)


def separable(path: str) -> bool:
    """Whether chunks that begin with a run of markers can be encoded apart: no piece has a marker after another character, and the normaliser is the identity."""
    m = parse_model(path)
    return not m["charsmap"] and not m["strip"] and m["dummy_prefix"] and m["type"] == BPE and not any(k == USER_DEFINED or MARK in p.lstrip(MARK) for p, _, k in m["pieces"] if k != CONTROL)


def cut(text: str, inside: bool = False) -> list[str]:
    """Chunks of a text without markers, each without its first space; the text gets the leading space first.

    ``inside``: the text is a later segment, whose first space is already taken off.
    """
    if not text:
        return [""] if inside else []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [c[1:] for c in re.findall(r" +[^ ]+| +", " " + text)]


class _Codec:
    """A worker's tokenizer, chunk memory and decoding table."""

    def __init__(self, path: str):
        import numpy as np

        self.path, self.reference = path, None
        self.fallen: set[str] = set()  # chunks that took the sentencepiece library's ids
        m = parse_model(path)
        self.table = [bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, _, k in m["pieces"]]
        self.prefixed = m["dummy_prefix"]
        for i, (_, _, k) in enumerate(m["pieces"]):
            if k == UNKNOWN:
                self.table[i] = " ⁇ ".encode()
        if separable(path):
            tokenizer = build_tokenizer(path, whole_texts=False, cut_token=True)
            many = by_separator(tokenizer, CUT, tokenizer.token_to_id(CUT), marks_are_text=True)
            mine = lambda chunks: many([MARK + c for c in chunks])
            # A later segment begins with a space that ``cut`` would put there.
            self.cut = lambda text: [c for i, s in enumerate(segments(text.replace(MARK, " "), EDGE)) for c in cut(s[1:] if i else s, bool(i))]
        else:
            whole = build_tokenizer(path)
            mine = lambda texts: [np.array(e.ids, "<u4").tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
            self.cut = lambda text: [text] if text else []

        def encode_many(chunks: list[str]) -> list[bytes]:
            return self.compared(mine(chunks), chunks) if self.reference else mine(chunks)

        self.memory = ChunkMemory(encode_many)

    def compared(self, found: list[bytes], texts: list[str]) -> list[bytes]:
        """``found`` with the sentencepiece library's ids where they differ; such chunks are remembered."""
        import numpy as np

        # An empty chunk is a lone marker here, and nothing at all to the library.
        both = [i for i, t in enumerate(texts) if t]
        for a in range(0, len(both), 5_000):
            part = both[a : a + 5_000]
            theirs = self.reference.encode([texts[i] for i in part], num_threads=1)
            sizes = [len(x) for x in theirs]
            if sizes != [len(found[i]) // 4 for i in part] or b"".join([found[i] for i in part]) != np.fromiter(chain.from_iterable(theirs), "<u4", sum(sizes)).tobytes():
                for i, y in zip(part, theirs):
                    raw = np.array(y, "<u4").tobytes()
                    if found[i] != raw:
                        found[i] = raw
                        self.fallen.add(texts[i])
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return list(self.memory.encode([self.cut(t or "") for t in texts]))

    def n_fallen(self, text: str) -> int:
        return sum(c in self.fallen for c in self.cut(text)) if self.fallen else 0

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.table.__getitem__, ids))
        return (raw[1:] if self.prefixed and raw[:1] == b" " else raw).decode("utf-8", "replace")

    def clear(self) -> None:
        self.memory.clear()
        self.fallen.clear()


_CODEC: list[_Codec] = []


def _codec(path: str, verify: bool = False) -> _Codec:
    """This worker's codec; it has one at a time."""
    if not _CODEC or _CODEC[0].path != path:
        _CODEC[:] = [_Codec(path)]
    if verify and not _CODEC[0].reference:
        import sentencepiece

        _CODEC[0].reference = sentencepiece.SentencePieceProcessor(model_file=path)
        _CODEC[0].clear()
    return _CODEC[0]


def encode(df: DataFrame, model_path: str, text: str = "text", to: str = "ids", verify: bool = True) -> DataFrame:
    """Every column of ``df`` and ``to``: the text's ids as array<int>; a column of that name is replaced.

    With ``verify`` a chunk whose ids differ from the sentencepiece library's
    takes those instead: a wrong token stream is never returned.
    """
    df = df.drop(to) if to != text else df
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = _codec(model_path, verify)
        with released(codec):
            for batch in slices(batches, text):
                texts = batch.column(batch.schema.get_field_index(text))
                ids = [np.frombuffer(raw, "<i4") for raw in codec.encode(texts.to_pylist())]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "i4")])), mask=texts.is_null() if texts.null_count else None)
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, to])

    return in_batches(df, run, schema)


def decode(df: DataFrame, model_path: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Every column of ``df`` and ``to``: the text that the ids stand for; a column of that name is replaced. Bytes that are not UTF-8 become U+FFFD."""
    df = df.drop(to) if to != ids else df
    schema = T.StructType([*df.schema.fields, T.StructField(to, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            out = [codec.decode(column[k].values.to_numpy().tolist()) if column[k].is_valid else None for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, to])

    return in_batches(df, run, schema)


def codec_report(docs: DataFrame, model_path: str) -> DataFrame:
    """Encode and decode whole texts: doc_id, n_chars, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip, n_fallen (chunks that took the sentencepiece library's ids).

    Both directions run on the same Arrow batch, so only digests leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        codec = _codec(model_path, True)
        with released(codec):
            for batch in slices(batches, "text"):
                texts = batch.column(1).to_pylist()
                found = codec.encode(texts)
                same = [t is not None and codec.decode(np.frombuffer(raw, "<u4").tolist()) == t.replace(MARK, " ") for t, raw in zip(texts, found)]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0),
                    pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                    pa.array([None if t is None else len(raw) // 4 for t, raw in zip(texts, found)], pa.int64()),
                    pa.array([None if t is None else zlib.crc32(raw) for t, raw in zip(texts, found)], pa.int64()),
                    pa.array([None if t is None else x for t, x in zip(texts, same)], pa.bool_()),
                    pa.array([None if t is None else codec.n_fallen(t) for t in texts], pa.int64()),
                ], ["doc_id", "n_chars", "n_tokens", "ids_crc32", "round_trip", "n_fallen"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return in_batches(docs, run, "doc_id long, n_chars long, n_tokens long, ids_crc32 long, round_trip boolean, n_fallen long")
