"""Tokenising by memorised chunks.

A text is cut where no token can cross; every chunk's ids are looked up in a
worker's memory and only unseen chunks go through the tokenizer library, many
at a time. The memory is bounded in bytes, and ``released`` gives it back when
a partition ends: workers outlive their task, and several share an executor.
"""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa

#: Bytes that a worker remembers, about (text, ids and the dictionary's own); bytes of text of the longest remembered chunk.
MEMORY_BYTES, LONGEST = 24_000_000, 64
#: Bytes of text encoded at a time.
SLICE_BYTES = 1_000_000
#: What an entry takes besides the bytes it holds: two objects and its place in the table.
ENTRY = 220


class ChunkMemory:
    """chunk -> ids as little-endian unsigned 32-bit integers."""

    def __init__(self, encode_many: Callable[[list], list[bytes]], limit: int = MEMORY_BYTES):
        self.encode_many, self.limit, self.known, self.held = encode_many, limit, {}, 0

    def encode(self, texts: list[list]) -> Iterator[bytes]:
        """The ids of each list of chunks, joined."""
        known = self.known
        missing = [c for c in set().union(*texts) if c not in known]
        extra: dict = {}  # chunks of this call that are not remembered
        if missing:
            if self.held > self.limit:
                known.clear()
                self.held = 0
                missing = list(set().union(*texts))
            for c, ids in zip(missing, self.encode_many(missing)):
                if len(c) <= LONGEST and self.held <= self.limit:
                    known[c] = ids
                    self.held += ENTRY + len(c) + len(ids)
                else:
                    extra[c] = ids
        if extra:
            get = lambda c: known[c] if c in known else extra[c]
        else:
            get = known.__getitem__
        for chunks in texts:
            yield b"".join(map(get, chunks))

    def clear(self) -> None:
        self.known.clear()
        self.held = 0


class LastingMemory(ChunkMemory):
    """A memory that outlives partitions: when half its bytes are taken by new chunks, those not met since the last time are forgotten; chunks in use stay."""

    def __init__(self, encode_many: Callable[[list], list[bytes]], limit: int):
        super().__init__(encode_many, limit // 2)
        self.old: dict = {}

    def ids(self, chunks: list) -> list[bytes]:
        """The ids of each of these chunks, which are distinct."""
        if self.held > self.limit:
            self.old, self.known, self.held = self.known, {}, 0
        known, old = self.known, self.old
        out = list(map(known.get, chunks))
        lacking = [i for i, x in enumerate(out) if x is None]
        missing = []
        for i in lacking:
            out[i] = old.get(chunks[i])
            if out[i] is None:
                missing.append(i)
        if missing:
            for i, ids in zip(missing, self.encode_many([chunks[i] for i in missing])):
                out[i] = ids
        for i in lacking:
            c = chunks[i]
            if len(c) <= LONGEST and self.held <= self.limit:
                known[c] = out[i]
                self.held += ENTRY + len(c) + len(out[i])
        return out

    def encode(self, texts: list[list]) -> Iterator[bytes]:
        chunks = list(set().union(*texts))
        get = dict(zip(chunks, self.ids(chunks))).__getitem__
        for text in texts:
            yield b"".join(map(get, text))

    def clear(self) -> None:
        super().clear()
        self.old = {}


@contextmanager
def released(*memories):
    """Clears ``memories`` at the end of a partition and gives freed pages back to the system."""
    try:
        yield
    finally:
        for m in memories:
            m.clear()
        trim()


def settle() -> None:
    """Keeps a worker small: two threads for the tokenizers library, and two arenas for what they allocate."""
    os.environ.setdefault("RAYON_NUM_THREADS", "2")
    _libc("mallopt", -8, 2)  # M_ARENA_MAX


def trim() -> None:
    pa.default_memory_pool().release_unused()
    _libc("malloc_trim", 0)


def _libc(name: str, *arguments: int) -> None:
    try:
        getattr(ctypes.CDLL("libc.so.6"), name)(*arguments)
    except (OSError, AttributeError):  # not glibc
        pass


def segments(text, edge: re.Pattern, limit: int = SLICE_BYTES) -> Iterator:
    """A text (str or bytes) in pieces of about ``limit``, each but the first beginning with a match of ``edge``, so that a text of any length is cut a piece at a time."""
    at = 0
    while len(text) - at > limit and (m := edge.search(text, at + limit)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


def by_separator(tokenizer, mark: str, mark_id: int, joined: int = 400, marks_are_text: bool = False) -> Callable[[list[str]], list[bytes]]:
    """An ``encode_many`` that joins chunks by a special token, which keeps them apart, and cuts the ids at it.

    Chunks that might hold a special token's name go one by one; with
    ``marks_are_text`` such a name is ordinary text there.
    """
    import numpy as np

    def encode_many(chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if "<" not in c]
        groups = [plain[i : i + joined] for i in range(0, len(plain), joined)]
        for a in range(0, len(groups), 32):
            found = tokenizer.encode_batch_fast([mark.join(chunks[i] for i in g) for g in groups[a : a + 32]], add_special_tokens=False)
            for g, e in zip(groups[a : a + 32], found):
                ids = np.array(e.ids, dtype="<u4")
                cuts = np.flatnonzero(ids == mark_id)
                raw, begin = ids.tobytes(), 0
                for i, end in zip(g, [*cuts.tolist(), len(ids)]):
                    out[i] = raw[4 * begin : 4 * end]
                    begin = end + 1
        odd = [i for i, c in enumerate(chunks) if "<" in c]
        if odd:
            tokenizer.encode_special_tokens = marks_are_text
            for i, e in zip(odd, tokenizer.encode_batch_fast([chunks[i] for i in odd], add_special_tokens=False)):
                out[i] = np.array(e.ids, dtype="<u4").tobytes()
            tokenizer.encode_special_tokens = False
        return out

    return encode_many


def by_word_end(tokenizer, otherwise: Callable[[list[str]], list[bytes]], joined: int = 400, fits: Callable[[str], bool] = str.isalpha) -> Callable[[list[str]], list[bytes]]:
    """An ``encode_many`` that joins chunks that fit, by default those of letters, by blanks and cuts the ids behind each token that ends a word.

    That is cheaper than a special token between all chunks. Every chunk ends at
    least one word; where a group has as many ends as chunks, each is exactly one.
    Other groups and chunks, and those of a tokenizer whose tokens don't show a
    word's end, go to ``otherwise``.
    """
    import json

    import numpy as np

    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
    if not suffix:
        return otherwise
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    ends_word = np.zeros(max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1, dtype=bool)
    ends_word[[i for t, i in vocab.items() if t.endswith(suffix)]] = True

    def encode_many(chunks: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(chunks)
        words, rest = [], []
        for i, c in enumerate(chunks):
            (words if fits(c) else rest).append(i)
        groups = [words[i : i + joined] for i in range(0, len(words), joined)]
        for a in range(0, len(groups), 32):
            found = tokenizer.encode_batch_fast([" ".join([chunks[i] for i in g]) for g in groups[a : a + 32]], add_special_tokens=False)
            for g, e in zip(groups[a : a + 32], found):
                ids = np.array(e.ids, dtype="<u4")
                ends = np.flatnonzero(ends_word[ids]) + 1
                if len(ends) != len(g) or ends[-1] != len(ids):
                    rest += g
                    continue
                raw, begin = ids.tobytes(), 0
                for i, end in zip(g, (4 * ends).tolist()):
                    out[i] = raw[begin:end]
                    begin = end
        for i, ids in zip(rest, otherwise([chunks[i] for i in rest])):
            out[i] = ids
        return out

    return encode_many


# How the public word tokenizer normalises and cuts a text.
WORD_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of ASCII, without the mark that special tokens begin with, and of the Latin-1 letters that stay one letter in lower case and are composed already; the same cut for lines of them, in lower case.
PLAIN = r"^[!-;=-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00DF-\u00F6\u00F8-\u00FF]+|[0-9]|[^\na-z0-9\u00DF-\u00F6\u00F8-\u00FF]+|\n")


class WordColumn:
    """Encodes columns of texts, for a tokenizer that drops white space.

    Arrow cuts the texts at ASCII white space, numbers their distinct chunks and
    puts the chunks' ids in the order of the texts. Plain chunks are lowered and cut
    as the tokenizer does, and the pieces' ids are remembered within ``limit`` bytes:
    capitals and marks beside a word make no new piece. New pieces go through the
    same model without the normalisation and cut that are done already. Chunks that
    aren't plain, and all chunks of a tokenizer that normalises or cuts in another
    way, go to ``otherwise`` and are remembered within a quarter of ``limit``.
    """

    def __init__(self, tokenizer, otherwise: Callable[[list[str]], list[bytes]], limit: int):
        import json

        from tokenizers import Tokenizer

        self.whole, self.pieces = LastingMemory(otherwise, limit // 4), None
        made = json.loads(tokenizer.to_str())
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        split = {"type": "Split", "pattern": {"Regex": WORD_SPLIT}, "behavior": "Removed", "invert": True}
        if (made["normalizer"] or {}).get("normalizers") == WORD_NORMALIZER and steps[0] == split:
            made["normalizer"], steps[0] = None, {"type": "WhitespaceSplit"}
            many = by_word_end(Tokenizer.from_str(json.dumps(made)), otherwise, joined=50, fits=lambda piece: True)
            self.pieces = LastingMemory(many, limit)

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text (null: none)."""
        import numpy as np
        import pyarrow.compute as pc

        cut = pc.ascii_split_whitespace(texts)
        begins = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy(zero_copy_only=False))])
        words = cut.flatten().dictionary_encode()
        if not len(words):
            yield from (b"" for _ in range(len(texts)))
            return
        chunks = words.dictionary
        plain = pc.match_substring_regex(chunks, PLAIN) if self.pieces else pa.array([False] * len(chunks))
        rest = _joined(chunks.filter(pc.invert(plain))).split("\n")[:-1]
        found = pa.concat_arrays([self._plain(_joined(chunks.filter(plain)).lower()), pa.array(self.whole.ids(rest), pa.large_binary())])
        # Plain chunks come first in ``found``: the places of both kinds.
        mask = plain.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask), mask.sum() + np.cumsum(~mask)) - 1
        ids = found.take(pa.array(place[words.indices.to_numpy()]))
        raw = ids.buffers()[2]
        at = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[begins].tolist()
        for a, b in zip(at, at[1:]):
            yield raw.slice(a, b - a).to_pybytes()

    def _plain(self, lines: str) -> pa.Array:
        """The ids of each line."""
        import numpy as np

        pieces = pa.array(PLAIN_SPLIT.findall(lines), pa.string()).dictionary_encode()
        names = pieces.dictionary.to_pylist()
        line_end = names.index("\n") if names else 0
        known = self.pieces.ids([*names[:line_end], *names[line_end + 1 :]]) if names else []
        ids = pa.array([*known[:line_end], b"", *known[line_end:]], pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1)[1:][pieces.indices.to_numpy() == line_end] if names else []
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.array([0, *ends], "<i8")), ids.buffers()[2]])


def _joined(chunks: pa.Array) -> str:
    """Chunks, which hold no line break, as lines."""
    import pyarrow.compute as pc

    whole = pa.ListArray.from_arrays(pa.array([0, len(chunks)], pa.int32()), chunks)
    return pc.binary_join(whole, "\n")[0].as_py() + "\n" if len(chunks) else ""


def slices(batches: Iterable[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes of text, at least one row each."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype("i8")) // limit
        begins = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(begins, begins[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def gathered(batches: Iterable[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a text of more than SLICE_BYTES comes alone."""
    import pyarrow.compute as pc

    held, size = [], 0
    for batch in slices(batches, text):
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        more = pc.sum(sizes).as_py()
        long = sizes[0].as_py() > SLICE_BYTES  # such a text begins a slice
        if held and (long or size + more > limit):
            yield pa.concat_batches(held)
            held, size = [], 0
        if long:
            yield batch.slice(0, 1)
            batch, more = batch.slice(1), more - sizes[0].as_py()
        if batch.num_rows:
            held.append(batch)
            size += more
    if held:
        yield pa.concat_batches(held)
