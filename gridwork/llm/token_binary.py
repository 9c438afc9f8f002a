"""Token-ID output in a seekable binary format.

Documents are encoded, sorted by id and written as shards. A shard is

* one zstandard frame for each document: its ids as little-endian unsigned
  32-bit integers, ended by ``end_id``, with zstandard's own content checksum;
* a skippable frame (magic 0x184D2A50) with the documents' ids: signed 64-bit
  integers, and a byte for each that is 1 where the id was null;
* the seek table of zstandard's seekable format: a skippable frame (magic
  0x184D2A5E) with each frame's compressed size, size and low 32 bits of its
  content's XXH64, then the number of frames, a descriptor and the magic
  0x8F92EAB1. As it comes last, a reader finds it from the file's end, and
  then fetches and decompresses only the frames it wants.

Shards are written under a new name by every attempt and count only when the
manifest row that names them is committed, so lost executors and repeated
attempts leave nothing half-written in the result.

Defined results: a null text is an empty text; an empty text has only the end
id; a null doc_id sorts first; rows with equal ids are sorted by text, and each
is a document of its own; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridwork.llm._chunks import SLICE_BYTES, WordColumn, by_separator, by_word_end, gathered, segments
from gridwork.llm._common import fresh_path, in_batches, written

# Fixed values of the zstandard seekable format.
IDS_MAGIC = 0x184D2A50
SEEK_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
HAS_CHECKSUMS = 0x80

#: Bytes of text in a shard, about.
SHARD_BYTES = 256_000_000
#: Bytes of pieces of words that a worker remembers, from one shard to the next.
REMEMBERED = 128_000_000
#: Bytes of text whose distinct words are looked up at a time.
TOGETHER = 8_000_000
#: ASCII white space.
EDGE = re.compile(rb"[\x20\x09-\x0D]")

_MEMORY: list[tuple[str, WordColumn]] = []


def _memory(tokenizer_path: str) -> WordColumn:
    """This worker's chunk memory for a tokenizer that drops white space; a worker has one at a time.

    ASCII white space never lies inside a token of such a tokenizer and no
    normalisation crosses it, so the pieces between may be encoded apart.
    """
    if not _MEMORY or _MEMORY[0][0] != tokenizer_path:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        mark = "<|endoftext|>"
        otherwise = by_word_end(tokenizer, by_separator(tokenizer, mark, tokenizer.token_to_id(mark)))
        _MEMORY[:] = [(tokenizer_path, WordColumn(tokenizer, otherwise, REMEMBERED))]
    return _MEMORY[0][1]


def encoded(memory: WordColumn, texts: pa.Array) -> Iterator[bytes]:
    """The ids of each text; a long text is cut a segment at a time."""
    if len(texts) > 1 or len(text := texts.cast(pa.binary())[0].as_py() or b"") <= SLICE_BYTES:
        return memory(texts)
    return iter([b"".join(x for s in segments(text, EDGE) for x in memory(pa.array([s]).cast(pa.string())))])


def _open(path: str, mode: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))
    if mode == "w":
        store.create_dir(inner.rpartition("/")[0], recursive=True)
        return store.open_output_stream(inner)
    return store.open_input_file(inner)


class ShardWriter:
    """Writes one shard, frame by frame."""

    def __init__(self, path: str, level: int = 3):
        import zstandard

        self.out, self.table, self.ids, self.nulls = _open(path, "w"), [], [], bytearray()
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True).compress

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frame = self.compress(ids)
        self.out.write(frame)
        self.table.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)

    def close(self) -> None:
        n = len(self.table)
        self.out.write(struct.pack(f"<II{n}q", IDS_MAGIC, 9 * n, *self.ids) + bytes(self.nulls))
        self.out.write(struct.pack("<II", SEEK_MAGIC, 12 * n + 9))
        self.out.write(b"".join(struct.pack("<III", *row) for row in self.table))
        self.out.write(struct.pack("<IBI", n, HAS_CHECKSUMS, FOOTER_MAGIC))
        self.out.close()


class ShardReader:
    """Reads documents of a shard; only the frames asked for are fetched and decompressed."""

    def __init__(self, path: str):
        import numpy as np

        self.file = _open(path, "r")
        end = self.file.size()
        self.file.seek(end - 9)
        n, descriptor, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != FOOTER_MAGIC or not descriptor & HAS_CHECKSUMS:
            raise ValueError(f"{path} has no seek table")
        self.file.seek(end - 9 - 12 * n)
        self.table = np.frombuffer(self.file.read(12 * n), "<u4").reshape(n, 3)
        self.file.seek(end - 17 - 12 * n - 9 * n)
        raw = self.file.read(9 * n)
        nulls = raw[8 * n :]
        self.doc_ids = [None if nulls[i] else x for i, x in enumerate(np.frombuffer(raw[: 8 * n], "<i8").tolist())]
        self.begins = [0, *np.cumsum(self.table[:, 0].astype("i8")).tolist()]

    def __len__(self) -> int:
        return len(self.table)

    def ids(self, k: int) -> bytes:
        """The k-th document's ids, checked against its checksum."""
        import xxhash
        import zstandard

        self.file.seek(self.begins[k])
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(int(self.table[k, 0])))
        if len(raw) != self.table[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def close(self) -> None:
        self.file.close()


def write_token_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    Returns the manifest: part (order of the shard), path, n_docs, n_tokens.
    """
    spark = docs.sparkSession
    base = path or fresh_path(spark, "tokens")
    end = struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        memory, out, n = _memory(tokenizer_path), None, 0
        part = TaskContext.get().partitionId()
        name = f"{base}/part-{part:06d}-{uuid.uuid4().hex}.tokens"
        tokens = 0
        for batch in gathered(batches, "text", TOGETHER):
            for doc_id, found in zip(batch.column(0).to_pylist(), encoded(memory, batch.column(1))):
                out = out or ShardWriter(name)
                out.add(doc_id, found + end)
                n, tokens = n + 1, tokens + len(found) // 4 + 1
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [name], "n_docs": [n], "n_tokens": [tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    sort = rows.repartitionByRange(shards, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    return written(in_batches(sort, write, "part long, path string, n_docs long, n_tokens long"), "manifest")


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start, n_tokens, ids (binary), one row per document.

    ``start`` counts the ids of all documents before; it comes from a running
    sum over the manifest, which has one row per shard.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    shards = shards.select("path", "first").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard, rows, held = ShardReader(path), [], 0
                for k in range(len(shard)):
                    raw = shard.ids(k)
                    rows.append((shard.doc_ids[k], start, len(raw) // 4, raw))
                    start, held = start + len(raw) // 4, held + len(raw)
                    if held > 4_000_000 or k == len(shard) - 1:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "n_tokens", "ids"])
                        rows, held = [], 0
                shard.close()

    return in_batches(shards, read, "doc_id long, start long, n_tokens long, ids binary")


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write, read back and digest: doc_id, start, n_tokens, ids_crc32."""
    rows = read_token_shards(write_token_shards(docs, tokenizer_path, end_id))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
