"""Token ids of documents in sorted-string-table shards.

A shard is one file of documents in ascending key order:

- blocks: entries ``shared u8 | rest u8 | n_tokens varint | rest of key | ids``, where a key drops the bytes it shares with
  the one before in its block, and ids are little-endian u16 (``kind`` 2) or u32 (4); a block is one zstandard frame;
- Bloom filter: bits over all keys; sparse index: first key, offset, length and kind of each block;
- footer: places of filter and index, number of documents and of ids, magic.

A key is the doc_id as 8 big-endian bytes with its sign bit turned, so that bytes sort as numbers; a null doc_id has the
empty key and comes first. A lookup asks the filter, searches the index and reads one block.
Shards are written under names of their own by range of doc_id in the cluster's shared folder and moved into place whole,
so a task that runs again after a lost executor writes the same file again.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fresh_path, written

MAGIC = b"FOLIOSST"
FOOTER = struct.Struct("<QQQQQQ8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Words whose ids a task remembers; then it forgets them all.
CACHE_WORDS = 300_000


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) % 2**64)


def doc_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def bloom_places(key: bytes, bits: int) -> list[int]:
    one, two = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(one + k * (two | 1)) % 2**64 % bits for k in range(BLOOM_HASHES)]


class Writer:
    """Appends documents in key order to an open binary file."""

    def __init__(self, file):
        self.file, self.at, self.index, self.keys = file, 0, [], []
        self.packer = zstandard.ZstdCompressor(level=1)
        self.docs = self.ids = 0
        self.start()

    def start(self) -> None:
        self.block, self.size, self.last, self.first, self.kind = [], 0, b"", None, 2

    def add(self, key: bytes, ids: np.ndarray) -> None:
        kind = 2 if not len(ids) or ids.max() < 1 << 16 else 4
        if self.first is not None and (self.size >= BLOCK_BYTES or kind != self.kind):
            self.flush()
        if self.first is None:
            self.first, self.kind = key, kind
        same = 0
        while same < min(len(key), len(self.last)) and key[same] == self.last[same]:
            same += 1
        body = ids.astype("<u2" if kind == 2 else "<u4").tobytes()
        self.block.append(bytes((same, len(key) - same)) + varint(len(ids)) + key[same:] + body)
        self.size += len(self.block[-1])
        self.last = key
        self.keys.append(hashlib.blake2b(key, digest_size=16).digest())
        self.docs += 1
        self.ids += len(ids)

    def flush(self) -> None:
        if self.first is not None:
            packed = self.packer.compress(b"".join(self.block))
            self.file.write(packed)
            self.index.append((self.first, self.at, len(packed), self.kind))
            self.at += len(packed)
        self.start()

    def close(self) -> None:
        self.flush()
        bits = max(64, (BLOOM_BITS * self.docs + 63) // 64 * 64)
        bloom = np.zeros(bits // 8, np.uint8)
        pairs = np.frombuffer(b"".join(self.keys), "<u8").reshape(-1, 2)
        for k in range(BLOOM_HASHES):
            place = (pairs[:, 0] + np.uint64(k) * (pairs[:, 1] | np.uint64(1))) % np.uint64(bits)
            np.bitwise_or.at(bloom, (place >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (place & np.uint64(7)).astype(np.uint8)))
        table = b"".join(bytes((len(k),)) + k + struct.pack("<QIB", at, n, kind) for k, at, n, kind in self.index)
        self.file.write(bloom.tobytes() + table)
        self.file.write(FOOTER.pack(self.at, len(bloom), len(table), len(self.index), self.docs, self.ids, MAGIC))


class Reader:
    """Reads one shard: all documents in order, or one by its key."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - FOOTER.size)
        at, bloom, table, n, self.docs, self.ids, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        file.seek(at)
        self.bloom, rest = file.read(bloom), file.read(table)
        self.index, p = [], 0
        for _ in range(n):
            key = rest[p + 1 : p + 1 + rest[p]]
            p += 1 + rest[p]
            self.index.append((key, *struct.unpack_from("<QIB", rest, p)))
            p += 13
        self.unpacker = zstandard.ZstdDecompressor()

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n, kind = self.index[k]
        self.file.seek(at)
        data, p, last = self.unpacker.decompress(self.file.read(n)), 0, b""
        while p < len(data):
            same, rest = data[p], data[p + 1]
            p, shift, count = p + 2, 0, 0
            while True:
                count |= (data[p] & 127) << shift
                shift, p = shift + 7, p + 1
                if data[p - 1] < 128:
                    break
            last = last[:same] + data[p : p + rest]
            p += rest
            yield last, np.frombuffer(data, f"<u{kind}", count, p)
            p += count * kind

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document of this key: none without reading a block if the filter says so."""
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, 8 * len(self.bloom))):
            return []
        firsts = [x[0] for x in self.index]
        k, found = max(bisect.bisect_left(firsts, key) - 1, 0), []
        while k < len(firsts) and firsts[k] <= key:
            found += [ids for own, ids in self.block(k) if own == key]
            k += 1
        return found


class Encoder:
    """Ids of texts, as the tokenizers library encodes each whole text, as little-endian u32 bytes.

    The tokenizer drops white space and never joins what it parts, so the words between white space are encoded by
    themselves and remembered. Its pattern also parts letters from other signs: a word of letters with signs behind is two
    pieces, of which each goes to the library's model as the normalizer and the byte table would hand it over; any other
    word goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        # a byte's sign in the tokenizer's table: itself where it prints, else the next free code point from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.table = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}

    def piece(self, text: str) -> bytes:
        found = self.pieces.get(text)
        if found is None:
            signs = text if text.isascii() else text.encode().decode("latin-1").translate(self.table)
            found = self.pieces[text] = np.array([t.id for t in self.model.tokenize(signs)], "<u4").tobytes()
        return found

    def word(self, word: str) -> bytes:
        core = word.rstrip(SIGNS)
        low = core.lower()
        if low.isalpha() and core.isalpha() and (core.isascii() or ("\u03a3" not in core and unicodedata.is_normalized("NFC", word))):
            return self.piece(low) + (self.piece(word[len(core) :]) if len(core) < len(word) else b"")
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        for gap in GAPS:
            if gap in text:
                text = text.replace(gap, " ")
        words = text.split(" ")
        new = {w for w in words if w not in self.words}
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
            new = set(words)
        if len(self.pieces) > CACHE_WORDS:
            self.pieces.clear()
        self.words.update((w, self.word(w) if w else b"") for w in new)
        return b"".join(map(self.words.__getitem__, words))


#: ASCII signs that end a word as a piece of their own; an apostrophe may begin one with letters.
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")
GAPS = "\t\n\v\f\r"
#: A Python worker keeps its encoder from task to task.
_ENCODERS: dict[str, Encoder] = {}


def encoder(tokenizer_file: str) -> Encoder:
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def write_shards(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Writes all texts' ids, ``end_id`` after each, and returns ``(path, shard, low, n_docs, n_ids, n_bytes)`` of the files in order of doc_id.

    A null text is an empty one. doc_ids ascend through the files, a null doc_id first; rows of one doc_id stay together,
    equal ones in order of their texts. An empty table makes no file.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "token-ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get()
        writer, encode, end, first = None, encoder(tokenizer_file), struct.pack("<I", end_id), None
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                if writer is None:
                    files, base = pafs.FileSystem.from_uri(folder)
                    files.create_dir(base, recursive=True)
                    name = f"{base}/part-{at.partitionId():06d}.sst"
                    trial = f"{base}/.{at.partitionId():06d}-{at.taskAttemptId()}.tmp"
                    stream, first = files.open_output_stream(trial), doc_id
                    writer = Writer(stream)
                writer.add(key_of(doc_id), np.frombuffer(encode(text or "") + end, "<u4"))
        if writer is not None:
            writer.close()
            size = stream.tell()
            stream.close()
            try:
                files.move(trial, name)
            except OSError:  # another attempt of this task was first, with the same file
                if files.get_file_info(name).type != pafs.FileType.File:
                    raise
                files.delete_file(trial)
            row = [[f"{folder}/part-{at.partitionId():06d}.sst"], [at.partitionId()], [first], [writer.docs], [writer.ids], [size]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.string()] + [pa.int64()] * 5)], names=["path", "shard", "low", "n_docs", "n_ids", "n_bytes"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sorted_docs = plain.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return written(sorted_docs.mapInArrow(run, "path string, shard long, low long, n_docs long, n_ids long, n_bytes long"), "token-files")


def read_shards(files: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document in the files that ``write_shards`` wrote.

    start: ids of all documents before it; ids_crc32: of the ids as little-endian u32.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, size in zip(*(batch.column(k).to_pylist() for k in range(3))):
                system, place = pafs.FileSystem.from_uri(path)
                with system.open_input_file(place) as file:
                    rows = []
                    for key, ids in Reader(file, size):
                        rows.append((doc_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # one row a file: the running sum is over as many rows as there are files
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.select("path", "start", "n_bytes").repartition(parts, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    return read_shards(write_shards(docs, tokenizer_file, end_id))
