"""Operator 8, token ids in sorted-string-table shards.

*File.* Blocks of about ``BLOCK_BYTES``, then the block index, a Bloom filter and a footer of fixed size.

* An entry is: how many bytes its key shares with the last key, how many follow, how many bytes the value has
  (three varints), then the rest of the key and the value. Every ``RESTART`` entries the key is whole; a block ends with
  the places of these entries (unsigned 32-bit) and their number. Blocks are compressed and carry a CRC-32.
* The index has for each block its last key, place and lengths.
* The filter has ``BLOOM_BITS`` bits a key, set by double hashing.
* The footer has the places of index and filter, the numbers of keys and ids, and a magic number.

A key is a byte and, unless the identifier is null, its 64 bits, sign turned, most significant byte first, so
keys sort as identifiers do and null comes first. A value is the ids' width in bytes (2 or 4), then the ids,
little-endian. :class:`Shard` looks a key up: filter, binary search of the index, binary search of the block's restarts.

*Writing.* Documents are dealt out by ranges of (identifier, hash of the text), so a repeated identifier
doesn't burden one task, and sorted in each range. There are as many ranges as their texts have times ``RANGE_BYTES``, so neither a task nor what it keeps for a shard's filter
grows with the input. A task encodes and writes its range under a name of its attempt alone; the manifest names the attempts that count, and files of lost ones stay unread. The driver sees one row for each shard.

*Reading.* A task for each shard; ids before a shard are the sums of the shards before it.

Defined results: a null text is the empty text and has only the end id; documents with equal identifiers are
all kept, one after another, in the order of their texts' hashes; a null identifier sorts first; an empty
table gives no shards and no rows; other columns aren't looked at.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import picked, scratch, ship, table, text_or_empty, tokenizer_path
from .tokens import coder, encoded
from .warc import _place

BLOCK_BYTES = 1 << 16
RESTART = 16
RANGE_BYTES = 1 << 26
BLOOM_BITS = 10
BLOOM_HASHES = 7
MAGIC = b"FSSTv1\r\n"
FOOTER = struct.Struct("<QQQQQQ8s")
LEVEL = 1


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (doc_id & 0xFFFFFFFFFFFFFFFF) ^ (1 << 63))


def id_of(key: bytes) -> int | None:
    if len(key) == 1:
        return None
    n = struct.unpack(">Q", key[1:])[0] ^ (1 << 63)
    return n - (1 << 64) if n >> 63 else n


def value_of(ids: np.ndarray) -> bytes:
    width = 4 if len(ids) and int(ids.max()) > 0xFFFF else 2
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def ids_of(value: bytes) -> np.ndarray:
    return np.frombuffer(value, f"<u{value[0]}", offset=1).astype("<u4")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


class Writer:
    """Takes entries in the order of their keys."""

    def __init__(self, sink):
        self.sink, self.at, self.index, self.hashes = sink, 0, [], []
        self.n_ids = 0
        self._new()

    def _new(self) -> None:
        self.body, self.restarts, self.count, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.count % RESTART == 0:
            self.restarts.append(len(self.body))
        else:
            for a, b in zip(key, self.last, strict=False):
                if a != b:
                    break
                shared += 1
        value = value_of(ids)
        self.body += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count += 1
        self.last = key
        self.n_ids += len(ids)
        self.hashes.append(xxhash.xxh64_intdigest(key))
        if len(self.body) >= BLOCK_BYTES:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if not self.count:
            return
        raw = bytes(self.body) + struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
        packed = zlib.compress(raw, LEVEL)
        self.index.append((self.last, self.at, len(packed)))
        self._put(packed + struct.pack("<I", zlib.crc32(raw)))
        self._new()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(_varint(len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        bloom_at = self.at
        self._put(bloom_of(np.array(self.hashes, np.uint64)))
        self._put(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.hashes), self.n_ids, MAGIC))


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    step = (hashes >> np.uint64(33)) | np.uint64(1)
    return (hashes[:, None] + np.arange(BLOOM_HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(size)


def bloom_of(hashes: np.ndarray) -> bytes:
    size = max(64, len(hashes) * BLOOM_BITS // 8 * 8 + 8)
    bits = np.zeros(size, np.uint8)
    bits[_bits(hashes, size).ravel().astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


class Shard:
    """Reads one file; ``source`` is random-access (seek and read)."""

    def __init__(self, source):
        self.source = source
        source.seek(0, 2)
        source.seek(source.tell() - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.n_docs, self.n_ids, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a sorted-string table")
        source.seek(index_at)
        raw = source.read(index_n)
        self.index, at = [], 0
        while at < len(raw):
            n, at = _unvarint(raw, at)
            key = raw[at : at + n]
            place, size = struct.unpack_from("<QI", raw, at + n)
            self.index.append((key, place, size))
            at += n + 12
        source.seek(bloom_at)
        self.bloom = source.read(bloom_n)

    def may_have(self, key: bytes) -> bool:
        h = np.array([xxhash.xxh64_intdigest(key)], np.uint64)
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(h, len(self.bloom) * 8).ravel().tolist())

    def _block(self, i: int) -> tuple[bytes, list[int], int]:
        _, at, n = self.index[i]
        self.source.seek(at)
        data = self.source.read(n + 4)
        raw = zlib.decompress(data[:n])
        if zlib.crc32(raw) != struct.unpack_from("<I", data, n)[0]:
            raise ValueError("a block doesn't match its checksum")
        (count,) = struct.unpack_from("<I", raw, len(raw) - 4)
        end = len(raw) - 4 * (count + 1)
        return raw, list(struct.unpack_from(f"<{count}I", raw, end)), end

    @staticmethod
    def _entries(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < end:
            shared, at = _unvarint(raw, at)
            rest, at = _unvarint(raw, at)
            size, at = _unvarint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            yield key, raw[at + rest : at + rest + size]
            at += rest + size

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            raw, _, end = self._block(i)
            for k, v in self._entries(raw, 0, end):
                yield k, ids_of(v)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, found = key_of(doc_id), []
        if not self.may_have(key):
            return found
        i = bisect_left(self.index, (key,))
        while i < len(self.index):
            raw, restarts, end = self._block(i)
            whole = [next(self._entries(raw, r, end))[0] for r in restarts]
            for k, v in self._entries(raw, restarts[max(0, bisect_left(whole, key) - 1)], end):
                if k == key:
                    found.append(ids_of(v))
                elif k > key:
                    return found
            i += 1
        return found


def write_tables(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Writes the shards under ``path``; their manifest, in order."""
    ship(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        code = coder(vocabulary)
        part = TaskContext.get().partitionId()
        store, root = _place(path)
        store.create_dir(root, recursive=True)
        name = f"part-{part:06d}-{uuid.uuid4().hex}.sst"  # of this attempt alone; the manifest says which attempt counts
        with store.open_output_stream(f"{root}/{name}", compression=None) as sink:
            out = Writer(sink)
            while first is not None:
                for slice_, ids in encoded(first, 1, code, end_id):
                    for i, x in zip(slice_.column(0).to_pylist(), ids, strict=True):
                        out.add(key_of(i), x)
                first = next((b for b in batches if len(b)), None)
            out.close()
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "docs": [len(out.hashes)], "ids": [out.n_ids]})

    rows = picked(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    tie = F.xxhash64("text")
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = rows.repartitionByRange(size // RANGE_BYTES + 1, F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    made = dealt.mapInArrow(write, "part long, file string, docs long, ids long").collect()  # a row for each shard
    return [r.asDict() for r in sorted(made, key=lambda r: r["part"])]


def read_tables(spark, path: str, manifest: list[dict], keep_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in all shards), n_tokens, ids_crc32, ids (little-endian unsigned 32-bit; null unless kept)."""
    ship(spark)
    bases = np.concatenate([[0], np.cumsum([m["ids"] for m in manifest], dtype=np.int64)]).tolist()
    files = [(m["file"], b) for m, b in zip(manifest, bases, strict=False)]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _place(path)
        for b in batches:
            for i in b.column(0).to_pylist():
                name, start = files[i]
                with store.open_input_file(f"{root}/{name}") as source:
                    held, size = [], 0
                    for key, ids in Shard(source).scan():
                        raw = ids.tobytes()
                        held.append((id_of(key), start, len(ids), zlib.crc32(raw), raw if keep_ids else None))
                        start += len(ids)
                        size += len(raw) if keep_ids else 64
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    n = len(files)
    return spark.range(0, n, 1, max(1, n)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op8_sstable(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "sstables")
    made = write_tables(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return read_tables(spark, path, made, False).select("doc_id", "start", "n_tokens", "ids_crc32")
