"""Token shards as sorted string tables.

A shard holds documents in ascending key order. Blocks of about BLOCK bytes store each key as the
length it shares with the key before it and the rest, then the token ids; a block is compressed and
carries a checksum. Behind the blocks stand a sparse index (first key and place of each block), a
Bloom filter over the keys and a footer of fixed size, so that a lookup reads the footer, rules the
shard out by the filter, or finds its block by binary search.

Keys are the document's integer identifier, order-preserving: one byte 1 and the identifier as eight
big-endian bytes with the sign bit flipped; a null identifier is the byte 0 and sorts first. Equal
identifiers are stored one after another, each with its own ids; those of equal text too stay in one shard. Null texts
are empty texts. Columns other than the identifier and the text are left out.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import common
from lexspark.llm.encoding import encoder

MAGIC = b"LXSST001"
BLOCK = 64 << 10
FOOTER = struct.Struct("<QQQQQQIII8s")
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), (h >> 64) | 1
    return [(a + i * b) % 2**64 % bits for i in range(PROBES)]


class ShardWriter:
    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.block, self.last, self.first = bytearray(), b"", b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[int] = []
        self.keys = self.tokens = self.at = 0
        self.compress = zstandard.ZstdCompressor(level=1).compress
        self.previous: bytes | None = None

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.previous is not None and key < self.previous:
            raise ValueError("keys must ascend")
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        for x, y in zip(key, self.last, strict=False):
            if x != y:
                break
            shared += 1
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        put_varint(self.block, shared)
        put_varint(self.block, len(key) - shared)
        put_varint(self.block, len(value))
        self.block += key[shared:]
        self.block += value
        if key != self.previous:
            self.hashes.append(xxhash.xxh3_128_intdigest(key))
        self.last = self.previous = key
        self.keys += 1
        self.tokens += len(ids)
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            data = self.compress(bytes(self.block))
            data += struct.pack("<I", zlib.crc32(data))
            self.sink.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block = bytearray()

    def finish(self) -> None:
        self._flush()
        index = bytearray()
        for key, at, size in self.index:
            put_varint(index, len(key))
            index += key
            put_varint(index, at)
            put_varint(index, size)
        bits = max(64, BITS_PER_KEY * len(self.hashes))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        bits = len(bloom) * 8
        low = np.array([h & (2**64 - 1) for h in self.hashes], np.uint64)
        high = np.array([h >> 64 | 1 for h in self.hashes], np.uint64)
        for i in range(PROBES if self.hashes else 0):
            place = (low + np.uint64(i) * high) % np.uint64(bits)
            np.bitwise_or.at(bloom, (place >> np.uint64(3)).astype(np.int64), (1 << (place & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        self.sink.write(bytes(index))
        self.sink.write(bloom.tobytes())
        self.sink.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), self.keys, self.tokens, len(self.index), self.width, PROBES, MAGIC))


class ShardReader:
    def __init__(self, filesystem: pafs.FileSystem, path: str):
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        (self.index_at, index_size, self.bloom_at, self.bloom_size, self.keys, self.tokens, blocks, self.width, _, magic) = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        data, at = self.file.read_at(index_size, self.index_at), 0
        self.first: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        for _ in range(blocks):
            n, at = get_varint(data, at)
            self.first.append(data[at : at + n])
            offset, at = get_varint(data, at + n)
            length, at = get_varint(data, at)
            self.places.append((offset, length))
        self.decompress = zstandard.ZstdDecompressor().decompress

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.places[k]
        data = self.file.read_at(length, offset)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise OSError("a block's checksum differs")
        data, at, key = self.decompress(data[:-4]), 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            size, at = get_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, "<u2" if self.width == 2 else "<u4", size // self.width, at).astype("<u4")
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.places)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        bloom = self.file.read_at(self.bloom_size, self.bloom_at)
        return all(bloom[p >> 3] >> (p & 7) & 1 for p in _bloom_places(key, self.bloom_size * 8))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document stored under the identifier; empty if there is none."""
        key, found = key_of(doc_id), []
        if not self.places or not self.may_hold(key):
            return found
        for k in range(max(0, bisect.bisect_left(self.first, key) - 1), len(self.places)):
            if self.first[k] > key:
                break
            found += [ids for own, ids in self.block(k) if own == key]
        return found


META = "path string, keys long, tokens long, first_key binary"


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, *, id_col: str = "doc_id", text_col: str = "text") -> list:
    """Encode and write all documents; shards cover disjoint ascending ranges of identifiers.

    Returns the shards' rows (path, keys, tokens, first_key) in key order: one row for each task that
    wrote, however large the input is. A task writes under a name of its own, and only the names that
    successful attempts report count, so a lost executor leaves at worst a file that no one reads. An
    empty table makes no shard.
    """

    def step(batches):
        filesystem, root = pafs.FileSystem.from_uri(folder)
        filesystem.create_dir(root, recursive=True)
        coder = encoder(tokenizer)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        name, writer, sink, first = f"{root}/{uuid.uuid4().hex}.sst", None, None, None
        for batch in common.slices(batches):
            values, at = coder.encode(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                if writer is None:
                    sink, first = filesystem.open_output_stream(name), key_of(doc_id)
                    writer = ShardWriter(sink, width)
                writer.add(key_of(doc_id), np.append(values[at[k] : at[k + 1]], np.uint32(end_id)))
        if writer is not None:
            writer.finish()
            sink.close()
            yield common.arrow_batch(path=[name], keys=[writer.keys], tokens=[writer.tokens], first_key=[first])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    # the text's hash only spreads many rows of one identifier over several shards
    ranged = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return sorted(common.map_arrow(ranged, step, META).collect(), key=lambda r: (bytes(r.first_key), r.path))


READ = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"


def read_shards(spark: SparkSession, folder: str, shards: list) -> DataFrame:
    """A row for each stored document, read back from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 over little-endian unsigned 32-bit ids, shard (its number)."""
    rows, before = [], 0
    for k, r in enumerate(shards):
        rows.append((k, r.path, before))
        before += r.tokens

    def step(batches):
        filesystem, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for shard in batch.to_pylist():
                at, reader = shard["start"], ShardReader(filesystem, shard["path"])
                for k in range(len(reader.places)):  # a batch for each block
                    rows = []
                    for key, ids in reader.block(k):
                        rows.append((id_of(key), at, len(ids), zlib.crc32(ids.tobytes()), shard["shard"]))
                        at += len(ids)
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in READ.split(", ")])

    frame = spark.createDataFrame(rows, "shard int, path string, start long")
    return common.map_arrow(frame.repartition(max(1, len(rows))), step, READ)
