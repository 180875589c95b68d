"""Token ids in sorted-string-table shards.

A shard is one file of entries in the order of their keys:

    data blocks   zstd frames; an entry is: bytes shared with the key before,
                  bytes that follow, ids (as varints), those key bytes; then,
                  after all entries of the block, their ids side by side
    Bloom filter  on the document id
    block index   of each block: first key, offset, size, entries, ids
    footer        offsets and totals, fixed size, ends in MAGIC

A key is a flag (0 for no id), the id as 8 big-endian bytes with the sign bit
turned, and the number of the row among equal ids. So bytes sort as ids do. A
lookup asks the filter, searches the index and reads one block.

Rows are dealt by range of (id, hash of the text), so that one id's rows may
fill several shards. Files are written under a name of their own and renamed,
so a task that runs again leaves the same file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import shared_dir, small_batches, text_size, written
from quern.llm.tokens import encoder

MAGIC, END = b"QSSTIDS1", 0
#: Bytes of ids in a block, bits of the Bloom filter for each key and its hashes, bytes of text for each shard.
BLOCK, BLOOM_BITS, BLOOM_HASHES, SHARD_BYTES = 1 << 16, 10, 7, 32 << 20
_FOOTER = struct.Struct("<QQQQQQBxxxxxxx8s")
_KEY = struct.Struct(">BQI")


def key_bytes(doc: int | None, row: int) -> bytes:
    return _KEY.pack(0, 0, row) if doc is None else _KEY.pack(1, doc + (1 << 63), row)


def key_parts(key: bytes) -> tuple[int | None, int]:
    flag, doc, row = _KEY.unpack(key)
    return (doc - (1 << 63) if flag else None), row


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, size: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key[:9])
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return [(a + k * b) % size for k in range(BLOOM_HASHES)]


class Writer:
    """Writes entries, whose keys must rise, to a binary stream."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.keys, self.index, self.total = [], [], 0
        self.packer = zstandard.ZstdCompressor(level=1)
        self._new()

    def _new(self) -> None:
        self.heads, self.values, self.size, self.first, self.last, self.entries = [], [], 0, None, b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key <= self.keys[-1]:
            raise ValueError("keys must rise")
        shared = 0
        if self.first is None:
            self.first = key
        else:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.heads.append(_varint(shared) + _varint(len(key) - shared) + _varint(len(ids)) + key[shared:])
        self.values.append(ids.tobytes())
        self.size += len(self.values[-1])
        self.last, self.entries, self.total = key, self.entries + 1, self.total + len(ids)
        self.keys.append(key)
        if self.size >= BLOCK:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.entries:
            heads = b"".join(self.heads)
            frame = self.packer.compress(struct.pack("<II", self.entries, len(heads)) + heads + b"".join(self.values))
            self.index.append((self.first, self.at, len(frame), self.entries, self.size // self.width))
            self._write(frame)
            self._new()

    def close(self) -> None:
        self._flush()
        size = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros((size + 7) // 8, np.uint8)
        for k in self.keys:
            for b in _bits(k, size):
                bloom[b >> 3] |= 1 << (b & 7)
        bloom_at = self.at
        self._write(bloom.tobytes())
        index_at = self.at
        self._write(b"".join(k + struct.pack("<QIII", *rest) for k, *rest in self.index))
        self._write(_FOOTER.pack(bloom_at, size, index_at, len(self.index), len(self.keys), self.total, self.width, MAGIC))


class Reader:
    """Reads a shard from a random-access stream with seek and read."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - _FOOTER.size)
        self.bloom_at, self.bloom_size, index_at, blocks, self.n_keys, self.total, self.width, magic = _FOOTER.unpack(stream.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        stream.seek(index_at)
        step = _KEY.size + 20
        raw = stream.read(blocks * step)
        self.index = [(raw[k : k + _KEY.size], *struct.unpack("<QIII", raw[k + _KEY.size : k + step])) for k in range(0, len(raw), step)]
        self.firsts = [x[0] for x in self.index]
        self.bloom = None

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, _, _ = self.index[k]
        self.stream.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.stream.read(size))
        entries, heads = struct.unpack_from("<II", data)
        at, value, key = 8, 8 + heads, b""
        for _ in range(entries):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", n, value)
            value += n * self.width

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def get(self, doc: int | None) -> list[np.ndarray]:
        """The ids of every row with this document id in the shard."""
        if self.bloom is None:
            self.stream.seek(self.bloom_at)
            self.bloom = self.stream.read((self.bloom_size + 7) // 8)
        low = key_bytes(doc, 0)
        if not all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(low, self.bloom_size)):
            return []
        out = []
        for k in range(max(0, bisect_right(self.firsts, low) - 1), len(self.index)):
            if self.firsts[k][:9] > low[:9]:
                break
            out += [ids for key, ids in self.block(k) if key[:9] == low[:9]]
        return out


def open_shard(path: str) -> Reader:
    system, name = fs.FileSystem.from_uri(path)
    return Reader(system.open_input_file(name), system.get_file_info(name).size)


def write(df: DataFrame, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text", end: int = END, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write every row's ids and `end` to shards below folder; a row per shard: shard, path, n_docs, n_ids, start.

    start counts the ids in the shards before. A null text has only the end id;
    null keys come first, equal keys by their texts' hash. Other columns of df
    are ignored. An empty table writes no shard. The files lie in a new folder
    below spark.checkpoint.dir unless one that all executors share is given.
    """
    spark = df.sparkSession
    small_batches(spark)
    folder = folder or shared_dir(spark)
    n = max(1, -(-text_size(df, text)[1] // shard_bytes))
    rows = df.select(df[key].cast("long").alias("key"), df[text].alias("text"), F.xxhash64(df[text]).alias("h"))
    rows = rows.repartitionByRange(n, "key", "h").sortWithinPartitions("key", "h").select("key", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer = encoder(path), None
        system, top = fs.FileSystem.from_uri(folder)
        shard = TaskContext.get().partitionId()
        name = f"{top}/ids-{shard:06d}.sst"
        for b in batches:
            keys, hashes = b.column(0).to_pylist(), b.column(2).to_pylist()
            flat, off = own.encode(b.column(1), end)
            for k, h, lo, hi in zip(keys, hashes, off[:-1].tolist(), off[1:].tolist(), strict=True):
                if writer is None:
                    system.create_dir(top, recursive=True)
                    temporary = f"{name}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(temporary)
                    writer, before, row = Writer(out, own.dtype.itemsize), None, 0
                row = row + 1 if before and before[0] == k else 0
                before = (k, h)
                writer.add(key_bytes(k, row), flat[lo:hi])
        if writer is not None:
            writer.close()
            out.close()
            system.move(temporary, name)
            uri = f"{folder}/ids-{shard:06d}.sst"
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([len(writer.keys)], pa.int64()), pa.array([writer.total], pa.int64())], ["shard", "path", "n_docs", "n_ids"])

    made = written(rows.mapInArrow(run, "shard int, path string, n_docs long, n_ids long"))
    # A row per shard, so one task can number them.
    return made.withColumn("start", F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids"))


def read(shards: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """The rows of the shards: key, start, n_tokens, ids_crc32 and ids (null without `ids`)."""
    spark = shards.sparkSession
    n = max(1, shards.count())
    rows = shards.select("path", "start").repartitionByRange(n, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "start", "n_tokens", "ids_crc32", "ids"]
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                for k in range(len(shard.index)):
                    out = []
                    for name, found in shard.block(k):
                        found = found.astype("<u4")
                        out.append((key_parts(name)[0], start, len(found), zlib.crc32(found.tobytes()), found.view("<i4") if ids else None))
                        start += len(found)
                    columns = list(zip(*out, strict=True))
                    yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.int32()))], names)

    small_batches(spark)
    return rows.mapInArrow(run, f"`{key}` long, start long, n_tokens long, ids_crc32 long, ids array<int>")
