"""What the operators of this package share: text buffers, word hashes, bucketed arrays.

Text reaches Python as Arrow buffers, so one batch is one byte array with
offsets, and words, windows and hashes are numpy arrays over it. Nothing here
makes a Python object per word.

A *bucketed array* is how large sets of numbers are shuffled: a mapper gathers
the numbers of many documents, splits them by ``bucket`` and emits one binary
row per bucket, and one reducer call reads all rows of a bucket. The count of
buckets follows the size of the input, so what one reducer holds does not.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one mapper gathers before it emits, that one bucket stands for, and that are looked at together.
CHUNK_BYTES, BUCKET_BYTES, PART_BYTES = 16 << 20, 8 << 20, 4 << 20
#: Rows in one Arrow batch; long texts make large batches.
BATCH_ROWS = 1000
#: Bytes of a span beyond which it is hashed by itself.
LONG = 512
U64 = np.uint64
_M1, _M2, _M3 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent and one process does it all, as in tests,
    a local folder is set; on a cluster its absence is an error.
    """
    context = spark.sparkContext
    top = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not top:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quern-checkpoint-"))
        top = context.getCheckpointDir()
    elif not context.getCheckpointDir():
        context.setCheckpointDir(top)
    # With its scheme and host, for readers other than Spark's.
    path = context._jvm.org.apache.hadoop.fs.Path(top)
    top = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    if top.startswith("file:/") and not top.startswith("file://"):
        top = "file://" + top[5:]
    return f"{top}/quern-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what written() made, once nothing reads it any more."""
    for t in tables:
        context = t.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of at most BATCH_ROWS rows and about 16 MB.

    The setting is read when a plan runs, after its operator has returned, so it
    stays in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def text_size(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows of df and bytes of their texts: one aggregate, which decides how many buckets there are."""
    row = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(column)))).first()
    return int(row[0]), int(row[1] or 0)


def bucket_count(n_bytes: int, least: int = 32) -> int:
    return max(least, -(-n_bytes // BUCKET_BYTES))


def one_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, eight zeros after them, and n + 1 offsets. A null is an empty text."""
    column = one_array(column)
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(8, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    out = np.empty(len(raw) + 8, np.uint8)
    out[: len(raw)], out[len(raw) :] = raw, 0
    return out, off - off[0]


def eights(data: np.ndarray) -> np.ndarray:
    """The 64-bit little-endian number that starts at each byte of data (which ends in eight spare bytes)."""
    return np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * _M2
    x = (x ^ (x >> U64(27))) * _M3
    return x ^ (x >> U64(31))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run of bytes other than 0x20 and 0x09-0x0D, and n + 1 offsets of each text's words."""
    n = int(off[-1])
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~_SPACE[data[:n]]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = off[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    last = inside
    last[:-1] &= ~(inside[1:] & ~first[1:])
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes at a time; long spans go one by one to xxhash."""
    at, size = eights(data), ends - starts
    h = mix((size.astype(U64) + U64(seed)) * _M1 + U64(1))
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]], seed)
    here, k = np.flatnonzero(size <= LONG), 0
    while len(here):
        left = size[here] - k
        more = left > 0
        here, left = here[more], left[more]
        if not len(here):
            break
        part = at[starts[here] + k] & _MASKS[np.minimum(left, 8)]
        h[here] = mix((h[here] ^ part) * _M1)
        k += 8
    return h


def windows_hash(h: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """For each position a hash of h[i : i + width]; len(h) - width + 1 values, across whatever h holds."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    base = U64((0xD6E8FEB86659FD93 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF | 1)
    out = h[:n].copy()
    for k in range(1, width):
        out *= base
        out += h[k : k + n]
    return mix(out)


def full_windows(off: np.ndarray, width: int) -> np.ndarray:
    """Of positions 0 .. off[-1] - width, which start a window that ends in the same text."""
    n = int(off[-1]) - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    good = np.ones(n + width, bool)
    for k in range(1, width):
        cut = off[1:-1] - k
        good[cut[cut >= 0]] = False
    # A text shorter than the window is crossed from before it; its own starts fall to its end.
    return good[:n]


def owner(off: np.ndarray) -> np.ndarray:
    """For each item the text it belongs to."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in a window of the given width that begins at one of starts."""
    turn = np.zeros(n + 1, np.int32)
    np.add.at(turn, starts, 1)
    np.add.at(turn, np.minimum(starts + width, n), -1)
    return np.cumsum(turn[:n]) > 0


def split_by(bucket: np.ndarray, n: int, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, columns of its rows) for each bucket that has rows; the order within a bucket stays."""
    order = np.argsort(bucket.astype(np.uint16 if n < 65536 else np.int64), kind="stable")
    ends = np.cumsum(np.bincount(bucket, minlength=n))
    columns = [c[order] for c in columns]
    lo = 0
    for b, hi in enumerate(ends.tolist()):
        if hi > lo:
            yield (b, *(c[lo:hi] for c in columns))
        lo = hi


def binary_rows(rows: list[tuple[int, bytes]], name: str = "bucket") -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], [name, "blob"])


def chunked(batches: Iterator[pa.RecordBatch], most: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """The batches of a task, gathered to tables of about `most` bytes."""
    held, size = [], 0
    for b in batches:
        if b.num_rows == 0:
            continue
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def parts(batches: Iterator[pa.RecordBatch], column: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a task in batches with at most `most` bytes in a column of texts, or one row."""
    for b in batches:
        if b.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            before = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


_LIBC = ctypes.CDLL(None)


def give_back() -> None:
    """Return freed memory to the system: a worker serves many tasks, and its peaks are not the next one's."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id reachable.

    Rounds of large and small star over (larger, smaller) pairs: every id points
    at the least neighbour it has, and its other neighbours are handed to that
    one. The edges never grow beyond their first count, and the rounds grow with
    the logarithm of the longest path.

    An id with very many neighbours is no hot key: its least neighbour is found
    by an aggregate with map-side combine, which is written, so that both sides
    of the join that follows are plain shuffles, whose large partitions are
    split at run time. Nothing but a count reaches the driver.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    pairs = written(pairs)
    state = (F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")))
    before = pairs.agg(*state).first()
    while True:
        # Large star: each id hands its larger neighbours its least neighbour (or itself).
        both = pairs.union(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = written(both.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m")))
        large = written(both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct())
        # Small star: each id hands its smaller neighbours and itself the least of them.
        low = written(large.groupBy("v").agg(F.min("u").alias("m")))
        joined = large.join(low, "v")
        small = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(low.select("v", F.col("m").alias("u"))).distinct()
        small = written(small)
        discard(pairs, least, large, low)
        pairs = small
        now = pairs.agg(*state).first()
        if now == before:
            break
        before = now
    return pairs.select(F.col("v").alias("id"), F.col("u").alias("component")).union(pairs.select(F.col("u").alias("id"), F.col("u").alias("component")).distinct())
