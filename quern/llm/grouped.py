"""Documents in groups, and messages between the groups.

Both substring operators work on the same frame. Documents are dealt into
groups of about BUCKET_BYTES of text by a hash of their id (of their text where
there is none), in one shuffle that every later step reuses. A group tells
reducers what its documents hold, each value once however many of its documents
hold it; a reducer compares the groups and answers a group, not its documents.
So a passage in a third of all documents costs one message per group.

Groups and reducers both grow with the input, and a message from each to each
would grow with its square. Beyond `fan` of them, a sender bundles what goes to
one of `fan` ranges of receivers, and one more shuffle unbundles a range's
bundles by receiver, many senders at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from quern.llm.common import binary_rows, bucket_count, chunked, give_back, one_array, small_batches, split_by, text_size, utf8

NO_ID = np.iinfo(np.int64).max
MESSAGE = "bucket int, g int, blob binary"
#: Groups (or buckets) that a task reads, from which on there are more tasks than the session's setting.
GROUPS_PER_TASK = 4
#: Receivers up to which every message is a row, and receivers whose bundles one task takes apart.
FAN, UNBUNDLED = 4096, 16
BUNDLE = "part int, salt int, blob binary"


def dealt(df: DataFrame, column: str, n: int) -> DataFrame:
    """df dealt by column, n values of it, over so many tasks that each reads few of them.

    The session's count of shuffle partitions holds while it suffices; it does
    not grow with the input, and n does.
    """
    tasks = -(-n // GROUPS_PER_TASK)
    return df.repartition(tasks, column) if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


class Grouped:
    """The rows of df as compressed blobs of (id, text) by group, and how many groups and buckets there are."""

    def __init__(self, df: DataFrame, key: str, text: str, carry: Column | None = None, fan: int = FAN):
        """carry is a string that stays with its row."""
        small_batches(df.sparkSession)
        self.fan = fan
        self.n = n = bucket_count(text_size(df, text)[1])
        carry = F.lit(None).cast("string") if carry is None else carry
        spread = F.xxhash64(df[key], F.when(df[key].isNull(), df[text]))
        rows = df.select(F.pmod(spread, F.lit(n)).cast("int").alias("g"), df[key].cast("long").alias("id"), df[text].alias("text"), carry.alias("carry"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in chunked(batches):
                yield binary_rows(list(_blobs(t, n)), "g")
            give_back()

        self.rows = dealt(rows.mapInArrow(run, "g int, blob binary"), "g", n)

    def tell(self, f: Callable, to: int) -> DataFrame:
        """f(Group) -> messages (bucket, g, blob) to `to` buckets, for every group."""
        fan = self.fan

        def run(t: pa.Table) -> pa.Table:
            out = sent(f(Group(t)), "bucket", to, fan)
            give_back()
            return out

        return delivered(self.rows.groupBy("g").applyInArrow(run, MESSAGE if to <= fan else BUNDLE), "bucket", to, fan)

    def reduced(self, df: DataFrame, f: Callable, n: int) -> DataFrame:
        """f(bucket, [(g, blob)]) -> messages to groups, once for all messages of each of n buckets."""
        fan, groups = self.fan, self.n

        def run(t: pa.Table) -> pa.Table:
            out = sent(f(int(t["bucket"][0].as_py()), sorted(received(t, "g"))), "g", groups, fan)
            give_back()
            return out

        return delivered(dealt(df, "bucket", n).groupBy("bucket").applyInArrow(run, MESSAGE if groups <= fan else BUNDLE), "g", groups, fan)

    def hear(self, answers: DataFrame, f: Callable, schema: str | None = None, to: int = 0) -> DataFrame:
        """f(Group, [(bucket, blob)]) for every group with the answers it got; messages to `to` buckets, or rows of schema."""
        fan = self.fan

        def run(t: pa.Table, a: pa.Table) -> pa.Table:
            if t.num_rows == 0:
                return empty if schema else sent([], "bucket", to, fan)
            out = f(Group(t), received(a, "bucket"))
            out = out if schema else sent(out, "bucket", to, fan)
            give_back()
            return out

        empty = None
        if schema:
            empty = pa.Table.from_pylist([], to_arrow_schema(_parse_datatype_string(schema)))
        both = self.rows.groupBy("g").cogroup(dealt(answers, "g", self.n).groupBy("g"))
        if schema:
            return both.applyInArrow(run, schema)
        return delivered(both.applyInArrow(run, MESSAGE if to <= fan else BUNDLE), "bucket", to, fan)


def _blobs(t: pa.Table, n: int) -> Iterator[tuple[int, bytes]]:
    """(group, its rows of t): count, ids, which ids are null, sizes of texts and of what they carry, bytes of both; compressed."""
    ids = one_array(t["id"])
    missing = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    ids = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
    data, off = utf8(t["text"])
    more, more_off = utf8(t["carry"])
    size, raw, pack = np.diff(off).astype("<u4"), memoryview(data), zstandard.ZstdCompressor(level=1)
    more_size, more = np.diff(more_off).astype("<u4"), memoryview(more)
    for g, rows in split_by(one_array(t["g"]).to_numpy(), n, np.arange(len(ids))):
        texts = b"".join([raw[off[k] : off[k + 1]] for k in rows.tolist()] + [more[more_off[k] : more_off[k + 1]] for k in rows.tolist()])
        yield g, pack.compress(b"".join([np.array([len(rows)], "<u4").tobytes(), ids[rows].tobytes(), missing[rows].tobytes(), size[rows].tobytes(), more_size[rows].tobytes(), texts]))


def _opened(column: pa.ChunkedArray) -> list[bytes]:
    out = zstandard.ZstdDecompressor()
    return [out.decompress(b) for b in column.to_pylist()]


class Group:
    """One group's documents: ids (NO_ID where null), bytes and offsets, in the same order whenever it is read."""

    def __init__(self, t: pa.Table):
        self.g = int(t["g"][0].as_py())
        ids, missing, size, texts, self.carried = [], [], [], [], []
        for b in sorted(_opened(t["blob"])):
            n = int(np.frombuffer(b, "<u4", 1)[0])
            ids.append(np.frombuffer(b, "<i8", n, 4))
            missing.append(np.frombuffer(b, np.uint8, n, 4 + 8 * n))
            size.append(np.frombuffer(b, "<u4", n, 4 + 9 * n))
            more, at = np.frombuffer(b, "<u4", n, 4 + 13 * n), 4 + 17 * n + int(size[-1].sum())
            texts.append(np.frombuffer(b, np.uint8, at - 4 - 17 * n, 4 + 17 * n))
            for m in more.tolist():
                self.carried.append(b[at : at + m])
                at += m
        self.ids = np.concatenate(ids)
        self.id_column = pa.array(self.ids, mask=np.concatenate(missing) > 0)
        self.off = np.r_[0, np.cumsum(np.concatenate(size), dtype=np.int64)]
        self.data = np.concatenate([*texts, np.zeros(8, np.uint8)])


def messages(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    pack = zstandard.ZstdCompressor(level=1)
    b, g, blob = zip(*((b, g, pack.compress(x)) for b, g, x in rows), strict=True) if rows else ((), (), ())
    return pa.table([pa.array(b, pa.int32()), pa.array(g, pa.int32()), pa.array(blob, pa.binary())], ["bucket", "g", "blob"])


def bundle(to: np.ndarray, of: np.ndarray, blobs: list[bytes]) -> bytes:
    """Messages side by side: how many, to whom, from whom, their sizes and bytes; compressed."""
    head = [np.array([len(blobs)], "<u4"), to.astype("<u4"), of.astype("<u4"), np.array([len(x) for x in blobs], "<u4")]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*(h.tobytes() for h in head), *blobs]))


def unbundled(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """To whom, from whom, sizes and bytes of a bundle's messages."""
    n = int(np.frombuffer(blob, "<u4", 1)[0])
    to, of, size = (np.frombuffer(blob, "<u4", n, 4 + 4 * n * k) for k in range(3))
    return to, of, size, np.frombuffer(blob, np.uint8, offset=4 + 12 * n)


def sent(rows: list[tuple[int, int, bytes]], to: str, n: int, fan: int) -> pa.Table:
    """Messages (bucket, g, blob) to n receivers, named by the column `to`: a row each, or bundles for `fan` ranges of receivers."""
    if n <= fan:
        return messages(rows)
    out = []
    if rows:
        ends = np.array([r[:2] for r in rows], np.int64)
        who, of = (ends[:, 0], ends[:, 1]) if to == "bucket" else (ends[:, 1], ends[:, 0])
        order = np.argsort(who, kind="stable")
        part = who[order] * fan // n
        for at in np.split(order, np.flatnonzero(np.diff(part)) + 1):
            out.append((int(who[at[0]] * fan // n), int(of[at[0]]), bundle(who[at], of[at], [rows[k][2] for k in at.tolist()])))
    p, salt, blob = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(p, pa.int32()), pa.array(salt, pa.int32()), pa.array(blob, pa.binary())], ["part", "salt", "blob"])


def delivered(df: DataFrame, to: str, n: int, fan: int) -> DataFrame:
    """Rows that can be grouped by receiver: those that were sent, or (receiver, bundle) made of many senders' bundles."""
    if n <= fan:
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunked(batches):
            who, of, size, data = zip(*(unbundled(b) for b in _opened(t["blob"])), strict=True)
            who, of, size, data = (np.concatenate(x) for x in (who, of, size, data))
            ends = np.cumsum(size, dtype=np.int64)
            order = np.argsort(who, kind="stable")
            raw, out = memoryview(data), []
            for at in np.split(order, np.flatnonzero(np.diff(who[order])) + 1):
                out.append((int(who[at[0]]), bundle(who[at], of[at], [bytes(raw[ends[k] - size[k] : ends[k]]) for k in at.tolist()])))
            yield binary_rows(out, to)
        give_back()

    # A range's bundles go to several tasks, by their senders.
    tasks = -(-n // UNBUNDLED)
    spread = F.pmod("salt", F.lit(max(1, tasks // fan)))
    return df.repartition(max(tasks, fan), F.col("part"), spread).select("part", "blob").mapInArrow(run, f"`{to}` int, blob binary")


def received(t: pa.Table, of: str) -> list[tuple[int, bytes]]:
    """(sender, blob) of a receiver's rows; a sender may come more than once."""
    if of in t.column_names:
        return list(zip(t[of].to_pylist(), _opened(t["blob"]), strict=True))
    out = []
    for blob in _opened(t["blob"]):
        _, senders, size, data = unbundled(blob)
        ends, raw = np.cumsum(size, dtype=np.int64), data.tobytes()
        out += [(k, raw[hi - n : hi]) for k, n, hi in zip(senders.tolist(), size.tolist(), ends.tolist(), strict=True)]
    return out


def shared_numbers(bucket: int, rows: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
    """Each group's uint32 numbers that another group sent too."""
    sizes = [len(b) // 4 for _, b in rows]
    both = np.concatenate([np.frombuffer(b, "<u4") for _, b in rows]).astype(np.uint64) << np.uint64(32)
    both |= np.repeat(np.arange(len(rows), dtype=np.uint64), sizes)
    both.sort()
    number = both >> np.uint64(32)
    same = number[1:] == number[:-1]
    shared = np.zeros(len(both), bool)
    shared[1:] |= same
    shared[:-1] |= same
    both = both[shared]
    who, number = (both & np.uint64(0xFFFFFFFF)).astype(np.int64), (both >> np.uint64(32)).astype("<u4")
    order = np.argsort(who, kind="stable")
    ends = np.cumsum(np.bincount(who, minlength=len(rows)))
    out, lo, number = [], 0, number[order]
    for k, hi in enumerate(ends.tolist()):
        if hi > lo:
            out.append((bucket, rows[k][0], number[lo:hi].tobytes()))
        lo = hi
    return out


def shared_here(hashes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Which hashes occur in two or more different documents of docs."""
    if not len(hashes):
        return np.zeros(0, bool)
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], docs[order]
    first = np.r_[True, h[1:] != h[:-1]]
    begin = np.flatnonzero(first)
    low, high = np.minimum.reduceat(d, begin), np.maximum.reduceat(d, begin)
    out = np.zeros(len(h), bool)
    out[order] = np.repeat(low != high, np.diff(np.r_[begin, len(h)]))
    return out


def told_numbers(g: int, hashes: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Messages with the distinct 64-bit hashes of a group: the bucket by the high half, the low half as uint32."""
    h = np.unique(hashes)
    bucket = ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    return [(b, g, low.tobytes()) for b, low in split_by(bucket, n, (h & np.uint64(0xFFFFFFFF)).astype("<u4"))]


def in_answer(hashes: np.ndarray, answer: list[tuple[int, bytes]], n: int) -> np.ndarray:
    """Which hashes are among the answered (bucket, low half) numbers."""
    if not answer or not len(hashes):
        return np.zeros(len(hashes), bool)
    known = np.sort(np.concatenate([np.frombuffer(b, "<u4").astype(np.uint64) | np.uint64(k << 32) for k, b in answer]))
    if not len(known):
        return np.zeros(len(hashes), bool)
    mine = ((hashes >> np.uint64(32)) % np.uint64(n)) << np.uint64(32) | (hashes & np.uint64(0xFFFFFFFF))
    at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
    return known[at] == mine
