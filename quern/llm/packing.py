"""Packing documents into sequences by minimum bin slack.

A document's ids are cut into full sequences, and what remains is packed. Each
window takes the longest remainder left and the multiset of other lengths that
fills it closest to capacity: sums that can be reached are the bits of one
number, lengths enter with their counts doubled up in binary, and the counts
are read back through the stages. A multiset is used again while its counts
last. A window that would need much padding is cut into sequences whose
lengths are powers of two, which need none.

Each task packs what it reads, some thousands of documents at a time; there is
no shuffle, and what a task holds is bounded by the chunk.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quern.llm.common import chunked, give_back, small_batches
from quern.llm.tokens import encoder

CAPACITY, END = 2048, 1
#: Bytes of text that are packed together.
PACKED_BYTES = 12 << 20
#: Padding of a window, as a share of the capacity, beyond which it is cut to powers of two.
SLACK = 1 / 128


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within counts, whose sum is at most room and closest to it."""
    mask, reach, stages = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, part = min(counts[length], room // length), 1
        while left:
            part = min(part, left)
            stages.append((reach, length, part))
            reach |= (reach << (length * part)) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for before, length, part in reversed(stages):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + part
            total -= length * part
    return used


def windows(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers for each window; every item of 1 .. capacity - 1 is in one."""
    stacks: dict[int, list[int]] = {}
    for k in np.argsort(-lengths, kind="stable").tolist():
        stacks.setdefault(int(lengths[k]), []).append(k)
    counts = {length: len(s) for length, s in stacks.items()}
    out = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        fill = best_fill({k: v for k, v in counts.items() if v}, capacity - first)
        counts[first] += 1
        fill[first] = fill.get(first, 0) + 1
        for _ in range(min(counts[k] // v for k, v in fill.items())):
            out.append([stacks[k].pop() for k, v in sorted(fill.items(), reverse=True) for _ in range(v)])
        for k in fill:
            counts[k] = len(stacks[k])
            if not counts[k]:
                del counts[k]
    return out


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, slack: float = SLACK) -> np.ndarray:
    """Pieces of items with these lengths: columns item, start, length, sequence, offset.

    Sequences hold at most capacity; those that are neither full nor a power of
    two long lack at most capacity * slack.
    """
    rows, seq = [], 0
    rest = lengths % capacity
    for k in np.flatnonzero(lengths >= capacity).tolist():
        for start in range(0, int(lengths[k] - rest[k]), capacity):
            rows.append((k, start, capacity, seq, 0))
            seq += 1
    items = np.flatnonzero(rest)
    for window in windows(rest[items], capacity):
        total = int(rest[items[window]].sum())
        sizes = [total]
        if capacity - total > capacity * slack:
            sizes = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        at, room = 0, sizes.pop(0)
        for k in items[window].tolist():
            start, left = int(lengths[k] - rest[k]), int(rest[k])
            while left:
                take = min(left, room - at)
                rows.append((k, start, take, seq, at))
                start, left, at = start + take, left - take, at + take
                if at == room:
                    seq, at, room = seq + 1, 0, sizes.pop(0) if sizes else 0
        if at:
            seq += 1
    return np.array(rows, np.int64).reshape(-1, 5)


def pack(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = True) -> DataFrame:
    """A row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset and its ids.

    The ids are the tokenizers library's, then `end`; so a null or empty text is
    one id. Rows with the same or no key are packed as rows of their own. Other
    columns of df are ignored, whatever their names. Without `ids`, that column
    is null.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[key].alias(key), df[text].alias("_text"))
    kind = rows.schema[key].dataType.simpleString()
    names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, base = encoder(path), TaskContext.get().partitionId(), 0
        for t in chunked(batches, PACKED_BYTES):
            keys = t.column(0).combine_chunks()
            flat, off = own.encode(t.column(1), end)
            n = np.diff(off)
            pieces = pack_lengths(n, capacity)
            crc, out = [], []
            for k, start, length, _, _ in pieces.tolist():
                part = flat[off[k] + start : off[k] + start + length].astype("<u4")
                crc.append(zlib.crc32(part.tobytes()))
                out.append(part.view("<i4") if ids else None)
            item = pieces[:, 0]
            full = pa.table(
                [keys.take(pa.array(item)), pa.array(pieces[:, 1]), pa.array(pieces[:, 2]), pa.array(crc, pa.int64()), pa.array(n[item]), pa.array((task << 40) + base + pieces[:, 3]), pa.array(pieces[:, 4]), pa.array(out, pa.list_(pa.int32()))],
                names,
            )
            base += int(pieces[:, 3].max()) + 1 if len(pieces) else 0
            del flat, pieces, out
            give_back()
            yield from full.to_batches(max_chunksize=4096)

    return rows.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")
