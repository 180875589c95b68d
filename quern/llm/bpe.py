"""Byte-level BPE encoding and decoding by a monoid tree.

A *part* is a stretch of text with its ids. Parts join associatively: the ids
of the left one up to a safe cut, the ids of a window around the seam encoded
anew, the ids of the right one from a safe cut on. A cut is safe when the
pre-tokeniser's pattern ends a match there whatever surrounds it, so the ids
outside the window provably cannot change:

- before white space that follows something else: only ``\\s+`` has white space
  beyond its first place;
- after a letter that no letter follows, and after a digit that no digit
  follows: no alternative goes on past the end of a run of letters or digits.

The window starts at a few characters on each side and doubles until it holds a
safe cut on both sides, up to the whole of both parts. Encoding splits a text in
halves down to leaves, which the tiktoken library encodes. Decoding turns leaves
of ids to bytes and concatenates up the tree.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from quern.llm.common import small_batches

#: Characters of a leaf, and of the first window on each side of a seam.
LEAF, WINDOW = 256, 32
_CUT = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=\S)(?=\s)")


@lru_cache(2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class Part:
    """A stretch text[lo:hi] with its ids and their bytes' running length."""

    __slots__ = ("lo", "hi", "ids", "ends")

    def __init__(self, lo: int, hi: int, ids: np.ndarray, ends: np.ndarray):
        self.lo, self.hi, self.ids, self.ends = lo, hi, ids, ends


class Tree:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, enc: tiktoken.Encoding, leaf: int = LEAF, window: int = WINDOW):
        self.enc, self.leaf_size, self.window, self.joins = enc, leaf, window, 0
        self.sizes = np.zeros(enc.n_vocab, np.int64)
        for token in enc.token_byte_values():
            self.sizes[enc.encode_single_token(token)] = len(token)

    def leaf(self, text: str, lo: int, hi: int) -> Part:
        ids = np.array(self.enc.encode_ordinary(text[lo:hi]), np.uint32)
        return Part(lo, hi, ids, np.cumsum(self.sizes[ids]))

    def join(self, text: str, a: Part, b: Part) -> Part:
        if a.lo == a.hi or b.lo == b.hi:
            return b if a.lo == a.hi else a
        seam, reach = a.hi, self.window
        while True:
            lo, hi = max(a.lo, seam - reach), min(b.hi, seam + reach)
            left = right = None
            # A cut looks at the characters on both sides of it: one at the edge of a part needs both in that part.
            for m in _CUT.finditer(text, max(lo, a.lo), seam):
                if a.lo < m.start() < seam:
                    left = m.start()
                    break
            for m in _CUT.finditer(text, seam, hi):
                if seam < m.start() < hi:
                    right = m.start()
                    break
            if (left is not None or lo == a.lo) and (right is not None or hi == b.hi):
                break
            reach *= 2
        left, right = a.lo if left is None else left, b.hi if right is None else right
        middle = self.leaf(text, left, right)
        before = np.searchsorted(a.ends, len(text[a.lo : left].encode()), "right") if left > a.lo else 0
        after = np.searchsorted(b.ends, len(text[seam:right].encode()), "right")
        ids = np.concatenate([a.ids[:before], middle.ids, b.ids[after:]])
        return Part(a.lo, b.hi, ids, np.cumsum(self.sizes[ids]))

    def tree(self, text: str, lo: int, hi: int) -> Part:
        if hi - lo <= self.leaf_size:
            return self.leaf(text, lo, hi)
        half = (lo + hi) // 2
        self.joins += 1
        return self.join(text, self.tree(text, lo, half), self.tree(text, half, hi))

    def encode(self, text: str) -> np.ndarray:
        """The ids of the whole text, as uint32."""
        return self.tree(text, 0, len(text)).ids

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: leaves are decoded, neighbours concatenated."""
        parts = [self.enc.decode_bytes(ids[k : k + self.leaf_size].tolist()) for k in range(0, len(ids), self.leaf_size)] or [b""]
        while len(parts) > 1:
            parts = [b"".join(parts[k : k + 2]) for k in range(0, len(parts), 2)]
        return parts[0]


@lru_cache(2)
def tree(path: str, pattern: str, leaf: int = LEAF) -> Tree:
    return Tree(encoding(path, pattern), leaf)


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's key and ids (array<int>); a null text is empty and has no ids.

    No shuffle: each batch is encoded where it is read. Repeated or null keys
    keep their rows; other columns of df are ignored, whatever their names.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[key].alias(key), df[text].alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(path, pattern)
        for b in batches:
            ids = [own.encode(x or "").view(np.int32) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Every row's key and the bytes of its ids; null ids decode to no bytes."""
    small_batches(df.sparkSession)
    rows = df.select(df[key].alias(key), df[ids].alias("_ids"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(path, pattern)
        for b in batches:
            out = [own.decode(np.array(x or [], np.uint32)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], [key, "bytes"])

    return rows.mapInArrow(run, f"`{key}` {kind}, bytes binary")


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 (ids as little-endian uint32) and decoded_sha256 of every row, in one pass.

    The ids go through the same encode and decode trees and are never stored.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[key].alias(key), df[text].alias("_text"))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(path, pattern)
        for b in batches:
            n, a, d = [], [], []
            for x in b.column(1).to_pylist():
                ids = own.encode(x or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
