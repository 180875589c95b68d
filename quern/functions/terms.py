"""Terms of texts, a batch of them at a time: words are told apart once, then only numbers are sorted and counted."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.functions import fixed
from quern.functions.text import SPACE

_NUMBERED = r"\b(?:[Ii][Ss]-|[Ii][Nn][Cc]-|[Rr][Ee][Ff]|[Rr][Ee][Qq]|[Ss][Ee][Ss][Dd]-|[Cc][Aa][Ss]-|[Cc][Ss])[0-9]+\b"
_PROPER = re.compile("[A-ZÄÖÅ][A-ZÄÖÅ0-9]{2,}$|[A-ZÄÖÅ][a-zäöå]+[A-ZÄÖÅ]")
_NUMBER, _DECIMAL = re.compile("[0-9]+$"), re.compile(r"[0-9]+\.[0-9]+")
_STOP = frozenset(fixed.STOP_WORDS)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The text and the name of every word, as numbers, and the names; the same words as text.words_for_topics."""
    for found, by in ((_NUMBERED, ""), (r"\b[0-9A-Fa-f]{6,}\b", ""), (f"{SPACE.replace('[', '[^', 1)}+@{SPACE.replace('[', '[^', 1)}+", ""), (r"[()\[\]{}<>]", " "), ("[\"'“”‘’`«»]", "")):
        texts = pc.replace_substring_regex(texts, found, by)
    lists = pc.split_pattern_regex(texts, f"{SPACE}+")
    parted = pc.list_flatten(lists).dictionary_encode()
    names = pc.utf8_trim(parted.dictionary, characters=".,;:!?").dictionary_encode()
    code = names.indices.to_numpy()[parted.indices.to_numpy()] if len(parted) else np.zeros(0, int)
    long = np.array([len(w) >= 2 for w in names.dictionary.to_pylist()], bool)
    keep = long[code] if len(code) else np.zeros(0, bool)
    return pc.list_parent_indices(lists).to_numpy()[keep].astype(np.int64), code[keep].astype(np.int64), names.dictionary.to_pylist()


class Terms:
    """(doc, key, tf, first) of the terms of texts, by doc and key: unigrams, then bigrams, whose first places come after those of unigrams."""

    def __init__(self, texts: pa.Array):
        doc, code, names = words(texts)
        table: dict[str, int] = {}
        low, single, pairs = np.zeros(len(names), np.int64), np.full(len(names), -1), np.zeros(len(names), bool)
        for k, w in enumerate(names):
            lower = w.lower()
            low[k] = table.setdefault(lower, len(table))
            pairs[k] = lower not in _STOP and not _NUMBER.match(w)
            if pairs[k] and not _DECIMAL.match(w):
                single[k] = table.setdefault(w if _PROPER.match(w) else lower, len(table))
        self.names, self.n = list(table), max(1, len(table))
        at = np.arange(len(doc)) - np.searchsorted(doc, doc)
        one = np.flatnonzero(single[code] >= 0) if len(code) else np.zeros(0, int)
        two = np.flatnonzero((doc[:-1] == doc[1:]) & pairs[code[:-1]] & pairs[code[1:]]) if len(code) > 1 else np.zeros(0, int)
        docs = np.concatenate([doc[one], doc[two]])
        keys = np.concatenate([single[code[one]], self.n + low[code[two]] * self.n + low[code[two + 1]] if len(two) else np.zeros(0, np.int64)])
        places = np.concatenate([at[one], at[two] + (1 << 31)])
        width = self.n * (self.n + 1)
        both = docs * width + keys
        order = np.argsort(both, kind="stable")
        both = both[order]
        start = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, int)
        self.doc, self.key = both[start] // width, both[start] % width
        self.tf, self.first = np.diff(np.r_[start, len(both)]), places[order[start]]

    def spelled(self, keys: np.ndarray) -> pa.Array:
        table = pa.array(self.names or [""], pa.string())
        pair = keys >= self.n
        rest = np.where(pair, keys - self.n, 0)
        left = table.take(pa.array(np.where(pair, rest // self.n, keys)))
        return pc.if_else(pa.array(pair), pc.binary_join_element_wise(left, table.take(pa.array(rest % self.n)), " "), left)

    def proper(self, keys: np.ndarray) -> np.ndarray:
        is_name = np.array([bool(_PROPER.match(w)) for w in self.names or [""]])
        return (keys < self.n) & is_name[np.minimum(keys, self.n - 1)]

    def hashes(self, keys: np.ndarray, corpus: str) -> np.ndarray:
        """128 bits for each key, which equal terms of a corpus share wherever they are: rows of two numbers."""
        salt = corpus.encode()
        own = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=16, key=hashlib.blake2b(salt, digest_size=16).digest()).digest() for w in self.names or [""]), "<u8").reshape(-1, 2)
        pair = keys >= self.n
        rest = np.where(pair, keys - self.n, 0)
        left, right = own[np.where(pair, rest // self.n, keys)], own[rest % self.n]
        mixed = _mix(_mix(left ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + right)
        return np.where(pair[:, None], mixed, left)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def summed(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each row of hashes the sum of the counts of all rows equal to it."""
    order = np.argsort(hashes[:, 0], kind="stable")
    s = hashes[order]
    same = s[1:, 0] == s[:-1, 0]
    if (same & (s[1:, 1] != s[:-1, 1])).any():
        order = np.lexsort((hashes[:, 1], hashes[:, 0]))
        s = hashes[order]
    new = np.r_[True, (s[1:] != s[:-1]).any(1)] if len(s) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    out = np.zeros(len(counts), np.int64)
    out[order] = np.bincount(group, weights=counts[order]).astype(np.int64)[group] if len(s) else 0
    return out
