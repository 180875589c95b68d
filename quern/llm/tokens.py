"""Whole texts to ids with the tokenizers library, a piece at a time.

A byte-level pre-tokeniser always ends a match before white space that follows
something else, so text cut there encodes piece by piece to the same ids. The
pieces, mostly one word with the space before it, are found as spans of the
text's bytes and looked up in a table of pieces seen: a hash finds the place,
the bytes decide. Only pieces that the table lacks reach the library, many at a
time. Texts with white space beyond ASCII, or with the string of a special token,
are one piece. The table only saves time: a full one is emptied, and the ids are
the library's in any case.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np

from quern.llm.common import U64, eights, owner, spans_hash, utf8, words

#: Pieces kept, the longest piece that is kept (bytes), and the table's places.
KEPT, LONGEST, PLACES = 2_000_000, 48, 1 << 22
#: Pieces that the library encodes as one string, and bytes of text whose pieces are looked up together.
TOGETHER, PART = 4096, 2 << 20
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
# The UTF-8 forms of white space beyond ASCII.
_OTHER_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]

#: 1: ASCII letters; 2: ASCII marks and digits.
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[[*range(65, 91), *range(97, 123)]] = 1


def _uncut(data: np.ndarray, off: np.ndarray, special: tuple[bytes, ...]) -> np.ndarray:
    """Which texts hold white space beyond ASCII or the string of a special token."""
    out = np.zeros(len(off) - 1, bool)
    raw = data[: int(off[-1])].tobytes() if special else b""
    for s in special:
        at = raw.find(s)
        while at >= 0:
            k = int(np.searchsorted(off, at, "right")) - 1
            out[k] = True
            at = raw.find(s, int(off[k + 1]) if at + len(s) <= off[k + 1] else at + 1)
    lead = np.flatnonzero(data[: int(off[-1])] >= 0xC2)
    lead = lead[np.isin(data[lead], sorted({s[0] for s in _OTHER_SPACE}))]
    for s in _OTHER_SPACE:
        at = lead[data[lead] == s[0]]
        for k, b in enumerate(s[1:], 1):
            at = at[data[at + k] == b]
        out[np.searchsorted(off, at, "right") - 1] = True
    return out


def pieces(data: np.ndarray, off: np.ndarray, special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every piece, n + 1 offsets of each text's pieces, and which pieces may be joined to others of their kind.

    A piece ends where a word ends, and where an ASCII letter comes before an
    ASCII mark or digit: no alternative of the pre-tokeniser goes on past the end
    of a run of letters. White space at a text's end is a piece of its own.
    Pieces that begin with white space and end in something else are joinable.
    """
    starts, ends, woff = words(data, off)
    other = _uncut(data, off, special)
    if other.any():
        good = ~other[owner(woff)]
        starts, ends = starts[good], ends[good]
        woff = np.r_[0, np.cumsum(np.where(other, 0, np.diff(woff)))]
    n = np.diff(woff)
    begin = np.r_[0, ends[:-1]] if len(ends) else ends
    begin[woff[:-1][n > 0]] = off[:-1][n > 0]
    joins = begin < starts
    last = off[:-1].copy()
    last[n > 0] = ends[woff[1:][n > 0] - 1]
    rest = np.flatnonzero(last < off[1:])
    at = woff[1:][rest]
    begin, ends, joins = np.insert(begin, at, last[rest]), np.insert(ends, at, off[1:][rest]), np.insert(joins, at, False)
    poff = np.r_[0, np.cumsum(n + (last < off[1:]))]
    kind = _KIND[data[: int(off[-1])]]
    cut = np.flatnonzero((kind[:-1] == 1) & (kind[1:] == 2)) + 1
    within = np.searchsorted(begin, cut, "right") - 1
    good = (cut > begin[within]) & (cut < ends[within]) & ~other[np.searchsorted(off, cut, "right") - 1]
    cut, within = cut[good], within[good]
    if len(cut):
        more = np.r_[0, np.cumsum(np.bincount(within, minlength=len(begin)))]
        stop = np.insert(ends, within, cut)
        start = np.insert(begin, within + 1, cut)
        joins = np.insert(joins, within + 1, False)
        return start, stop, poff + more[poff], joins
    return begin, ends, poff, joins


class Table:
    """Ids of byte strings of at most LONGEST bytes, by open addressing on a 64-bit hash, proved by the bytes."""

    def __init__(self, dtype: np.dtype):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.n = self.n_bytes = self.n_ids = 0
        self.hashes, self.entry = np.zeros(PLACES, U64), np.zeros(PLACES, np.int32)
        self.at, self.size, self.ids_at, self.count = (np.zeros(1024, t) for t in (np.uint32, np.uint8, np.uint32, np.uint8))
        self.bytes, self.ids = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, self.dtype)

    def find(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entry of each span, or -1; and which spans' hash stands for other bytes."""
        place = (h >> U64(40)).astype(np.int64) & (PLACES - 1)
        got = self.hashes[place]
        out = np.where(got == h, self.entry[place], -1)
        open_ = np.flatnonzero((got != h) & (got != 0))
        place = place[open_]
        while len(open_):
            place = (place + 1) & (PLACES - 1)
            got = self.hashes[place]
            same = got == h[open_]
            out[open_[same]] = self.entry[place[same]]
            more = ~same & (got != 0)
            open_, place = open_[more], place[more]
        hit = np.flatnonzero(out >= 0)
        known, mine, theirs = out[hit], eights(data), eights(self.bytes)
        wrong = self.size[known] != size[hit]
        here, k = np.arange(len(hit)), 0
        while len(here):
            part = _MASKS[np.minimum(size[hit[here]] - k, 8)]
            a, b = mine[start[hit[here]] + k], theirs[np.minimum(self.at[known[here]].astype(np.int64) + k, len(theirs) - 1)]
            wrong[here] |= (a ^ b) & part != 0
            k += 8
            here = here[size[hit[here]] > k]
        clash = np.zeros(len(h), bool)
        clash[hit[wrong]] = True
        out[clash] = -1
        return out, clash

    def _room(self, name: str, n: int) -> None:
        have = getattr(self, name)
        if len(have) < n:
            setattr(self, name, np.concatenate([have, np.zeros(max(n, 2 * len(have)) - len(have), have.dtype)]))

    def add(self, h: np.ndarray, spans: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """Enter spans, whose hashes are distinct and not here yet: their bytes and ids side by side, with sizes."""
        n = len(h)
        for name in ("at", "size", "ids_at", "count"):
            self._room(name, self.n + n)
        self._room("bytes", self.n_bytes + len(spans) + 8)
        self._room("ids", self.n_ids + len(ids))
        new = slice(self.n, self.n + n)
        self.size[new], self.count[new] = size, count
        self.at[new], self.ids_at[new] = self.n_bytes + np.cumsum(size) - size, self.n_ids + np.cumsum(count) - count
        self.bytes[self.n_bytes : self.n_bytes + len(spans)] = spans
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        entry, place = np.arange(self.n, self.n + n, dtype=np.int32), (h >> U64(40)).astype(np.int64) & (PLACES - 1)
        while len(h):
            free = self.hashes[place] == 0
            self.hashes[place[free]] = h[free]
            won = self.hashes[place] == h
            self.entry[place[won]] = entry[won]
            entry, place, h = entry[~won], (place[~won] + 1) & (PLACES - 1), h[~won]
        self.n, self.n_bytes, self.n_ids = self.n + n, self.n_bytes + len(spans), self.n_ids + len(ids)


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        special = {i: len(t.content.encode()) for i, t in self.library.get_added_tokens_decoder().items()}
        # The byte-level alphabet writes one character per byte.
        self.sizes = np.array([special.get(i) or len(self.library.id_to_token(i) or "") for i in range(size)], np.int64)
        self.special = tuple(t.content.encode() for t in self.library.get_added_tokens_decoder().values())
        self.table = Table(self.dtype)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _learn(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray, joins: np.ndarray) -> None:
        """Enter pieces; joinable ones are encoded as one string, many at a time."""
        order = np.argsort(~joins, kind="stable")
        h, start, size, joins = h[order], start[order], size[order], joins[order]
        ends = np.cumsum(size)
        spans = data[np.repeat(start - (ends - size), size) + np.arange(int(ends[-1]))]
        ids, counts, n = [], [], int(joins.sum())
        for k in range(0, n, TOGETHER):
            some = ends[k : min(k + TOGETHER, n)]
            lo = int(ends[k - 1]) if k else 0
            ids.append(self.whole(spans[lo : int(some[-1])].tobytes().decode()))
            counts.append(np.diff(np.searchsorted(np.cumsum(self.sizes[ids[-1]]), some - lo) + 1, prepend=0))
        for lo, hi in zip((ends - size)[n:].tolist(), ends[n:].tolist(), strict=True):
            ids.append(self.whole(spans[lo:hi].tobytes().decode()))
            counts.append(np.array([len(ids[-1])]))
        self.table.add(h, spans, size, np.concatenate(ids), np.concatenate(counts))

    def encode(self, column, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of an Arrow column, in the smallest unsigned type that holds them, and n + 1 offsets.

        A null has none. With `end`, that id follows each text's.
        """
        data, off = utf8(column)
        lo, found, ends = 0, [np.zeros(0, self.dtype)], [np.zeros(1, np.int64)]
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + PART, "right")) - 1)
            flat, own = self._encode(data[off[lo] : off[hi] + 8], off[lo : hi + 1] - off[lo], end)
            found.append(flat)
            ends.append(own[1:] + ends[-1][-1])
            lo = hi
        return np.concatenate(found), np.concatenate(ends)

    def _encode(self, data: np.ndarray, off: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        start, stop, poff, joins = pieces(data, off, self.special)
        size = stop - start
        if self.table.n > KEPT:
            self.table.clear()
        table, short = self.table, np.flatnonzero(size <= LONGEST)
        h = spans_hash(data, start[short], stop[short], 5)
        h[h == 0] = 1
        entry = np.full(len(start), -1, np.int64)
        entry[short], clash = table.find(h, data, start[short], size[short])
        new = np.flatnonzero((entry[short] < 0) & ~clash)
        if len(new):
            hashes, first = np.unique(h[new], return_index=True)
            at = short[new[first]]
            self._learn(hashes, data, start[at], size[at], joins[at])
            entry[short[new]] = table.find(h[new], data, start[short[new]], size[short[new]])[0]
        # Long pieces, and those whose hash stands for another piece.
        alone = np.flatnonzero(entry < 0)
        extra = [self.whole(data[a:b].tobytes().decode()) for a, b in zip(start[alone].tolist(), stop[alone].tolist(), strict=True)]
        count, at = table.count[entry].astype(np.int64), table.ids_at[entry].astype(np.int64)
        pool = table.ids
        if len(alone):
            count[alone] = [len(x) for x in extra]
            at[alone] = table.n_ids + np.cumsum(count[alone]) - count[alone]
            pool = np.concatenate([pool[: table.n_ids], *extra])
        total = np.r_[0, np.cumsum(count)]
        flat = pool[np.repeat(at - total[:-1], count) + np.arange(int(total[-1]))]
        ends = total[poff]
        if end is not None:
            flat, ends = np.insert(flat, ends[1:], end), ends + np.arange(len(ends))
        return flat, ends


@lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per process, so that its table serves all tasks of a worker."""
    return Encoder(path)
