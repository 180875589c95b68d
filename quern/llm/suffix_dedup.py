"""Substring dedup over bytes by suffix arrays built by induced sorting.

A byte goes if a string of `width` bytes covers it that also starts in a
document with a smaller id; strings are judged on the input and never cross
documents.

One suffix array over all text is out of reach, so the text is cut into shards
by content: a window's *anchor* is the `gram` bytes in it whose hash is least,
the leftmost of equals. Equal windows have equal anchors in equal places, so
every shard can judge its windows alone. Windows of a document that share an
anchor, and lie on the same side of it, form one *segment*, the bytes they span;
its *key* is the anchor with the bytes that all windows of that side hold.

1. Groups of documents send their keys' hashes; reducers answer those that
   another group has too. What no second document holds ends here.
2. Groups send the segments of the keys left to shards, a segment that
   several of their documents hold once, for the least id; the others lose its
   windows. A key with many different segments is *wide*: its windows are
   sent one by one, to shards by their own bytes, so that no shard gets all.
3. A shard does the same with equal segments of several groups. It concatenates
   the different segments of keys that several documents hold, builds the suffix
   array, and finds with permuted common prefixes the runs of suffixes that agree
   on `width` bytes. A window goes if its run has a smaller id.
4. Groups remove what is covered.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from quern.llm.common import U64, eights, mix, spans_hash, split_by
from quern.llm.grouped import FAN, NO_ID, Group, Grouped, in_answer, shared_here
from quern.llm.suffix import permuted_lcp, suffix_array

WIDTH, GRAM = 50, 16
#: Segments of a key, different within each group, beyond which its windows are sent one by one.
WIDE = 1024
#: Bytes that are looked at together when minimal hashes are sought.
BLOCK = 1 << 20
SEGMENT = np.dtype([("id", "<i8"), ("doc", "<u4"), ("at", "<u4"), ("key", "<u4"), ("size", "u1")])
GONE = np.dtype([("doc", "<u4"), ("at", "<u4"), ("mask", "<u8")])
_NOTES, _SEGMENTS = b"N", b"S"


def _anchors(data: np.ndarray, off: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with one anchor: first start, last start, where the anchor is."""
    n, span = int(off[-1]), width - gram + 1
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    at = eights(data)
    h = np.zeros(n, U64)
    m = n - gram + 1
    rest = at[8 : m + 8] if gram == 16 else at[gram - 8 : m + gram - 8]
    h[:m] = mix(at[:m] * U64(0x9E3779B97F4A7C15) ^ mix(rest + U64(gram)))
    low = (h[:m] & U64(0xFFFFFFFF00000000)) | np.arange(m, dtype=U64)
    have = 1
    while have * 2 <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < span:
        low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
    where = (low & U64(0xFFFFFFFF)).astype(np.int64)
    full = np.ones(len(where), bool)
    turn = np.zeros(len(where) + 1, np.int32)
    cut = off[1:-1]
    np.add.at(turn, np.clip(cut - width + 1, 0, len(where)), 1)
    np.add.at(turn, np.clip(cut, 0, len(where)), -1)
    full &= np.cumsum(turn[:-1]) == 0
    new = np.ones(len(where), bool)
    new[1:] = (where[1:] != where[:-1]) | ~full[:-1]
    new[cut[(cut > 0) & (cut < len(where))]] = True
    begin = np.flatnonzero(new & full)
    last = np.flatnonzero(full & np.r_[new[1:] | ~full[1:], True])
    return begin, last, where[begin]


class Segments:
    """All segments of a group: document, first and last window start (group positions), key.

    The windows of an anchor are two segments: those that hold the anchor and
    `half` bytes or more before it, and the others, which hold over `half` bytes
    after it. The key is the hash of the anchor with those bytes, so that
    segments meet only if they agree on about two thirds of a window.
    """

    def __init__(self, group: Group, width: int, gram: int):
        half, more = (width - gram) // 2, width - gram - (width - gram) // 2 + 1
        begin, last, key = [], [], []
        docs, off = len(group.ids), group.off
        k = 0
        while k < docs:
            e = max(k + 1, int(np.searchsorted(off, off[k] + BLOCK, "right")) - 1)
            data = group.data[off[k] : off[e] + 8]
            a, b, p = _anchors(data, off[k : e + 1] - off[k], width, gram)
            left, right = np.flatnonzero(a <= p - half), np.flatnonzero(b > p - half)
            begin += [a[left] + off[k], np.maximum(a[right], p[right] - half + 1) + off[k]]
            last += [np.minimum(b[left], p[left] - half) + off[k], b[right] + off[k]]
            key += [spans_hash(data, p[left] - half, p[left] + gram, 3), spans_hash(data, p[right], p[right] + gram + more, 4)]
            k = e
        self.begin, self.last, self.key = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((begin, np.int64), (last, np.int64), (key, U64)))
        self.doc = np.searchsorted(off, self.begin, "right") - 1
        self.id = group.ids[self.doc]
        known = self.id != NO_ID
        if not known.all():
            self.begin, self.last, self.key, self.doc, self.id = (x[known] for x in (self.begin, self.last, self.key, self.doc, self.id))


def _least_of_equals(data: np.ndarray, begin: np.ndarray, end: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which spans of data have the least id of those with their bytes.

    Spans with the hash of a least one, but other bytes, count as least too.
    """
    h = spans_hash(data, begin, end, seed=7)
    order = np.lexsort((ids, h))
    hs, i = h[order], ids[order]
    first = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
    size = np.diff(np.r_[first, len(h)])
    least = i == np.repeat(i[first], size)
    low = np.flatnonzero(~least)
    a, b, n = begin[order[low]], begin[np.repeat(order[first], size)[low]], (end - begin)[order[low]]
    other = n != (end - begin)[np.repeat(order[first], size)[low]]
    at, here, k = eights(data), np.flatnonzero(~other), 0
    while len(here):
        left = n[here] - k
        # Of the last eight bytes some may lie before k.
        step = np.minimum(k, np.maximum(n[here] - 8, 0))
        part = np.where(left >= 8, U64(0xFFFFFFFFFFFFFFFF), U64(0xFFFFFFFFFFFFFFFF) if k else (U64(1) << (np.minimum(left, 7) * 8).astype(U64)) - U64(1))
        other[here] |= (at[a[here] + step] ^ at[b[here] + step]) & part != 0
        k += 8
        here = here[n[here] > k]
    least[low[other]] = True
    out = np.zeros(len(h), bool)
    out[order] = least
    return out


def _packed(data: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> bytes:
    size = rows["size"].astype(np.int64)
    ends = np.cumsum(size)
    take = np.repeat(starts - (ends - size), size) + np.arange(int(size.sum()))
    return _SEGMENTS + np.array([len(rows)], "<u4").tobytes() + rows.tobytes() + data[take].tobytes()


def _told_keys(g: int, key: np.ndarray, content: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    """Messages with a group's distinct keys, as uint32, and how many different segments each has, up to 255."""
    _, at = np.unique(mix(key ^ mix(content)), return_index=True)
    k, count = np.unique(key[at], return_counts=True)
    count = np.minimum(count, 255).astype(np.uint8)
    bucket = ((k >> U64(32)) % U64(n)).astype(np.int64)
    return [(b, g, low.tobytes() + c.tobytes()) for b, low, c in split_by(bucket, n, (k & U64(0xFFFFFFFF)).astype("<u4"), count)]


def _wide_numbers(most: int):
    def run(bucket: int, rows: list[tuple[int, bytes]]) -> list[tuple[int, int, bytes]]:
        """Each group's keys that another group sent too: the numbers, and which are wide. A group's own wide ones too."""
        sizes = [len(b) // 5 for _, b in rows]
        number = np.concatenate([np.frombuffer(b, "<u4", m) for (_, b), m in zip(rows, sizes, strict=True)])
        count = np.concatenate([np.frombuffer(b, np.uint8, m, 4 * m) for (_, b), m in zip(rows, sizes, strict=True)]).astype(np.int64)
        who = np.repeat(np.arange(len(rows)), sizes)
        order = np.argsort(number, kind="stable")
        number, count, who = number[order], count[order], who[order]
        begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        held = np.diff(np.r_[begin, len(number)])
        wide = np.repeat(np.add.reduceat(count, begin) > most, held)
        due = np.repeat(held > 1, held) | wide
        return [(bucket, rows[k][0], a.tobytes() + w.tobytes()) for k, a, w in split_by(who[due], len(rows), number[due], wide[due].astype(np.uint8))]

    return run


def _notes(doc: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All of `count` windows from each place on."""
    out = np.zeros(len(doc), GONE)
    out["doc"], out["at"] = doc, at
    out["mask"] = U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - count.astype(U64))
    return out


def _by_group(shard: int, who: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, bytes]]:
    groups, at = np.unique(who, return_inverse=True)
    return [(shard, int(groups[k]), x.tobytes()) for k, x in split_by(at, len(groups), rows)]


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, texts: bool | str = True, carry: Column | None = None, wide: int = WIDE, fan: int = FAN) -> DataFrame:
    """Every row's key, n_bytes, n_removed, n_spans, kept (the bytes left), kept_text, kept_sha256 and carried.

    kept_text is kept without the characters that a removed span cuts in two;
    carried is `carry`, a string column, unchanged.

    n_spans counts maximal removed runs. A null text is empty. Rows with the
    same id do not count against each other; a row with a null id keeps all its
    bytes and is held against none. Other columns of df are ignored, whatever
    their names. Without `texts`, kept and kept_text are null; with "text", kept is.
    """
    if not 8 <= gram <= 16 or not gram < width <= gram + 63:
        raise ValueError("gram is 8 to 16 bytes, and width up to 63 bytes more")
    docs = Grouped(df, key, text, carry, fan)
    n = docs.n
    shards = 4 * n

    def tell_keys(group: Group):
        s = Segments(group, width, gram)
        return _told_keys(group.g, s.key, spans_hash(group.data, s.begin, s.last + width, seed=7), n)

    def tell_segments(group: Group, answer):
        s = Segments(group, width, gram)
        parts = [(b, np.frombuffer(x, "<u4", len(x) // 5), np.frombuffer(x, np.uint8, offset=len(x) // 5 * 4)) for b, x in answer]
        shared = in_answer(s.key, [(b, a.tobytes()) for b, a, _ in parts], n)
        wide = in_answer(s.key, [(b, a[w > 0].tobytes()) for b, a, w in parts], n)
        take = shared | shared_here(s.key, s.id)
        begin, last, doc, ids, key, wide = (x[take] for x in (s.begin, s.last, s.doc, s.id, s.key, wide))
        if not len(begin):
            return []
        # Windows of wide keys are segments of their own, and keys.
        count = np.where(wide, last - begin + 1, 1)
        each = np.repeat(np.arange(len(begin)), count)
        step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
        wide = wide[each]
        begin, last = begin[each] + step, np.where(wide, begin[each] + step, last[each])
        doc, ids, key = doc[each], ids[each], key[each]
        key[wide] = spans_hash(group.data, begin[wide], begin[wide] + width, seed=7)
        least = _least_of_equals(group.data, begin, last + width, ids)
        out = []
        for own, part in ((False, ~least), (True, least)):
            b, e, d = begin[part], last[part], doc[part]
            at = (b - group.off[d]).astype(np.uint32)
            if own:
                rows = np.zeros(len(b), SEGMENT)
                rows["id"], rows["doc"], rows["at"], rows["size"] = ids[part], d, at, e + width - b
                rows["key"] = key[part] & U64(0xFFFFFFFF)
                shard = (key[part] >> U64(20)) % U64(shards)
                out += [(k, group.g, _packed(group.data, r, x)) for k, r, x in split_by(shard.astype(np.int64), shards, rows, b)]
            elif len(b):
                out.append((group.g % shards, group.g, _NOTES + _notes(d, at, e - b + 1).tobytes()))
        return out

    def judge(shard: int, sent):
        out = [(shard, g, b[1:]) for g, b in sent if b[:1] == _NOTES]
        rows, raw, who = [], [], []
        for g, b in sent:
            if b[:1] == _SEGMENTS:
                m = int(np.frombuffer(b[1:5], "<u4")[0])
                rows.append(np.frombuffer(b, SEGMENT, m, 5))
                raw.append(np.frombuffer(b, np.uint8, offset=5 + m * SEGMENT.itemsize))
                who.append(np.full(m, g, np.int64))
        if not rows:
            return out
        rows, t, who = np.concatenate(rows), np.concatenate(raw), np.concatenate(who)
        # Of equal segments of several groups the least id's go on; the others lose all their windows.
        size = rows["size"].astype(np.int64)
        ends = np.cumsum(size)
        least = _least_of_equals(np.concatenate([t, np.zeros(8, np.uint8)]), ends - size, ends, rows["id"])
        gone = rows[~least]
        out += _by_group(shard, who[~least], _notes(gone["doc"], gone["at"], gone["size"].astype(np.int64) - width + 1))
        # Equal windows have equal keys: a segment that is alone with its key, or whose key has one id, meets nothing.
        at = np.flatnonzero(least)
        at = at[shared_here(rows["key"][at], rows["id"][at])]
        go = np.zeros(len(rows), bool)
        go[at] = True
        rows, who, t = rows[go], who[go], t[np.repeat(go, size)]
        if not len(rows):
            return out
        size = rows["size"].astype(np.int64)
        ends = np.cumsum(size)
        sa = suffix_array(t)
        joined = permuted_lcp(t, sa, width)[sa] >= width
        of = np.repeat(np.arange(len(rows), dtype=np.int32), size)
        place = (np.arange(len(t)) - np.repeat(ends - size, size)).astype(np.int32)
        whole = place <= np.repeat(size - width, size)
        run = np.cumsum(~joined)  # from 1
        good = whole[sa]
        run, at = run[good], sa[good]
        ids = rows["id"][of[at]]
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        least = np.repeat(np.minimum.reduceat(ids, begin), np.diff(np.r_[begin, len(run)]))
        at = np.sort(at[least < ids])
        if len(at):
            gone = np.zeros(len(rows), U64)
            np.bitwise_or.at(gone, of[at], U64(1) << place[at].astype(U64))
            hit = np.flatnonzero(gone)
            reply = np.zeros(len(hit), GONE)
            reply["doc"], reply["at"], reply["mask"] = rows["doc"][hit], rows["at"][hit], gone[hit]
            out += _by_group(shard, who[hit], reply)
        return out

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, kept_sha256 string, carried string"

    def remove(group: Group, answer) -> pa.Table:
        n_all = int(group.off[-1])
        gone = np.zeros(n_all, bool)
        if answer:
            a = np.frombuffer(b"".join(b for _, b in answer), GONE)
            base, turn = group.off[a["doc"]] + a["at"], np.zeros(n_all + 1, np.int32)  # sums stay small, for a window is marked once
            for k in range(64):
                s = base[(a["mask"] >> U64(k)) & U64(1) > 0] + k
                np.add.at(turn, s, 1)
                np.add.at(turn, s + width, -1)
            gone = np.cumsum(turn, out=turn)[:-1] > 0
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        cut = group.off[1:-1]
        cut = cut[(cut > 0) & (cut < n_all)]
        first[cut] = gone[cut]
        count, runs = (np.zeros(len(group.ids), np.int64) for _ in range(2))
        some = np.flatnonzero(np.diff(group.off))
        if len(some):
            count[some], runs[some] = (np.add.reduceat(x.view(np.uint8), group.off[some], dtype=np.int64) for x in (gone, first))
        kept, kept_text, digest = [], [], []
        for k in range(len(group.ids)):
            lo, hi = group.off[k], group.off[k + 1]
            own = group.data[lo:hi]
            own = (own[~gone[lo:hi]] if count[k] else own).tobytes()
            kept.append(own if texts is True else None)
            kept_text.append(own.decode("utf-8", "ignore") if texts else None)
            digest.append(hashlib.sha256(own).hexdigest())
        return pa.table(
            [
                group.id_column, pa.array(np.diff(group.off), pa.int64()), pa.array(count, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary()),
                pa.array(kept_text, pa.string()), pa.array(digest), pa.array([c.decode() for c in group.carried], pa.string()),
            ],
            ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "kept_sha256", "carried"],
        )

    shared = docs.reduced(docs.tell(tell_keys, n), _wide_numbers(wide), n)
    answers = docs.reduced(docs.hear(shared, tell_segments, to=shards), judge, shards)
    return docs.hear(answers, remove, schema).withColumnRenamed("id", key)
