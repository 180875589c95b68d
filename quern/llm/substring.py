"""Substring dedup over words by difference-cover anchors.

A window is `width` consecutive words of a document. A word goes if a window
covers it whose words also start a window in a document with a smaller id;
windows are judged on the input.

Two equal windows at word positions i and j share an *aligned anchor*: with a
difference cover D of the period v, some d < v puts both i + d and j + d on
positions that are in D modulo v. So only positions in D are hashed, over
anchors of width - v + 1 words, which lie inside the window for every d. With
v = 7 and D = {0, 1, 3}, three positions in seven are hashed.

1. Every group of documents sends the hashes of its anchors; reducers answer
   those that another group has too. Anchors that no second document holds end
   here, and with them most of the text.
2. Each anchor left is extended: the windows that hold it, within its document,
   are hashed whole (96 bits), and sent with the group's least id for each.
3. Reducers answer the least id of all groups for each window, to groups in
   which a document has a larger id. Groups then remove what is covered.

Every step sees all documents; there is no cap on how often anything occurs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import U64, covered, full_windows, owner, spans_hash, split_by, windows_hash, words
from quern.llm.grouped import FAN, NO_ID, Group, Grouped, in_answer, shared_here, shared_numbers, told_numbers

WIDTH = 13
#: A difference cover for each period: every difference modulo the period is one of two members.
COVERS = {1: (0,), 2: (0, 1), 3: (0, 1), 5: (0, 1, 2), 7: (0, 1, 3), 13: (0, 1, 3, 9)}
WINDOW = np.dtype([("h1", "<u8"), ("h2", "<u4"), ("many", "<u4"), ("id", "<i8")])


class Words:
    """Words of a group with their hashes, anchors and windows."""

    def __init__(self, group: Group, width: int, period: int):
        self.starts, self.ends, self.off = words(group.data, group.off)
        self.hash = spans_hash(group.data, self.starts, self.ends)
        self.doc = owner(self.off)
        self.id = group.ids[self.doc]
        self.full = full_windows(self.off, width)
        if len(self.full):
            self.full &= self.id[: len(self.full)] != NO_ID
        self.width, self.period = width, period

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of anchors that some full window holds, and their hashes."""
        span = self.width - self.period + 1
        h = windows_hash(self.hash, span, seed=3)
        place = (np.arange(len(h)) - self.off[self.doc[: len(h)]]) % self.period
        good = np.isin(place, COVERS[self.period]) & covered(np.flatnonzero(self.full), self.period, len(h))
        at = np.flatnonzero(good)
        return at, h[at]

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of the full windows that hold an anchor at one of the positions."""
        n = len(self.full)
        turn = np.zeros(n + self.period + 1, np.int32)
        np.add.at(turn, np.maximum(at - self.period + 1, 0), 1)
        np.add.at(turn, np.minimum(at + 1, n), -1)
        s = np.flatnonzero((np.cumsum(turn)[:n] > 0) & self.full)
        return s, windows_hash(self.hash, self.width, 5)[s], (windows_hash(self.hash, self.width, 11)[s] >> U64(32)).astype(np.uint32)


def least_ids(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows in order of window, and where each window begins."""
    rows = rows[np.lexsort((rows["id"], rows["h2"], rows["h1"]))]
    begin = np.flatnonzero(np.r_[True, (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])])
    return rows, begin


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, period: int = 7, texts: bool = True, fan: int = FAN) -> DataFrame:
    """Every row's key, n_words, n_removed, kept (its words left, one space between them) and kept_sha256.

    Without `texts`, kept is null.

    A null text has no words and keeps an empty text. Rows with the same id do
    not count against each other. A row with a null id keeps all its words and
    is held against none. Other columns of df are ignored, whatever their names.
    """
    if period not in COVERS or period > width:
        raise ValueError(f"no difference cover for period {period} and width {width}")
    docs = Grouped(df, key, text, fan=fan)
    n = docs.n

    def tell_anchors(group: Group):
        return told_numbers(group.g, Words(group, width, period).anchors()[1], n)

    def tell_windows(group: Group, answer):
        w = Words(group, width, period)
        at, h = w.anchors()
        at = at[shared_here(h, w.id[at]) | in_answer(h, answer, n)]
        if not len(at):
            return []
        s, h1, h2 = w.windows(at)
        rows = np.zeros(len(s), WINDOW)
        rows["h1"], rows["h2"], rows["id"] = h1, h2, w.id[s]
        rows, begin = least_ids(rows)
        if not len(rows):
            return []
        most = np.maximum.reduceat(rows["id"], begin)
        rows = rows[begin]
        rows["many"] = most != rows["id"]
        bucket = ((rows["h1"] >> U64(32)) % U64(n)).astype(np.int64)
        return [(b, group.g, part.tobytes()) for b, part in split_by(bucket, n, rows)]

    def answer_windows(bucket: int, sent):
        who = np.repeat(np.arange(len(sent)), [len(b) // WINDOW.itemsize for _, b in sent])
        rows = np.frombuffer(b"".join(b for _, b in sent), WINDOW)
        order = np.lexsort((rows["id"], rows["h2"], rows["h1"]))
        rows, who = rows[order], who[order]
        begin = np.flatnonzero(np.r_[True, (rows["h1"][1:] != rows["h1"][:-1]) | (rows["h2"][1:] != rows["h2"][:-1])])
        least = np.repeat(rows["id"][begin], np.diff(np.r_[begin, len(rows)]))
        due = (least < rows["id"]) | (rows["many"] > 0)
        rows, who = rows[due].copy(), who[due]
        rows["id"] = least[due]
        return [(bucket, sent[k][0], part.tobytes()) for k, part in split_by(who, len(sent), rows)]

    schema = "id long, n_words long, n_removed long, kept string, kept_sha256 string"

    def remove(group: Group, answer) -> pa.Table:
        w = Words(group, width, period)
        gone = np.zeros(len(w.starts), bool)
        if answer:
            known = np.sort(np.frombuffer(b"".join(b for _, b in answer), WINDOW), order=["h1", "h2"])
            h1, first = windows_hash(w.hash, width, 5), known["h1"]
            at = np.minimum(np.searchsorted(first, h1), len(known) - 1)
            s = np.flatnonzero((first[at] == h1) & w.full)
            h2 = (windows_hash(w.hash, width, 11)[s] >> U64(32)).astype(np.uint32)
            at, hit = at[s], np.zeros(len(s), bool)
            while True:  # more than once only where 64-bit hashes of different windows meet
                same = (at < len(known)) & (known["h1"][np.minimum(at, len(known) - 1)] == h1[s])
                if not same.any():
                    break
                k = np.minimum(at, len(known) - 1)
                hit |= same & (known["h2"][k] == h2) & (known["id"][k] < w.id[s])
                at = np.where(same, at + 1, len(known))
            gone = covered(s[hit], width, len(w.starts))
        return results(group, w, gone, texts)

    shared = docs.reduced(docs.tell(tell_anchors, n), shared_numbers, n)
    answers = docs.reduced(docs.hear(shared, tell_windows, to=n), answer_windows, n)
    return docs.hear(answers, remove, schema).withColumnRenamed("id", key)


def results(group: Group, w: Words, gone: np.ndarray, texts: bool) -> pa.Table:
    removed = np.r_[0, np.cumsum(gone)]
    raw = group.data.tobytes()
    kept, digest, off = [], [], w.off
    count = removed[off[1:]] - removed[off[:-1]]
    for k in range(len(group.ids)):
        own = raw[group.off[k] : group.off[k + 1]].split()
        if count[k]:
            own = [x for x, out in zip(own, gone[off[k] : off[k + 1]].tolist(), strict=True) if not out]
        own = b" ".join(own)
        kept.append(own if texts else None)
        digest.append(hashlib.sha256(own).hexdigest())
    return pa.table(
        [group.id_column, pa.array(np.diff(off), pa.int64()), pa.array(count, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest)],
        ["id", "n_words", "n_removed", "kept", "kept_sha256"],
    )
