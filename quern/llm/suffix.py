"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy arrays.

Suffixes are S (smaller than the next one) or L; a leftmost S suffix after an L
is LMS. LMS substrings are sorted by inducing from an arbitrary order of their
first characters, named, and, where names repeat, sorted recursively as suffixes
of the string of names; the order of the LMS suffixes then induces all others.

Inducing scans the array and places the suffix before each one it meets. Here
one step takes a whole run of slots that are already filled: what they induce
lies beyond the run, or it would have been an empty slot in it. A bucket of
bytes needs a few steps, an alphabet of names about the root of its length.
"""

from __future__ import annotations

import numpy as np

from quern.llm.common import eights


def _types(t: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last is L, for the empty suffix is smaller."""
    n = len(t)
    step = np.full(n, -1, np.int8)
    step[:-1] = (t[1:] > t[:-1]).astype(np.int8) - (t[1:] < t[:-1])
    at = np.where(step != 0, np.arange(n, dtype=np.int32), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return step[at] > 0


def _place(slots: np.ndarray, edge: np.ndarray, t: np.ndarray, j: np.ndarray, way: int) -> None:
    """Put suffixes j, in order, at the moving edges of the buckets of their first characters."""
    c = t[j]
    if len(j) == 1:
        k = c[0]
        slots[edge[k] - (way < 0)] = j[0]
        edge[k] += way
        return
    order = np.argsort(c, kind="stable")
    c, j = c[order], j[order]
    new = np.empty(len(c), bool)
    new[0] = True
    np.not_equal(c[1:], c[:-1], out=new[1:])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(c)))
    rank = np.arange(len(c)) - np.repeat(begin, count)
    slots[edge[c] + rank if way > 0 else edge[c] - 1 - rank] = j
    edge[c[begin]] += way * count


def _induce(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The suffix array that follows from LMS suffixes in the given order."""
    n = len(t)
    size_l = np.bincount(t[~is_s], minlength=k)
    size_m = np.bincount(t[lms], minlength=k)
    begin = np.cumsum(size_l + size_m) - size_l - size_m
    slots = np.full(int(size_l.sum()) + len(lms), -1, np.int32)
    is_l_slot = np.ones(len(slots), bool)
    if len(lms):
        c = t[lms]
        order = np.argsort(c, kind="stable")
        where = np.arange(len(lms)) + np.repeat(np.cumsum(size_l), size_m)
        slots[where] = lms[order]
        is_l_slot[where] = False
    edge = begin.copy()
    _place(slots, edge, t, np.array([n - 1], np.int32), 1)
    p, wide = 0, 1024
    while p < len(slots):
        part = slots[p : p + wide]
        empty = part < 0
        stop = int(empty.argmax())
        stop = p + (stop if empty[stop] else len(part))
        j = slots[p:stop] - 1
        j = j[j >= 0]
        j = j[~is_s[j]]
        if len(j):
            _place(slots, edge, t, j, 1)
        wide = max(1024, 2 * (stop - p)) if stop - p < 1 << 20 else 1 << 20
        p = stop
    sorted_l = slots[is_l_slot]
    size = np.bincount(t, minlength=k)
    ends = np.cumsum(size)
    slots = np.full(n, -1, np.int32)
    slots[np.arange(len(sorted_l)) + np.repeat((ends - size) - (np.cumsum(size_l) - size_l), size_l)] = sorted_l
    edge, p, wide = ends.copy(), n, 1024
    while p > 0:
        low = max(0, p - wide)
        empty = slots[low:p][::-1] < 0
        stop = int(empty.argmax())
        stop = p - (stop if empty[stop] else len(empty))
        j = slots[stop:p][::-1] - 1
        j = j[j >= 0]
        j = j[is_s[j]]
        if len(j):
            _place(slots, edge, t, j, -1)
        wide = max(1024, 2 * (p - stop)) if p - stop < 1 << 20 else 1 << 20
        p = stop
    return slots


def _names(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """A name for each LMS substring, in text order, and how many names there are."""
    n, m = len(t), len(lms)
    size_at = np.zeros(n, np.int32)
    size_at[lms[:-1]] = np.diff(lms) + 1
    a, b = ordered[:-1].astype(np.int64), ordered[1:].astype(np.int64)
    size = size_at[a]
    same = (size == size_at[b]) & (size > 0)
    here = np.flatnonzero(same)
    a, b, size, k = a[here], b[here], size[here], 0
    step = 1
    if t.dtype == np.uint8:
        step, at = 8, eights(np.concatenate([t, np.zeros(8, np.uint8)]))
    while len(here):
        if step == 8:
            left = np.minimum(size - k, 8)
            differ = ((at[a + k] ^ at[b + k]) << ((8 - left) * 8).astype(np.uint64)) != 0
        else:
            differ = t[a + k] != t[b + k]
        same[here[differ]] = False
        k += step
        more = ~differ & (size > k)
        here, a, b, size = here[more], a[more], b[more], size[more]
    name = np.zeros(m, np.int32)
    name[1:] = np.cumsum(~same)
    of = np.zeros(n, np.int32)
    of[ordered] = name
    return of[lms], int(name[-1]) + 1


def suffix_array(t: np.ndarray, k: int = 256) -> np.ndarray:
    """Suffixes of t in order, as int32 positions; t holds numbers below k and is shorter than 2^31."""
    n = len(t)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    is_s = _types(t)
    lms = (np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1).astype(np.int32)
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        found = _induce(t, is_s, lms, k)
        ordered = found[is_lms[found]]
        names, count = _names(t, lms, ordered)
        lms = ordered if count == len(lms) else lms[suffix_array(names, count)]
    return _induce(t, is_s, lms, k)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, most: int | None = None) -> np.ndarray:
    """For each text position, the common prefix of its suffix with the one before it in order, up to most.

    Where the characters before both suffixes agree, the value is one less than
    that of the position before (or more than `most`, cut to it); so only the
    other positions are compared, eight bytes at a time, and the rest follow.
    """
    n = len(t)
    if n == 0:
        return np.zeros(0, np.int64)
    most = n if most is None else most
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    at = eights(np.concatenate([t, np.zeros(8, np.uint8)]))
    before = np.full(n, -1, np.int64)
    follows = np.zeros(n, bool)
    i = np.arange(1, n)
    ok = (phi[1:] > 0) & (phi[:-1] >= 0)
    follows[1:][ok] = t[i[ok] - 1] == t[phi[1:][ok] - 1]
    # Values are compared without the bound first only at positions that do not follow from their predecessor.
    a = np.flatnonzero(~follows & (phi >= 0))
    b, value = phi[a], np.zeros(len(a), np.int64)
    here, k = np.arange(len(a)), 0
    while len(here) and k < n:
        x, y = a[here] + k, b[here] + k
        room = np.minimum(n - np.maximum(x, y), 8)
        diff = at[np.minimum(x, n)] ^ at[np.minimum(y, n)]
        low = diff & (~diff + np.uint64(1))
        first = np.where(diff == 0, 8, (np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64)) // 8)
        got = np.minimum(first, np.maximum(room, 0))
        value[here] += got
        here = here[got == 8]
        k += 8
    before[a] = value
    before[phi < 0] = 0
    # Fill: a position that follows has its source's value less the distance.
    source = np.maximum.accumulate(np.where(follows, 0, np.arange(n)))
    out = np.maximum(before[source] - (np.arange(n) - source), 0)
    return np.minimum(out, most)
