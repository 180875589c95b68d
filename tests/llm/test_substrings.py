import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import pairs
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import substring, suffix_dedup
from quern.llm.suffix import permuted_lcp, suffix_array


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80).map(lambda b: bytes(x % 3 for x in b)), st.integers(1, 3))
def test_suffix_array(b, times):
    b = b * times
    t = np.frombuffer(b, np.uint8)
    sa = suffix_array(t)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    lcp = permuted_lcp(t, sa)
    for a, c in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
        n = 0
        while max(a, c) + n < len(b) and b[a + n] == b[c + n]:
            n += 1
        assert lcp[c] == n


def covered(rows, width, cut):
    """Of each row: its items, and which are covered by a window that starts in a row with a smaller id."""
    least = {}
    for i, t in rows:
        w = cut(t)
        for k in range(len(w) - width + 1 if i is not None else 0):
            q = tuple(w[k : k + width])
            least[q] = min(i, least.get(q, i))
    for i, t in rows:
        w = cut(t)
        gone = [False] * len(w)
        for k in range(len(w) - width + 1 if i is not None else 0):
            if least[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        yield i, w, gone


def check_bytes(df, wide=suffix_dedup.WIDE, **more):
    want = Counter()
    for i, w, gone in covered(pairs(df), 50, lambda t: (t or "").encode()):
        left = bytes(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(left).hexdigest()] += 1
    got = suffix_dedup.dedup(df, wide=wide, **more).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
    assert all(hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("wide", [1, 1024])
def test_bytes_equal_brute_force(docs, wide):
    check_bytes(docs, wide)


@pytest.mark.parametrize("wide", [1, 1024])
def test_overlapping_passages_equal_brute_force(spark, wide):
    rng = np.random.default_rng(3)
    words = ["alpha", "be", "gamma", "delta,", "épsilon", "z"]
    pool = [" ".join(rng.choice(words, int(n))) for n in rng.integers(3, 60, 12)]
    rows = [(int(rng.integers(0, 60)) if k % 9 else None, " ".join(pool[j] for j in rng.integers(0, 12, 4))) for k in range(80)]
    check_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), wide)


def test_equal_hashes_of_other_bytes_are_told_apart(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "spans_hash", lambda data, a, b, seed=0: np.zeros(len(a), np.uint64))
    text = b"abcdefghij" * 2 + b"abcdefghiX" + b"abc" + b"abc"
    data = np.frombuffer(text + bytes(8), np.uint8)
    begin, end = np.array([0, 10, 20, 30, 33]), np.array([10, 20, 30, 33, 36])
    assert suffix_dedup._least_of_equals(data, begin, end, np.array([1, 2, 3, 4, 5])).tolist() == [True, False, True, True, True]
    assert suffix_dedup._least_of_equals(data, begin, end, np.array([3, 2, 3, 2, 1])).tolist() == [True, True, True, False, True]


def test_bundles_deliver_the_same(docs):
    """Many receivers for the fan: messages go in bundles, both ways."""
    check_bytes(docs, fan=4)
    plain, bundled = (Counter(map(str, substring.dedup(docs, fan=fan).collect())) for fan in (4096, 5))
    assert plain == bundled and substring.dedup(docs.limit(0), fan=3).count() == 0


def test_words_equal_brute_force(docs):
    want = Counter()
    for i, w, gone in covered(pairs(docs), 13, lambda t: (t or "").encode().split()):
        want[i, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    got = substring.dedup(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want


def test_covers_are_difference_covers():
    for v, cover in substring.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_empty(none):
    assert suffix_dedup.dedup(none).count() == 0 and substring.dedup(none).count() == 0
