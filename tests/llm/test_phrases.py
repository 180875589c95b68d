"""Personal data, collocations and the trie of conversations against brute force."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import collocations, personal, prefix_trie


def luhn(d):
    return sum((n - 9 if n > 9 else n) for n in (int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(d)))) % 10 == 0


def base_spans(t):
    digits = lambda x: re.sub("[^0-9]", "", x)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(y) <= 255 for y in x.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    ]
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in kinds for m in re.finditer(p, t or "") if ok(m[0])]


PERSONAL = [
    None, "", "nothing here", "a@b.c_x@d.e é漢🎉 x@y.zz, +1 (017) 555-7713 and +46-70.123 45 67.", "1.2.3.4.5.6.7.8 300.1.1.1 1.1.1 0001.002.3.4", "4111 1111 1111 1111-4 4111111111111111 5500-0000-0000-0004",
    "1" * 3000, "a" * 3000 + "@", "1." * 3000, "5500 0000 0000 0004 " * 300, "x@y.zz 4111111111111111, 10.0.0.1; " * 400, "+1" + " " * 3000, "+1 2 3 4 5 6 7 +12345678901234567 +1.2", "a@b a@b. a@.c @b.c a@-.-",
]


def test_personal_data(spark):
    random.seed(5)
    noise = ["".join(random.choices("1234567890 .-+@ab()\né", k=300)) for _ in range(60)]
    texts = [*PERSONAL, *noise, PERSONAL[3]]
    df = spark.createDataFrame([(k if k != 2 else None, t, 1, "z") for k, t in enumerate(texts)], "doc_id long, text string, spans int, _text string").repartition(3)
    got = {r["doc_id"]: r for r in personal.digests(personal.find(df)).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        want, r = base_spans(t), got[k if k != 2 else None]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [r[f"n_{n}"] for n in ("email", "ip", "card", "phone")] == [sum(w.startswith(n) for w in want) for n in ("email", "ip", "card", "phone")]
        assert set(want) <= set(r["spans"].split(",")) | {""}
    assert personal.digests(personal.find(df.limit(0))).count() == 0


def test_more_kinds_need_checksum_or_words(spark):
    texts = {
        "pay to DE89 3704 0044 0532 0130 00 AND MORE": [("iban", "DE89 3704 0044 0532 0130 00")], "pay to DE88 3704 0044 0532 0130 00": [], "XDE89370400440532013000": [], "GB82WEST12345698765432": [("iban", "GB82WEST12345698765432")],
        "serial GB82WEST12345698765432": [], "ssn 123-45-6789": [("ssn", "123-45-6789")], "part 123-45-6789": [], "ssn 000-45-6789, 123-00-6789, 123-45-0000": [], "amex card 378282246310005": [("card_short", "378282246310005")],
        "378282246310005": [], "amex card 378282246310006": [], "order of a card 378282246310005": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {}
    for r in personal.spans(personal.find(df, "text"), "text").collect():
        got.setdefault(r["text"], []).append((r["kind"], r["value"]))
        assert r["text"][r["start"] : r["end"]] == r["value"] and personal.LEAST <= r["score"] <= 100
    assert {t: got.get(t, []) for t in texts} == texts


def collocations_of(rows, most, least, share, top):
    f, n, out = Counter(), Counter(), {}
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, most + 1) for i in range(len(w) - k + 1))
    found = {k: v for k, v in f.items() if v >= least and len(k[1]) > 1}
    dead = {(lang, w[i : i + k]) for (lang, w), a in found.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if 100 * a >= share * found[lang, w[i : i + k]]}
    for (lang, w), a in found.items():
        if (lang, w) not in dead:
            score, k = min((10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, rank, w.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for rank, (s, a, w, x, y) in enumerate(sorted(v)[:top], 1))


@pytest.mark.parametrize(("most", "least", "top", "chunk"), [(3, 10, 2000, None), (5, 3, 7, 2000)])
def test_collocations(spark, docs, monkeypatch, most, least, top, chunk):
    random.seed(1)
    rows = [(random.choice(["en", "de", None, "und"]), " ".join(random.choices(["A", "b", "c\tD", "Éa", "Éa", "e,", "f.", "g\n", "h"], [9, 8, 7, 3, 3, 2, 2, 1, 4], k=random.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, None), ("de", "w " * 3000 + "x" * 2000), *[("fr", "new york city")] * 30, ("fr", "new york " * 20)]
    df = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "lang string, text string, n int, at int").repartition(4)
    if chunk:
        monkeypatch.setattr(collocations, "chunked", lambda batches, f=collocations.chunked: f(batches, chunk))
    got = collocations.mine(df, max_words=most, least=least, top=top).collect()
    assert sorted(map(tuple, got)) == collocations_of(rows, most, least, 50, top)
    assert collocations.mine(df.limit(0)).count() == 0


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    """A hash of four values, and a second one that notices."""
    plain = collocations.spans_hash
    monkeypatch.setattr(collocations, "spans_hash", lambda d, s, e, seed=0: plain(d, s, e, seed) & collocations.U64(3) if seed == 0 else plain(d, s, e, seed))
    data, off = collocations.utf8(__import__("pyarrow").array(["a b c d e f a b", "a g"]))
    starts, ends, of, _ = collocations.tokens(data, off)
    first, number, count = collocations._distinct(data, starts, ends, of)
    assert len(first) == 8 and sorted(count.tolist()) == [1] * 6 + [2] * 2 and number[0] == number[6] != number[8]


def test_parts_of_a_chunk_are_one_list(monkeypatch):
    """Texts cut to parts of a few bytes, and lists that end after a few words: the same pieces, and each word of a language once in a list."""
    random.seed(7)
    rows = [(random.choice(["en", "de"]), " ".join(random.choices(["A", "b", "c\tD", "Éa", "e,", "f.", ".", "g\n", "long" * 9], k=random.randint(0, 40)))) for _ in range(60)] + [("de", ""), ("en", "x " * 300), ("en", None)]
    t = pa.table({"lang": [a for a, _ in rows], "text": pa.array([b for _, b in rows], pa.string())})
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    want = [(lang, w) for lang, text in rows for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)) if (w := re.findall("[^\x20\x09]+", piece))]
    for part, words, listed in ((2 << 20, 4 << 20, 1 << 20), (11, 4 << 20, 1 << 20), (11, 50, 1 << 20), (300, 4 << 20, 25)):
        for name, most in (("PART_BYTES", part), ("WORDS", words), ("LISTED", listed)):
            monkeypatch.setattr(collocations, name, most)
        got, lists = [], 0
        for word, lang, count, sequence in collocations._lists(t):
            listing, lists = list(zip(lang.to_pylist(), word.to_pylist(), strict=True)), lists + 1
            assert len(set(listing)) == len(listing) and count.tolist() == np.bincount(sequence[sequence >= 0]).tolist() and sequence[-1] == -1
            for piece in np.split(sequence, np.flatnonzero(sequence < 0)):
                held = [listing[k] for k in piece[piece >= 0]]
                got += [(held[0][0], [w for _, w in held])] if held else []
        assert got == want and (lists > 1) == (words == 50 or listed == 25)


@pytest.mark.parametrize("letters", [1, 5])
def test_memory_of_a_chunk(monkeypatch, letters):
    """16 MB of short words, and of words that are nearly all different, in one text: tasks held 30 and 54 times that."""
    monkeypatch.setattr(collocations, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    text = np.random.default_rng(1).integers(97, 123, (16 << 20) // (letters + 1) * (letters + 1), np.uint8)
    text[letters :: letters + 1] = 32
    text[letters :: 20 * (letters + 1)] = 10
    batch, most, chunks = pa.record_batch({"lang": ["en"], "text": [text.tobytes().decode()]}), 0, []
    tracemalloc.start()
    try:
        for b in collocations._read(iter([batch])):
            chunks.append(b)
        most = tracemalloc.get_traced_memory()[1]
        for words, last in zip(chunks[::2], chunks[1::2], strict=True):
            n = words.num_rows
            at = last["at"].to_numpy() >> collocations.PLACE
            names = pa.table({"chunk": np.repeat(at, n), "level": np.ones(n, int), "place": np.arange(n), "id": np.arange(n)})
            tracemalloc.reset_peak()
            collocations._level(pa.table({"chunk": at, "seq": last["seq"]}), names)
            most = max(most, tracemalloc.get_traced_memory()[1])
    finally:
        tracemalloc.stop()
    assert most < 24 * len(text)


def placed(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v, key=lambda y: (y[0], y[1], y[2].encode(), y[3].encode()))] for c, v in by.items()}


def rebuilt(by):
    return {c: by.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + v[h:] for c, v in by.items() for h in [zlib.crc32(str(c).encode()) % 4]}


def trie_of(by):
    members, children, leaves, saved = {}, {}, {}, {}
    for c, v in by.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    for k in members:
        if k:
            children.setdefault(k[:-1], []).append(k)
    for k in sorted(members, key=len, reverse=True):
        below = children.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = (len(members[k]) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0) + sum(saved[x] for x in below)
    ends = lambda k: ",".join(map(str, sorted(c for c in members[k] if len(by[c]) == len(k)))).encode()
    return Counter((min(v), len(k), min(members[k[:-1]]) if k else None, len(v), len(children.get(k, [])), leaves[k], saved[k], hashlib.sha256(ends(k)).hexdigest()) for k, v in members.items())


@pytest.mark.parametrize(("bits", "spread"), [(3, False), (64, True)])
def test_trie(spark, bits, spread, monkeypatch):
    """Nulls, ties, repeated turns, a long conversation, many copies; fingerprints that collide; conversations that run across many partitions."""
    random.seed(3)
    rows = [(random.choice([None, *range(-40, 60)]), random.choice([None, 0, 1, 2, 3, 4, 5]), random.choice(["u", "a", None]), random.choice(["x y", "z", None, "", "q"])) for _ in range(500)]
    rows += [(7, k, "u", str(k % 3)) for k in range(300)] + [(c, k, "s", f"hi {k}") for c in range(100, 190) for k in range(4)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id long, turn long, role string, text string, depth int, print string").repartition(5)
    conv = F.col("conv_id")
    if spread:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    try:
        turns, ids = prefix_trie.grafted(df, conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
        got = Counter(tuple(r[:8]) for r in prefix_trie.trie(turns, ids, bits).collect())
        assert got == trie_of(rebuilt(placed(rows)))
        assert Counter(tuple(r[:8]) for r in prefix_trie.trie(df, bits=bits).collect()) == trie_of(placed(rows))
        assert prefix_trie.trie(df.limit(0)).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
