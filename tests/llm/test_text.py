import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from conftest_llm import pairs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import bpe, gbt, html_text, packing, quality, sharding, sstable, tokens
from quern.llm.html_pages import pages
from quern.llm.tokens import Encoder

MULTI, BYTE = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
TEXT = st.text("ab 'stre12\n\t.,!é一¼\x1c 　", max_size=60)


@pytest.fixture(scope="module")
def library():
    return Encoder(BYTE)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_tree_is_the_library(text):
    tree = bpe.tree(MULTI, P.PATTERN, 5)
    tree.window = 1
    ids = tree.encode(text)
    assert ids.tolist() == tree.enc.encode_ordinary(text) and tree.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_pieces_are_the_library(library, text):
    flat, off = library.encode(pa.array([text, None, "x " + text, text]))
    for k, t in enumerate([text, "", "x " + text, text]):
        assert flat[off[k] : off[k + 1]].tolist() == library.library.encode(t, add_special_tokens=False).ids


def test_table_tells_equal_hashes_apart(library, monkeypatch):
    monkeypatch.setattr(tokens, "spans_hash", lambda data, a, b, seed=0: np.full(len(a), 9, np.uint64))
    own = Encoder(BYTE)
    flat, off = own.encode(pa.array(["one two", "one two three", "three"]), 0)
    assert [flat[off[k] : off[k + 1]].tolist() for k in range(3)] == [[*library.library.encode(t, add_special_tokens=False).ids, 0] for t in ("one two", "one two three", "three")]


def test_special_strings_are_the_library_s(library):
    texts = ["foo  <|endoftext|> bar", "a<|endoftext|>b c", "<|endoftext", "|> x"]
    flat, off = library.encode(pa.array(texts))
    assert [flat[off[k] : off[k + 1]].tolist() for k in range(4)] == [library.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_ordinary_documents_pass_the_tree():
    tree = bpe.Tree(bpe.encoding(MULTI, P.PATTERN))
    text = "the quick brown fox jumps, over 12 lazy dogs. " * 40
    assert tree.encode(text).tolist() == tree.enc.encode_ordinary(text) and tree.joins == 7


def test_bpe_rows(docs, none):
    enc = bpe.encoding(MULTI, P.PATTERN)
    want = Counter()
    for i, t in pairs(docs):
        ids = np.array(enc.encode_ordinary(t or ""), "<u4")
        want[i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = bpe.digests(docs, MULTI, P.PATTERN)
    assert Counter(tuple(r) for r in got.collect()) == want and bpe.digests(none, MULTI, P.PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, MULTI, P.PATTERN), MULTI, P.PATTERN)
    assert Counter((r["doc_id"], bytes(r["bytes"])) for r in back.collect()) == Counter((i, (t or "").encode()) for i, t in pairs(docs))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 60), st.integers(1, 700)), max_size=60))
def test_packing_holds_every_id_once(lengths):
    n = np.array(lengths, np.int64)
    rows = packing.pack_lengths(n, 128).tolist()
    docs, seqs = defaultdict(list), defaultdict(list)
    for k, start, length, seq, offset in rows:
        docs[k].append((start, length))
        seqs[seq].append((offset, length))
    for parts, total in [(docs[k], lengths[k]) for k in range(len(n))] + [(v, None) for v in seqs.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == total if total is not None else at == 128 or at & (at - 1) == 0 or 128 - at <= 1


def test_best_fill_is_best():
    rng = np.random.default_rng(0)
    for _ in range(100):
        counts = {int(k): int(v) for k, v in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5), strict=True)}
        room, sums = int(rng.integers(0, 90)), {0}
        for k, v in counts.items():
            sums = {s + k * j for s in sums for j in range(v + 1)}
        used = packing.best_fill(counts, room)
        assert all(v <= counts[k] for k, v in used.items()) and sum(k * v for k, v in used.items()) == max(s for s in sums if s <= room)


def test_pack_rows(docs, none, library):
    parts = defaultdict(list)
    for r in packing.pack(docs, BYTE).collect():
        parts[r["doc_id"]].append(r)
    for i, texts in _by_id(docs).items():
        encoded = [[*library.library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        # Every id of every row with this doc_id, once; pieces of rows of their own length can be put together.
        assert Counter(x for r in parts[i] for x in r["ids"]) == Counter(x for e in encoded for x in e)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in parts[i])
        for e in encoded:
            own = sorted((r for r in parts[i] if r["doc_tokens"] == len(e)), key=lambda r: r["start"])
            if sum(len(x) == len(e) for x in encoded) == 1:
                assert [x for r in own for x in r["ids"]] == e
    assert packing.pack(none, BYTE).count() == 0


def _by_id(docs):
    out = defaultdict(list)
    for i, t in pairs(docs):
        out[i].append(t)
    return out


def test_sstable_round_trip(docs, none, library, tmp_path):
    shards = sstable.write(docs, BYTE, shard_bytes=8000)
    rows = sstable.read(shards).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at and r["ids"][-1] == 0
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    want = Counter((i, tuple([*library.library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in pairs(docs))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows) == want
    readers = [sstable.open_shard(r["path"]) for r in shards.collect()]
    assert len(readers) > 1 and sum(len(r.get(9)) for r in readers) == 1 and not any(r.get(12345) for r in readers) and sum(len(r.get(None)) for r in readers) == 2
    assert sstable.read(sstable.write(none, BYTE)).count() == 0


def test_sharding(docs, none):
    got = sharding.shard(docs, [1.0] * 7).collect()
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs(docs))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7) and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sharding.shard(none, [1.0]).count() == 0


def test_the_winning_shard_by_another_way(spark):
    """Every draw anew, with another library's hash."""
    weights, own = [1.0, 2.0, 0.5, 1.0], {}
    for k in range(500):
        draws = []
        for i, w in enumerate(weights):
            draws.append((-math.log((int(hashlib.md5(f"{k}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)) / w, i))
        own[k] = min(draws)[1]
    df = spark.range(500).selectExpr("id as doc_id", "'t' as text")
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(df, weights).collect()} == own
    few = sharding.shard(df, weights, sub_buckets=3).groupBy("shard").agg(F.count_distinct("slot").alias("n"), F.max("slot").alias("m")).collect()
    assert all(r["n"] == r["m"] + 1 for r in few)


def test_weights_and_growth(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "'t' as text")
    a = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard(df, [1.0, 3.0, 0.0]).collect()}
    share = sum(s == 1 for s, _ in a.values()) / len(a)
    assert 0.73 < share < 0.77 and not any(s == 2 for s, _ in a.values())
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(df, [1.0] * 5).collect()}
    c = {r["doc_id"]: r["shard"] for r in sharding.shard(df, [1.0] * 6).collect()}
    assert all(c[k] in (b[k], 5) for k in b) and 0.14 < sum(c[k] == 5 for k in c) / len(c) < 0.19


def test_quality_counts_and_verdict(spark, docs, none):
    labels = spark.createDataFrame([(0, 1), (3, None), (None, 0)], "doc_id long, quality int")
    got = Counter(tuple(r)[:6] for r in quality.judge(docs, labels).collect())
    want = Counter()
    for i, t in pairs(docs):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        seen, again = set(), 0
        for line in (t or "").split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                again += line in seen
                seen.add(line)
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count, hit = Counter(windows), [0] * len(w)
        for k, q in enumerate(windows):
            if count[q] > 1:
                hit[k : k + 8] = [1] * 8
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), again, sum(hit)] += 1
    assert got == want
    assert quality.judge(none, labels).count() == 0 and quality.judge(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_more_labels_than_the_sample(spark):
    """A bound on labels, repeated ids and repeated labels: as many rows are fitted as the bound says, the same each time."""
    docs = spark.createDataFrame([(k % 40, f"some text number {k} " * 30) for k in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 40, k % 2) for k in range(80)], "doc_id long, quality int")
    assert quality.judge(docs, labels, sample=10).count() == 200
    a, b = (quality.train(docs.repartition(n), labels.repartition(n), sample=10) for n in (2, 5))
    x = np.random.default_rng(0).normal(size=(50, len(quality.FEATURES)))
    assert (a.probability(x) == b.probability(x)).all()


def test_quality_on_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    got = quality.score(docs, model).drop("quality").join(labels.where("doc_id % 3 = 0"), "doc_id").where("not base_failed").collect()
    assert len(got) > 60 and sum(r["kept"] == (r["quality"] == 1) for r in got) >= 0.95 * len(got)


def test_trees_learn_and_keep_to_bounds():
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(2000, 3))
    y = (x[:, 0] + 0.3 * np.sin(12 * x[:, 1]) + 0.2 * rng.normal(size=2000)) > 0.5
    model = gbt.fit(x, y, [1, 0, 0])
    t = rng.uniform(size=(1000, 3))
    assert ((model.score(t) > 0) == (t[:, 0] + 0.3 * np.sin(12 * t[:, 1]) > 0.5)).mean() > 0.9
    line = np.repeat(t[:50], 40, 0)
    line[:, 0] = np.tile(np.linspace(0, 1, 40), 50)
    assert (np.diff(model.score(line).reshape(50, 40), axis=1) >= -1e-9).all()
    assert gbt.fit(x[:0], y[:0]).probability(t).min() > 0.99


def test_main_text_of_held_out_pages():
    trees, same = html_text.model(), 0
    for page in pages(150, seed=77):
        nodes, gone, want = html_text.parse(page), [], []
        for k, n in enumerate(nodes):
            gone.append(n.drop or (k > 0 and gone[n.up]))
            want += [] if gone[k] else n.blocks
        same += html_text.decode(nodes, trees.score(html_text.features(nodes))) == [t for _, t in sorted(want)]
    assert same >= 140


def test_pages_of_all_kinds(spark):
    page = "<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class=ad>Buy now.</div><article><h1>Title &amp; more</h1><p><b>First   para&eacute;<br>goes on here with many words, and more.<p>Second one, which is\n long enough &#8212; surely.</article><footer>&copy; Somebody</footer></body></html>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p"), (5, "u", "a < b & c"), (None, "u", page), (7, "u", page[: page.index("<footer>")]), (8, "u", "<div " * 500 + "x" + "<b>" * 2000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    want = "Title & more\n\nFirst paraé goes on here with many words, and more.\n\nSecond one, which is long enough — surely."
    assert got[1]["text"] == got[None]["text"] == got[7]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[3]["text"] == "" and got[5]["text"] == "a < b & c" and len(got) == len(rows)
    assert html_text.extract(df.limit(0)).count() == 0


def test_a_very_long_page_is_whole():
    body = [f"Paragraph number {k} says, in a few words, what it has to say." for k in range(20000)]
    page = "<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/x>About</a></li></ul></nav><article><h1>Title here</h1>" + "".join(f"<p>{b}</p>" for b in body) + "</article><footer><p>&copy; Someone</p></footer></body></html>"
    assert html_text.texts_of([page], html_text.model()) == ["\n\n".join(["Title here", *body])]


def test_a_rule_parts_blocks():
    assert [t for n in html_text.parse("<div>one<hr>two<br>three</div>") for _, t in n.blocks] == ["one", "two three"]


def test_missing_end_tags_drop_no_text():
    from quern.llm.html_text import parse

    read = lambda page: " ".join(t for _, t in sorted(b for x in parse(page) for b in x.blocks))
    for tag in ("<button>", "<select>", "<video src=a>", "<svg viewBox='0 0 1 1'/>", "<object>", "<noscript>"):
        assert read(f"<body><article><p>one</p>{tag}<p>two</p><p>three</p></article>") == "one two three"
    assert read("<article><button><p>one</p><button>x</button><p>two</p></article>") == "one two"
    assert read("<html><head><title>t</title><script>a<b</script><article><p>one</p></article>") == "one"
    assert read("<head><title>t</title><meta a=b></head><p>one</p><button>x</button><svg><text>x</text></svg><p>two</p>") == "one two"
    assert read("<p>one</p><script>x = 1") == "one"
