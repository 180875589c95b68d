from collections import Counter

import numpy as np
import pytest
from conftest_llm import pairs

from quern.llm import common, ngram_join, vector_graph


def grams(t):
    w = (t or "").encode().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())


def components(ids, linked):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def check_join(df):
    rows = pairs(df)
    known = [(i, grams(t)) for i, t in rows if i is not None]
    links, edges = Counter(), []
    for x, (i, a) in enumerate(known):
        for y, (j, b) in enumerate(known):
            if x != y and a and len(a & b) / len(a | b) >= 0.8:
                links[x] += 1
                edges.append((i, j))
    comp = components([i for i, _ in known], edges)
    want = Counter((i, comp[i] if a else i, links[x], comp[i] == i if a else True) for x, (i, a) in enumerate(known))
    want.update((None, None, 0, True) for i, _ in rows if i is None)
    assert Counter((r["doc_id"], r["class_id"], r["n_links"], r["kept"]) for r in ngram_join.join(df).collect()) == want


def test_join_equals_brute_force(docs):
    check_join(docs)


def test_join_in_blocks(spark, monkeypatch):
    """A group of near copies that is cut into many blocks loses no link."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "GROUP_BLOCK", 8)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(0, 60, 2)]
    check_join(spark.createDataFrame(rows, "doc_id long, text string"))


def test_depth_shortens_until_recall():
    assert ngram_join.prefix_depth(trees=24) == 5 and ngram_join.prefix_depth(trees=200) == 8 and ngram_join.prefix_depth(trees=1) == 1


def test_join_of_nothing(none):
    assert ngram_join.join(none).count() == 0


def _brute(x, label):
    x = vector_graph.unit(x)
    close = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(close, False)
    return close


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(400):
        x = rng.normal(size=16)
        rows.append((len(rows), x, k % 3))
        for _ in range(rng.integers(0, 4) if k % 5 == 0 else 0):
            rows.append((len(rows), x + 0.03 * rng.normal(size=16), k % 3))
    odd = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [], 1), (9005, [1.0, None], 1), (9006, rows[0][1].tolist(), None), (None, rows[0][1].tolist(), 0), (9007, [1.0, 2.0], 0), (3, rows[3][1].tolist(), rows[3][2])]
    df = spark.createDataFrame([(i, None if v is None else [None if y is None else float(y) for y in v], c, "x") for i, v, c in [*rows, *odd]], "vec_id long, embedding array<double>, label int, id string")
    close = _brute(np.stack([r[1] for r in rows]), np.array([r[2] for r in rows]))
    comp = components(range(len(rows)), np.argwhere(close).tolist())
    got = {r["vec_id"]: r for r in vector_graph.link(df).collect()}
    assert vector_graph.link(df).count() == len(rows) + len(odd)
    found = sum(got[k]["n_links"] for k in range(len(rows)))
    assert close.sum() > 100 and found >= 0.9 * close.sum() and all(got[k]["n_links"] <= close[k].sum() for k in range(len(rows)))
    if found == close.sum():
        assert all(got[k]["component_id"] == comp[k] for k in range(len(rows)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (9001, 9002, 9003, 9004, 9005, 9006, 9007))
    assert vector_graph.link(df.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 64])
def test_many_regions_and_blocks(spark, block):
    """A label of many regions with a hot group: overlap, blocks and counting in the first common region."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(500, 12))
    x = np.concatenate([centres, centres[:150] + 0.02 * rng.normal(size=(150, 12)), centres[7] + 0.02 * rng.normal(size=(350, 12))])
    label = np.r_[np.zeros(900, int), np.ones(100, int)]
    close = _brute(x, label)
    df = spark.createDataFrame([(k, [float(y) for y in v], int(c)) for k, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in vector_graph.link(df, region=64, block=block, cluster=32).collect()}
    links = np.array([got[k]["n_links"] for k in range(len(x))])
    assert (links <= close.sum(1)).all() and links.sum() >= 0.97 * close.sum() and got[0]["audited_recall"] >= 0.9
    if links.sum() == close.sum():
        comp = components(range(len(x)), np.argwhere(close).tolist())
        assert all(got[k]["component_id"] == comp[k] for k in got)


def test_the_threshold_is_exact():
    for factor in (1.0, 3.7, 1e-3):
        a = np.array([[factor, 0.0]] * 3)
        b = np.array([[0.98, 0.98**-1 * 0.0 + np.sqrt(1 - 0.98**2)], [np.nextafter(0.98, 0) - 1e-13, np.sqrt(1 - 0.98**2)], [0.99, 0.01]])
        want = [np.dot(p, q) / (np.sqrt(np.dot(p, p)) * np.sqrt(np.dot(q, q))) >= 0.98 for p, q in zip(a, b, strict=True)]
        s = (vector_graph.unit(a) * vector_graph.unit(b)).sum(1)
        assert vector_graph.in_reach(s, a, b, 0.98).tolist() == want and not want[1] and want[2]


def test_together_finds_what_each_finds():
    """The search of a shard's queries finds all pairs of clustered vectors."""
    rng = np.random.default_rng(5)
    x = vector_graph.unit(np.repeat(rng.normal(size=(400, 24)), 4, axis=0) + 0.03 * rng.normal(size=(1600, 24)))
    pairs, s = vector_graph.in_range(x, vector_graph.Graph(x))
    want, _ = vector_graph.all_pairs(x)
    assert len(want) > 1000 and len(pairs) >= 0.99 * len(want) and set(map(tuple, pairs.tolist())) <= set(map(tuple, want.tolist()))
    assert np.allclose(s, (x[pairs[:, 0]] * x[pairs[:, 1]]).sum(1))


def test_graph_is_not_cut():
    """The sizes that were cut along with the search's CPU time."""
    assert vector_graph.CLUSTER >= 192 and vector_graph.DEGREE >= 24 and vector_graph.BEAM >= 16


def test_audit_counts_queries_alike():
    """A hot query does not outweigh small ones; a query without links does not count."""
    assert vector_graph.average_recall({1: 1000, 2: 1, 3: 1, 4: 0}, {1: 1000}) == 1 / 3 and vector_graph.average_recall({4: 0}, {}) == 1


def test_audit_ends_in_an_exact_search(spark, monkeypatch):
    """Labels of one shard, and a graph search that finds nothing: the audit must act."""
    monkeypatch.setattr(vector_graph, "in_range", lambda x, graph, threshold, beam: (np.zeros((0, 2), np.int64), np.zeros(0)))
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(60, 12)), 3, axis=0) + 0.01 * rng.normal(size=(180, 12))
    df = spark.createDataFrame([(k, v.tolist(), k // 90) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    assert all(r["n_links"] == 2 and r["component_id"] == r["vec_id"] // 3 * 3 for r in vector_graph.link(df).collect())


def test_join_at_low_thresholds(spark):
    """Separate pairs just above the threshold survive the comparison of signatures."""
    for threshold, own in ((0.6, 31), (0.5, 47)):
        rows = []
        for k in range(60):
            # 5-grams of 100 shared words and `own` words apart on either side: 96 of 96 + 2 own.
            shared = [f"p{k}w{n}" for n in range(100)]
            rows += [(2 * k + side, " ".join(shared + [f"p{k}s{side}n{n}" for n in range(own)])) for side in (0, 1)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        sizes = [grams(t) for _, t in rows[:2]]
        assert threshold <= len(sizes[0] & sizes[1]) / len(sizes[0] | sizes[1]) < threshold + 0.02
        assert all(r["n_links"] == 1 for r in ngram_join.join(df, threshold=threshold).collect())


def test_one_id_with_two_texts(spark):
    """An id that is the least of two classes: each keeps its own links and group."""
    a, b = ([f"{c}{k}" for k in range(60)] for c in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a + ["x"])), (3, " ".join(b + ["y"])), (4, " ".join(b + ["z"]))]
    got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 1, 2)])


def test_walk_links_what_agrees():
    """Below one node, the forest has the components of all agreeing pairs."""
    rng = np.random.default_rng(6)
    for _ in range(60):
        n = int(rng.integers(2, 40))
        paths = rng.integers(0, 3, (n, 6))
        paths[:, :2] = 1
        paths = paths[np.lexsort(paths.T[::-1])]
        sig = rng.integers(0, 2, (n, 10))
        want = components(range(n), np.argwhere((sig[:, None, :] == sig[None]).mean(2) >= 0.7).tolist())
        found = ngram_join.walk(paths[:, 2:], sig, 2, 0.7)
        assert components(range(n), found) == want and len(found) == n - len(set(want.values()))


def test_prefixes_are_shortened_until_the_audit_is_met(spark):
    """Four trees, and a prediction that asks for little: only the audit makes prefixes short enough."""
    rows = []
    for k in range(150):
        shared = [f"p{k}w{n}" for n in range(100)]
        rows += [(2 * k + side, " ".join(shared + [f"p{k}s{side}n{n}" for n in range(11)])) for side in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few = {"trees": 4, "recall": 0.75}
    assert ngram_join.prefix_depth(0.8, 4, 0.75) == 5
    loose, strict = (ngram_join.join(df, audited=a, **few).collect() for a in (0.0, 0.99))
    assert sum(r["n_links"] for r in loose) < 280 and loose[0]["audited_recall"] < 0.95
    assert sum(r["n_links"] for r in strict) >= 294 and strict[0]["audited_recall"] >= 0.99


def test_components_with_a_hub(spark):
    edges = [(0, k) for k in range(1, 300)] + [(k, k + 1) for k in range(1000, 1040)] + [(1040, 299), (5000, 5000)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {k: 0 for k in [*range(300), *range(1000, 1041)]}
