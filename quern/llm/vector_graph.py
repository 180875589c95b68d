"""Near-duplicate vectors by a robust-pruned flat graph on overlapping shards.

Vectors of one label link at a cosine of `threshold` or more.

1. A label is one region, or, where it has more vectors than a task should hold,
   a region for each leaf of a tree of centroids; a vector goes to the regions of
   its `overlap` nearest leaves, so neighbours rarely part. A region that is still
   too large is cut into blocks, and every pair of blocks is a unit.
2. In a unit, graphs are built on overlapping cluster shards: every vector keeps
   robustly pruned neighbours (a neighbour is dropped if a kept one is `alpha`
   times nearer to it). The shards' adjacency lists, and their reverse, are
   united to one flat graph.
3. Every vector is a query: a greedy search starts from the shards' medoids, and
   expands what is in its beam and all that is in range, until nothing is left.
   Queries of one shard search together. Cosines are in double precision; those
   next to the threshold are computed anew from the components as given, so what
   is found is verified. A pair that shares several regions counts in the first
   only.
4. Recall is audited against all rows by brute force, as the average over
   sampled queries that have links. Below the target, overlap, degree and beam
   are doubled and the search repeated; at last units are searched exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import connected_components, one_array, small_batches, written
from quern.llm.ngram_join import block_pairs

THRESHOLD, OVERLAP, RECALL = 0.98, 2, 0.9
#: Vectors of a region, of a block of a larger one, of the sample for centroids, and audited queries (bounds).
REGION, BLOCK, SAMPLE, AUDIT = 8192, 4096, 131_072, 256
#: Branches of the tree of centroids at its root, and sampled vectors for each leaf.
BRANCHES, PER_LEAF = 128, 16
#: Audited queries that should have links, and how many are drawn at most to find them (bounds).
LINKED, DRAWN = 64, 4096
#: Factor of degree and beam from which units are searched exactly, if every region of a label is already searched.
WIDEST = 4
#: Graph: vectors of a cluster shard, degree and slack of pruning; beam of the search.
CLUSTER, DEGREE, ALPHA, BEAM = 192, 24, 1.2, 16
#: Queries that search together.
TOGETHER = 512
#: Distance from the threshold within which a cosine is computed anew.
CLOSE = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def in_reach(s: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which cosines s of rows of a and b (as given, not of unit length) are the threshold or more."""
    out = s >= threshold
    for k in np.flatnonzero(np.abs(s - threshold) < CLOSE).tolist():
        out[k] = np.dot(a[k], b[k]) / (np.sqrt(np.dot(a[k], a[k])) * np.sqrt(np.dot(b[k], b[k]))) >= threshold
    return out


def robust_prune(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Edges (from, to) of each vector of x to its pruned neighbours, for all vectors at once."""
    n = len(x)
    d = np.maximum(2 - 2 * (x @ x.T), 0)
    left = d.copy()
    np.fill_diagonal(left, np.inf)
    rows, out = np.arange(n), []
    for _ in range(min(degree, n - 1)):
        near = left.argmin(1)
        live = np.isfinite(left[rows, near])
        if not live.any():
            break
        out.append(np.stack([rows[live], near[live]], 1))
        left[rows[live], near[live]] = np.inf
        left[(alpha * alpha * d[near] <= d) & live[:, None]] = np.inf
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


class Graph:
    """The united graph: neighbours of node k are to[starts[k] : starts[k + 1]]; the shards' medoids; each node's home shard."""

    def __init__(self, x: np.ndarray, seed: int = 1, degree: int = DEGREE, cluster: int = CLUSTER):
        n, rng = len(x), np.random.default_rng(seed)
        k = max(1, -(-n // cluster))
        centres = x[rng.choice(n, k, replace=False)]
        near = np.concatenate([np.argsort(-(x[lo : lo + 4096] @ centres.T), axis=1, kind="stable")[:, :2] for lo in range(0, n, 4096)])
        edges, medoids = [], []
        for c in range(k):
            for part in np.array_split(np.flatnonzero((near == c).any(1)), max(1, int((near == c).sum()) // (4 * cluster))):
                if len(part):
                    medoids.append(part[int((x[part] @ x[part].mean(0)).argmax())])
                    edges.append(part[robust_prune(x[part], degree)])
        e = np.concatenate(edges)
        key = np.unique(np.concatenate([e[:, 0] * n + e[:, 1], e[:, 1] * n + e[:, 0]]))
        self.starts, self.to = np.searchsorted(key // n, np.arange(n + 1)), key % n
        self.medoids, self.home = np.unique(medoids), near[:, 0]

    def neighbours(self, nodes: np.ndarray) -> np.ndarray:
        count = self.starts[nodes + 1] - self.starts[nodes]
        at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        return np.unique(self.to[np.repeat(self.starts[nodes], count) + at])


def in_range(x: np.ndarray, graph: Graph, threshold: float = THRESHOLD, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, and their cosines, that the searches of all vectors of x found at about the threshold or above.

    Queries with one home shard search together: what one of them visits all
    look at, as one matrix product, so each finds at least what it would alone.
    """
    n, found = len(x), []
    order = np.argsort(graph.home, kind="stable")
    shards = np.split(order, np.flatnonzero(np.diff(graph.home[order])) + 1)
    for q in (part for shard in shards for part in np.array_split(shard, -(-len(shard) // TOGETHER))):
        seen, best, nodes = np.zeros(n, bool), np.full((len(q), beam), -2.0), graph.medoids
        seen[nodes] = True
        while len(nodes):
            s = x[q] @ x[nodes].T
            i, j = np.nonzero(s >= threshold - CLOSE)
            found.append((q[i], nodes[j], s[i, j]))
            both = np.concatenate([best, s], 1)
            best = np.partition(both, both.shape[1] - beam, axis=1)[:, -beam:]
            # What is in some query's beam, or in its range, is expanded.
            go = (s >= np.minimum(best.min(1), threshold)[:, None]).any(0)
            nodes = graph.neighbours(nodes[go])
            nodes = nodes[~seen[nodes]]
            seen[nodes] = True
    i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
    other = i != j
    a, b = np.minimum(i, j)[other], np.maximum(i, j)[other]
    key, at = np.unique(a * n + b, return_index=True)
    return np.stack([key // n, key % n], 1), s[other][at]


def all_pairs(x: np.ndarray, threshold: float = THRESHOLD, step: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """As in_range, but by every product of two vectors."""
    out, cos = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
    for lo in range(0, len(x), step):
        s = x[lo : lo + step] @ x[lo:].T
        at = np.argwhere(np.triu(s >= threshold - CLOSE, 1))
        out.append(at + lo)
        cos.append(s[at[:, 0], at[:, 1]])
    return np.concatenate(out), np.concatenate(cos)


def means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centroids of unit vectors by spherical k-means."""
    c = x[np.random.default_rng(7).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[lo : lo + 8192] @ c.T).argmax(1) for lo in range(0, len(x), 8192)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1))
        c[size > 0] = total[size > 0] / size[size > 0, None]
    return c


class Leaves:
    """A tree of centroids of two levels: few at the root, and leaves below each."""

    def __init__(self, x: np.ndarray, count: int):
        self.root = means(x, max(1, min(BRANCHES, -(-count // 8), len(x) // PER_LEAF)))
        branch = (x @ self.root.T).argmax(1)
        leaves = []
        for b in range(len(self.root)):
            own = x[branch == b]
            k = min(-(-count * len(own) // len(x)), len(own) // PER_LEAF)
            leaves.append(means(own, k) if k > 1 else self.root[b : b + 1])
        self.first = np.r_[0, np.cumsum([len(c) for c in leaves])]
        self.leaves = np.concatenate(leaves)

    def nearest(self, x: np.ndarray, overlap: int) -> np.ndarray:
        """The numbers of the nearest leaves below the nearest branches, sorted; repeated where there are too few."""
        branches = np.argsort(-(x @ self.root.T), axis=1, kind="stable")[:, : overlap + 1]
        best = np.full((len(x), 0), 0)
        value = np.full((len(x), 0), 0.0)
        for k in range(branches.shape[1]):
            ids, cos = np.full((len(x), overlap), -1), np.full((len(x), overlap), -3.0)
            for b in np.unique(branches[:, k]).tolist():
                at = np.flatnonzero(branches[:, k] == b)
                s = x[at] @ self.leaves[self.first[b] : self.first[b + 1]].T
                near = np.argsort(-s, axis=1, kind="stable")[:, :overlap]
                ids[at, : near.shape[1]] = near + self.first[b]
                cos[at, : near.shape[1]] = np.take_along_axis(s, near, 1)
            best, value = np.concatenate([best, ids], 1), np.concatenate([value, cos], 1)
        order = np.argsort(-value, axis=1, kind="stable")[:, :overlap]
        best = np.take_along_axis(best, order, 1)
        return np.sort(np.where(best < 0, best[:, :1], best), axis=1)


def _matrix(column) -> np.ndarray:
    column = one_array(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least item that each of n items reaches by pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[pairs[:, 0]], label[pairs[:, 1]])
        before = label.copy()
        for k in range(2):
            np.minimum.at(label, label[pairs[:, k]], low)
            np.minimum.at(label, pairs[:, k], low)
        label = label[label]
        if (label == before).all():
            return label


def _search(threshold: float, wide: int, exact: bool, cluster: int):
    def run(t: pa.Table) -> pa.Table:
        cell, a, b, own, ids = (t[c].to_numpy() for c in ("cell", "unit_a", "unit_b", "own", "id"))
        labels = t["label"].combine_chunks().dictionary_encode()
        labels, cells = labels.indices.to_numpy(), _cells(t["cells"])
        order = np.lexsort((ids, b, a, cell))
        new = np.flatnonzero(np.r_[True, (np.diff(cell[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)])
        rows, vectors = [], one_array(t["vector"])
        for at in np.split(order, new[1:]):
            if len(at) < 2:
                continue
            raw = _matrix(vectors.take(pa.array(at)))
            x = unit(raw)
            pairs, s = all_pairs(x, threshold) if exact else in_range(x, Graph(x, degree=wide * DEGREE, cluster=cluster), threshold, wide * BEAM)
            i, j = at[pairs[:, 0]], at[pairs[:, 1]]
            good = (labels[i] == labels[j]) & in_reach(s, raw[pairs[:, 0]], raw[pairs[:, 1]], threshold)
            if a[at[0]] != b[at[0]]:
                good &= own[i] != own[j]
            pairs, i, j = pairs[good], i[good], j[good]
            if not len(pairs):
                continue
            counted = _first_common(cells[i], cells[j]) == cell[at[0]]
            both, count = np.unique(np.r_[ids[i[counted]], ids[j[counted]]], return_counts=True)
            rows.append((both, np.full(len(both), -1), count))
            root = roots(len(at), pairs)
            far = np.flatnonzero(root != np.arange(len(at)))
            rows.append((ids[at[far]], ids[at[root[far]]], np.zeros(len(far), np.int64)))
        one, two, links = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.int64) for k in range(3))
        edge = links == 0
        return pa.table([pa.array(one), pa.array(two, mask=~edge), pa.array(links, mask=edge)], ["a", "b", "links"])

    return run


def _cells(column) -> np.ndarray:
    """The regions of each row as one matrix; every row has as many."""
    column = one_array(column)
    return column.flatten().to_numpy().reshape(len(column), -1)


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number that two rows share; the greatest number of all where they share none."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for k in range(a.shape[1]):
        out = np.minimum(out, np.where((b == a[:, k : k + 1]).any(1), a[:, k], out))
    return out


def _sampled(df: DataFrame, n: int, share_of: int, salt: str):
    """At most n rows of df, those whose id hashes lowest, with (label, id, vector) on the driver; and their share."""
    share = min(1.0, n / max(1, share_of))
    number = F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 40))
    # In the order of the hash, so that the same rows are drawn whatever ran first.
    got = df.where(number <= F.lit(int(share * (1 << 40)))).orderBy(number, "id").limit(n).toPandas()
    return got, share


def _truth(df: DataFrame, queries, threshold: float) -> dict[int, int]:
    """Of each audited query its links among all rows, by brute force in blocks."""
    by = {}
    for label, rows in queries.groupby("label"):
        by[label] = (rows["id"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, ids = np.array(batch.column(0).to_pylist()), batch.column(1).to_numpy()
            for label, (q, raw) in by.items():
                rows = np.flatnonzero(labels == label)
                if len(rows):
                    y = _matrix(batch.column(2).take(pa.array(rows)))
                    s = unit(raw) @ unit(y).T
                    i, j = np.nonzero(s >= threshold - CLOSE)
                    good = in_reach(s[i, j], raw[i], y[j], threshold) & (q[i] != ids[rows][j])
                    yield pa.record_batch([pa.array(q), pa.array(np.bincount(i[good], minlength=len(q)))], ["id", "n"])

    counts = df.select("label", "id", "vector").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # At most DRAWN rows.
    return {int(r["id"]): int(r["n"]) for r in counts.collect()}


def average_recall(truth: dict[int, int], got: dict[int, int]) -> float:
    """Average over the queries with links of the share found, so that each counts alike; 1 if there are none."""
    shares = [min(got.get(k, 0), v) / v for k, v in truth.items() if v]
    return sum(shares) / len(shares) if shares else 1.0


def link(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, overlap: int = OVERLAP, recall: float = RECALL,
    region: int = REGION, block: int = BLOCK, cluster: int = CLUSTER,
) -> DataFrame:
    """Every row's key, n_links, component_id, kept (key = component_id) and audited_recall.

    Vectors that are null, empty, zero, or hold null or non-finite components,
    and vectors without a label, link with nothing; nor do vectors of different
    length. Rows with the same id are one vector (the least of them), and each
    gets its result; rows without an id get null, no links, and are kept. Other
    columns of df are ignored, whatever their names. audited_recall is the
    average share of links found, of the audited queries.
    """
    small_batches(df.sparkSession)
    rows = df.select(df[key].cast("long").alias("id"), df[label].cast("string").alias("label"), df[vector].cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite)
    good = good.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("v")).select(F.concat_ws(":", F.size("v.vector"), "v.label").alias("label"), "id", "v.vector")
    good = written(good)
    n = good.count()
    trees = _trees(good, region)
    truth, drawn = {}, AUDIT
    while True:
        audit, _ = _sampled(good, drawn, n, "audit")
        truth = _truth(good, audit, threshold) if len(audit) else {}
        if sum(v > 0 for v in truth.values()) >= LINKED or drawn >= min(n, DRAWN):
            break
        drawn *= 4
    most = max([len(t.leaves) for t in trees.values()], default=1)
    overlap, wide, exact = min(overlap, most), 1, False
    while True:
        found = written(_found(good, trees, overlap, threshold, n, wide, exact, region, block, cluster))
        links = found.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("n_links"))
        # At most DRAWN ids are looked up.
        got = {int(r["id"]): int(r["n_links"]) for r in links.where(F.col("id").isin([k for k, v in truth.items() if v] or [None])).collect()}
        measured = average_recall(truth, got)
        if exact and overlap >= most or measured >= recall:
            break
        exact = overlap >= most and wide >= WIDEST
        overlap, wide = max(overlap, min(2 * overlap, most)), min(2 * wide, WIDEST)
    groups = connected_components(found.where("b is not null").select("a", "b"))
    out = rows.select("id").join(links, "id", "left").join(groups, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"), F.lit(measured).alias("audited_recall"),
    )


def _trees(good: DataFrame, region: int) -> dict[str, Leaves]:
    """A tree of centroids for each label with more than `region` vectors, from at most SAMPLE of their vectors.

    Leaves grow with the table up to SAMPLE / PER_LEAF; beyond that regions grow,
    and are cut into blocks.
    """
    large = good.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > region)
    held = large.agg(F.sum("n")).first()[0]
    if not held:
        return {}
    sample, share = _sampled(good.join(large.select("label"), "label", "left_semi"), SAMPLE, int(held), "centroids")
    return {k: Leaves(unit(np.stack(v["vector"].to_numpy()).astype(np.float64)), max(2, -(-int(len(v) / share) // (region // 2)))) for k, v in sample.groupby("label")}


def _found(good: DataFrame, trees: dict[str, Leaves], overlap: int, threshold: float, n: int, wide: int, exact: bool, region: int, block: int, cluster: int) -> DataFrame:
    """Link counts (a, links) and edges to each vector's least partner in its unit (a, b), of all units."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(0).dictionary_encode()
            names, which = labels.dictionary.to_pylist(), labels.indices.to_numpy()
            out = np.zeros((b.num_rows, overlap), np.int64)
            for k, name in enumerate(names):
                if name in trees:
                    at = np.flatnonzero(which == k)
                    out[at] = trees[name].nearest(unit(_matrix(b.column(2).take(pa.array(at)))), overlap)
            yield pa.record_batch([*b.columns, pa.array(list(out), pa.list_(pa.int64()))], ["label", "id", "vector", "near"])

    # A region's number hashes its label, so that `cells` is comparable within a label; units compare labels too.
    dealt = good.select("label", "id", "vector").mapInArrow(cells, "label string, id long, vector array<double>, near array<long>")
    dealt = dealt.withColumn("cells", F.transform("near", lambda c: F.xxhash64("label", c))).withColumn("cell", F.explode(F.array_distinct("cells")))
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    # Regions up to twice the size are units of their own, for leaves differ in size.
    blocks = F.when(F.col("size") <= 2 * region, F.lit(1)).otherwise(F.col("size"))
    units = block_pairs(dealt.join(sizes, "cell"), "cell", blocks, "id", block)
    buckets = max(32, -(-n * overlap // region))
    units = units.withColumn("bucket", F.pmod(F.xxhash64("cell", "unit_a", "unit_b"), F.lit(buckets)).cast("int"))
    return units.select("bucket", "cell", "unit_a", "unit_b", "own", "id", "label", "cells", "vector").groupBy("bucket").applyInArrow(_search(threshold, wide, exact, cluster), "a long, b long, links long")
