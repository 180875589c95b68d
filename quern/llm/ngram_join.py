"""N-gram Jaccard join: an LSH forest of MinHash signatures, then exact verification.

Two documents are linked if the sets of their word 5-grams have a Jaccard
similarity of 0.8 or more.

1. Documents with the same set form a *class*. It has a number, since its least
   id may also be that of another class (if one id comes with two texts).
   Everything below is about classes; copies only count.
2. Each class has a path of `deepest` MinHash values in each of `trees` trees.
   A tree's paths, sorted, are its prefix trie: classes with a common prefix of d
   values stand below one node of depth d.
3. The shallowest depth that is matched starts where a pair of exactly the
   threshold is predicted to meet in some tree with the target recall:
   1 - (1 - t^d)^trees. All paths below one node of that depth go to one task,
   which sorts them and walks the trie from the deepest common prefixes upwards:
   below each node, classes in different trees of the forest of links so far are
   linked if their signatures agree in a share of the places that a pair of the
   threshold reaches but for a chance of 1e-7. It hands on a spanning forest of
   these links, not the pairs. Components hold every candidate pair, and little
   else.
4. The recall of the components is audited: the links of sampled classes among
   all classes are computed exactly. While it is below the target, matched
   prefixes are shortened by one value, and the walk goes on from there.
5. Components are verified exactly: all pairs of a component, as products of
   0/1 matrices over the shingles that two members share. Large components
   are cut into blocks and each pair of blocks is a unit of its own. A unit
   gives each class the number of documents it links to, and a spanning
   forest of the links; components of those forests are the classes' groups.

No step has a cap. Units, groups and buckets are bounded by splitting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import U64, bucket_count, connected_components, discard, give_back, mix, parts, small_batches, spans_hash, utf8, windows_hash, words, written

WORDS, THRESHOLD, TREES, DEEPEST, RECALL = 5, 0.8, 24, 8, 0.9999
#: Standard deviations below the threshold from which on two signatures are no candidates.
LOOSE = 5.5
#: Members of a prefix group, and of a component, that one unit takes from each of two blocks.
GROUP_BLOCK, BLOCK = 2048, 256
#: Classes that are audited, and shingles of one (bounds), and the share of their links that has to be among the candidates.
AUDIT, AUDIT_SHINGLES, AUDITED = 256, 20_000, 0.99
#: The low bits of a MinHash value that a path keeps, and the places of which a sketch keeps eight bits.
PLACE, SKETCH = np.dtype(">u2"), 64
#: Rows up to which a side is broadcast.
SMALL = 100_000


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """The longest prefix whose predicted recall at the threshold reaches the target; 1 if none does."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_agreement(threshold: float, places: int) -> float:
    """The share of equal places that a pair of exactly the threshold reaches but for a chance of about 1e-7 (1e-6 at .95)."""
    return max(0.0, threshold - LOOSE * (threshold * (1 - threshold) / places) ** 0.5)


def shingles(data: np.ndarray, off: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's word n-grams; of all its words where it has fewer than n."""
    starts, ends, woff = words(data, off)
    h = spans_hash(data, starts, ends)
    full, n = windows_hash(h, width, 2), np.diff(woff)
    few = {k: windows_hash(h, k, 20 + k) for k in range(1, width)}
    out = []
    for k, lo in enumerate(woff[:-1].tolist()):
        size = int(n[k])
        out.append(np.unique(full[lo : lo + size - width + 1]) if size >= width else few[size][lo : lo + 1] if size else full[:0])
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set of hashes, as two signed numbers."""
    return tuple(int(x.view(np.int64)) for x in (mix(s + U64(len(s))).sum(dtype=U64), mix(s ^ U64(0xD1B54A32D192ED03)).sum(dtype=U64)))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
    return x[:n, None], x[n:, None] | U64(1)


def signature(s: np.ndarray, n: int) -> np.ndarray:
    """n MinHash values of a set that is not empty."""
    a, b = _functions(n)
    out = np.full(n, 0xFFFFFFFFFFFFFFFF, U64)
    for lo in range(0, len(s), 2048):
        out = np.minimum(out, ((s[None, lo : lo + 2048] ^ a) * b).min(1))
    return out


def _sketched(places: int) -> np.ndarray:
    """The places that a sketch keeps, spread evenly; all if there are few."""
    return np.unique(np.linspace(0, places - 1, min(SKETCH, places)).astype(np.int64))


def signed(df: DataFrame, key: str, text: str, places: int, width: int = WORDS) -> DataFrame:
    """Of every row: id, n (shingles), h1, h2 (of the set), sig, two bytes per place, which sort as the values do, and sketch, a byte for some places."""
    small_batches(df.sparkSession)
    rows = df.select(df[key].cast("long").alias("id"), df[text].alias("text"))
    few = _sketched(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, 1):
            n, h, sig, sketch = [], [], [], []
            for s in shingles(*utf8(b.column(1)), width):
                n.append(len(s))
                h.append(set_hash(s) if len(s) else (0, 0))
                v = mix(signature(s, places)) if len(s) else None
                sig.append(None if v is None else v.astype(PLACE).tobytes())
                sketch.append(None if v is None else v[few].astype(np.uint8).tobytes())
            yield pa.record_batch(
                [b.column(0), pa.array(n, pa.int32()), pa.array([x[0] for x in h], pa.int64()), pa.array([x[1] for x in h], pa.int64()), pa.array(sig, pa.binary()), pa.array(sketch, pa.binary())],
                ["id", "n", "h1", "h2", "sig", "sketch"],
            )

        give_back()

    return rows.mapInArrow(run, "id long, n int, h1 long, h2 long, sig binary, sketch binary")


def block_pairs(df: DataFrame, group: str, size: Column, item: str, block: int) -> DataFrame:
    """Each row once for every unit it belongs to: columns unit_a, unit_b, own (its block) are added.

    A group of up to `block` rows is one unit. A larger one is cut into blocks
    by a hash of the item, and every pair of blocks is a unit.
    """
    blocks = F.ceil(size / block).cast("int")
    df = df.withColumn("own", F.pmod(F.xxhash64(F.lit("block"), F.col(item), F.col(group)), F.greatest(blocks, F.lit(1))).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.greatest(blocks, F.lit(1)) - 1)))
    return df.withColumn("unit_a", F.least("own", "_other")).withColumn("unit_b", F.greatest("own", "_other")).drop("_other")


def spanning(linked: np.ndarray, label: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """Edges of linked (rows x columns) that join two trees of the forest whose trees `label` tells apart."""
    out = []
    for k in np.flatnonzero(linked.any(1)).tolist():
        to, own = columns[np.flatnonzero(linked[k])], label[rows[k]]
        other = label[to] != own
        if other.any():
            trees, first = np.unique(label[to][other], return_index=True)
            out += [(int(rows[k]), int(j)) for j in to[other][first]]
            label[np.isin(label, trees)] = own
    return out


def _agree(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y agree in `least` of the places."""
    count = np.zeros((len(x), len(y)), np.int16)
    for k in range(x.shape[1]):
        count += x[:, k, None] == y[None, :, k]
    return count >= least * x.shape[1]


def walk(paths: np.ndarray, sig: np.ndarray, floor: int, least: float) -> list[tuple[int, int]]:
    """Links between classes below one node of depth `floor`: a spanning forest.

    paths are what lies below that node, sorted. Below each node, from the
    deepest on, neighbours in the order are compared first; then what is not in
    the largest tree meets all.
    """
    n, deepest = len(paths), floor + paths.shape[1]
    common = floor + np.cumprod(paths[1:] == paths[:-1], axis=1).sum(1)
    beside = (sig[1:] == sig[:-1]).mean(1) >= least
    forest, at, out = np.arange(n), np.arange(n), []
    for depth in range(deepest, floor - 1, -1):
        ends = np.flatnonzero(np.r_[common < depth, True]) + 1
        starts = np.r_[0, ends[:-1]]
        # Nodes that have more to join than at the depth below.
        more = (ends - starts > 1) & (np.add.reduceat(np.r_[common == depth, False], starts) > 0) if n > 1 else np.zeros(len(ends), bool)
        for lo, hi in zip(starts[more].tolist(), ends[more].tolist(), strict=True):
            for k in np.flatnonzero(beside[lo : hi - 1]).tolist():
                a, b = forest[lo + k], forest[lo + k + 1]
                if a != b:
                    out.append((lo + k, lo + k + 1))
                    forest[forest == b] = a
            own = forest[lo:hi]
            names, size = np.unique(own, return_counts=True)
            if len(names) > 1:
                rest = lo + np.flatnonzero(own != names[size.argmax()])
                for k in range(0, len(rest), 64):
                    part = rest[k : k + 64]
                    linked = _agree(sig[part], sig[lo:hi], least) & (forest[part][:, None] != forest[None, lo:hi])
                    out += spanning(linked, forest, part, at[lo:hi])
    return out


def _candidates(least: float, floor: int):
    def run(t: pa.Table) -> pa.Table:
        """Forests of the nodes in a bucket: rows key, unit_a, unit_b, cls, path (below the node), sketch."""
        key, a, b, cls = (t[c].to_numpy() for c in ("key", "unit_a", "unit_b", "cls"))
        data, off = utf8(t["sketch"])
        sig = data[: int(off[-1])].reshape(len(key), -1)
        data, off = utf8(t["path"])
        path = data[: int(off[-1])].view(PLACE).reshape(len(key), -1)
        # Sorted by node, unit and path: the trie of each node.
        order = np.lexsort((cls, *path.T[::-1], b, a, key))
        key, a, b, cls, sig, path = (x[order] for x in (key, a, b, cls, sig, path))
        new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        size = np.diff(np.r_[new, len(key)])
        two = new[size == 2]
        two = two[(sig[two] == sig[two + 1]).mean(1) >= least]
        edges = [np.stack([cls[two], cls[two + 1]], 1)]
        for lo, n in zip(new[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            found = walk(path[lo : lo + n], sig[lo : lo + n], floor, least)
            if found:
                edges.append(cls[lo + np.array(found)])
        edges = np.unique(np.concatenate(edges), axis=0)
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def _members(reps: DataFrame, floor: int, trees: int, deepest: int, least: float) -> DataFrame:
    """(cls, component) of all classes that meet another below nodes of depth `floor` or deeper."""
    wide = PLACE.itemsize * deepest
    each = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.xxhash64(t, F.substring("sig", t * wide + 1, F.lit(PLACE.itemsize * floor))).alias("key")))
    keys = reps.select("cls", F.explode(each).alias("k")).select("cls", "k.tree", "k.key")
    # Written, so that a node below which very many classes stand can be split in the join.
    counts = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    units = written(block_pairs(keys.join(counts, "key"), "key", F.col("size"), "cls", GROUP_BLOCK).select("key", "tree", "unit_a", "unit_b", "cls"))
    n = max(32, -(-units.count() // 20_000))
    below = F.substring("sig", F.col("tree") * wide + PLACE.itemsize * floor + 1, F.lit(PLACE.itemsize * (deepest - floor)))
    bucket = F.pmod(F.xxhash64("key", "unit_a", "unit_b"), F.lit(n)).cast("int")
    dealt = units.join(reps.select("cls", "sig", "sketch"), "cls").select(bucket.alias("bucket"), "key", "unit_a", "unit_b", "cls", below.alias("path"), "sketch")
    forest = written(dealt.groupBy("bucket").applyInArrow(_candidates(least, floor), "a long, b long"))
    members = written(connected_components(forest).withColumnRenamed("id", "cls"))
    discard(counts, units, forest)
    return members


def _audited(texts: DataFrame, reps: DataFrame, members: DataFrame, threshold: float, width: int, least: float) -> float:
    """Of sampled classes, the average share of the classes linked to them that are in their component.

    The signatures of all classes are compared with those of the sample; whose
    agree as candidates have to are read, and their similarity is computed
    exactly. Classes without a link do not count.
    """
    whole = reps.join(members, "cls", "left")
    # At most AUDIT classes of at most AUDIT_SHINGLES shingles, those whose number hashes lowest.
    drawn = whole.where(F.col("n") <= AUDIT_SHINGLES).orderBy(F.xxhash64(F.lit("audit"), "cls"), "cls").limit(AUDIT).select("cls", "rep", "h1", "h2", "sketch", "component").collect()
    if not drawn:
        return 1.0
    ids, queries = sorted({r["rep"] for r in drawn}), np.stack([np.frombuffer(r["sketch"], np.uint8) for r in drawn])
    at = {(r["h1"], r["h2"]): k for k, r in enumerate(drawn)}
    own = np.array([r["cls"] for r in drawn])
    comp = np.array([-1 - k if r["component"] is None else r["component"] for k, r in enumerate(drawn)])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = {at[set_hash(x)]: x.tobytes() for x in shingles(*utf8(b.column(1)), width) if set_hash(x) in at}
            yield pa.record_batch([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.binary())], ["q", "shingles"])

    sets_of = {r["q"]: np.frombuffer(r["shingles"], U64) for r in texts.where(F.col("rep").isin(ids)).mapInArrow(sets, "q int, shingles binary").collect()}
    known = [sets_of.get(k, np.zeros(0, U64)) for k in range(len(drawn))]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for x in batches if x.num_rows):
            data, off = utf8(b.column(1))
            sig = data[: int(off[-1])].reshape(b.num_rows, -1)
            yield pa.record_batch([b.column(0).filter(pa.array(_agree(sig, queries, least).any(1)))], ["cls"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        for b in batches:
            cls, h1, h2 = (b.column(k).to_numpy() for k in range(3))
            component = b.column(3).fill_null(-1 << 62).to_numpy()
            some = shingles(*utf8(b.column(4)), width)
            good = [k for k, x in enumerate(some) if set_hash(x) == (h1[k], h2[k])]
            if good:
                hit = linked_pairs(known, [some[k] for k in good], threshold) & (own[:, None] != cls[good][None, :])
                total += hit.sum(1)
                found += (hit & (comp[:, None] == component[good][None, :])).sum(1)
        yield pa.record_batch([pa.array(own), pa.array(total), pa.array(found)], ["q", "linked", "found"])

    close = written(reps.select("cls", "sketch").mapInArrow(near, "cls long"))
    asked = written(whole.join(F.broadcast(close) if close.count() <= SMALL else close, "cls").select("rep", "cls", "h1", "h2", "component"))
    read = texts.join(F.broadcast(asked) if asked.count() <= SMALL else asked, "rep").select("cls", "h1", "h2", "component", "text")
    sums = read.mapInArrow(linked, "q long, linked long, found long").groupBy("q").agg(F.sum("linked").alias("linked"), F.sum("found").alias("found"))
    shares = sums.where("linked > 0").agg(F.avg(F.col("found") / F.col("linked"))).first()[0]
    discard(close, asked)
    return 1.0 if shares is None else float(shares)


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets, by products of 0/1 matrices."""
    out = np.zeros((len(left), len(right)), np.float32)
    lv, rv = np.concatenate(left), np.concatenate(right)
    lr, rr = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(lv, rv)
    if not len(shared):
        return out
    cl, cr = np.searchsorted(shared, lv), np.searchsorted(shared, rv)
    ok = shared[np.minimum(cl, len(shared) - 1)] == lv
    cl, lr = cl[ok], lr[ok]
    ok = shared[np.minimum(cr, len(shared) - 1)] == rv
    cr, rr = cr[ok], rr[ok]
    ol, orr = np.argsort(cl, kind="stable"), np.argsort(cr, kind="stable")
    cl, lr, cr, rr = cl[ol], lr[ol], cr[orr], rr[orr]
    step = 4096
    for lo in range(0, len(shared), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        i, j = np.searchsorted(cl, [lo, lo + step]), np.searchsorted(cr, [lo, lo + step])
        x[lr[i[0] : i[1]], cl[i[0] : i[1]] - lo] = 1
        y[rr[j[0] : j[1]], cr[j[0] : j[1]] - lo] = 1
        out += x @ y.T
    return out


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs have a Jaccard similarity of threshold or more, exactly."""
    both = np.rint(common(left, right)).astype(np.int64)
    union = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :] - both
    return (both > 0) & (both >= threshold * union - 1e-9)


def _verifier(threshold: float, width: int):
    def run(t: pa.Table) -> pa.Table:
        comp, a, b = (t[c].to_numpy() for c in ("component", "unit_a", "unit_b"))
        cls, own, weight, h1, h2 = (t[c].to_numpy() for c in ("cls", "own", "weight", "h1", "h2"))
        order = np.lexsort((cls, b, a, comp))
        new = np.flatnonzero(np.r_[True, np.diff(comp[order]) != 0] | np.r_[True, np.diff(a[order]) != 0] | np.r_[True, np.diff(b[order]) != 0])
        texts, links, edges = t["text"].combine_chunks(), [], []
        for at in np.split(order, new[1:]):
            sets = shingles(*utf8(texts.take(pa.array(at))), width)
            # Of rows with one id, that whose set is the class's; once.
            good, seen = [], set()
            for k, (s, row) in enumerate(zip(sets, at.tolist(), strict=True)):
                if cls[row] not in seen and len(s) and set_hash(s) == (h1[row], h2[row]):
                    good.append(k)
                    seen.add(cls[row])
            at, sets = at[good], [sets[k] for k in good]
            if len(at) < 2:
                continue
            cross = a[at[0]] != b[at[0]]
            left = np.flatnonzero(own[at] == a[at[0]]) if cross else np.arange(len(at))
            right = np.flatnonzero(own[at] == b[at[0]]) if cross else left
            if not len(left) or not len(right):
                continue
            ok = linked_pairs([sets[k] for k in left], [sets[k] for k in right], threshold)
            if not cross:
                np.fill_diagonal(ok, False)
            w = weight[at]
            count = np.zeros(len(at), np.int64)
            count[left] += ok @ w[right]
            if cross:
                count[right] += ok.T @ w[left]
            links += [(int(cls[at[k]]), int(count[k])) for k in np.flatnonzero(count)]
            edges += [(int(cls[at[x]]), int(cls[at[y]])) for x, y in spanning(ok, np.arange(len(at)), left, right)]
        rows = [(r, None, n) for r, n in links] + [(x, y, None) for x, y in edges]
        give_back()
        return pa.table([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "links"])

    return run


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WORDS, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST, audited: float = AUDITED) -> DataFrame:
    """Every row's key, class_id (least id of its group), n_links (other rows linked to it), kept (key = class_id) and audited_recall (of the candidates).

    A text without words, or a null one, links with nothing and is its own
    group. A text of fewer than `width` words has one shingle of them all. Rows
    repeated with the same id are copies of each other like any others. Rows
    whose key is null are their own groups, with a null class_id, and are kept;
    they count in no links. Other columns of df are ignored, whatever their
    names.
    """
    floor, least = prefix_depth(threshold, trees, recall, deepest), least_agreement(threshold, len(_sketched(trees * deepest)))
    rows = written(signed(df, key, text, trees * deepest, width))
    known = rows.where("id is not null and n > 0")
    reps = known.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("sketch").alias("sketch"))
    # The numbers hold because they are written.
    reps = written(reps.withColumn("cls", F.monotonically_increasing_id()))
    texts = df.select(df[key].cast("long").alias("rep"), df[text].alias("text"))
    while True:
        met = _members(reps, floor, trees, deepest, least)
        measured = _audited(texts, reps, met, threshold, width, least)
        if measured >= audited or floor == 1:
            break
        discard(met)
        floor -= 1
    sizes = written(met.groupBy("component").agg(F.count(F.lit(1)).alias("size")))
    members = written(met.join(sizes, "component").join(reps.select("cls", "rep", "weight", "n", "h1", "h2"), "cls"))
    total = members.agg(F.sum(F.col("n") * F.ceil(F.col("size") / BLOCK))).first()[0] or 0
    # A shingle stands for about seven bytes of text.
    n = bucket_count(7 * int(total))
    # Texts are shuffled at every size, so that the plan of a small input is that of a large one.
    units = block_pairs(texts.join(members.hint("merge"), "rep"), "component", F.col("size"), "cls", BLOCK)
    units = units.withColumn("bucket", F.pmod(F.xxhash64("component", "unit_a", "unit_b"), F.lit(n)).cast("int"))
    found = written(units.select("bucket", "component", "unit_a", "unit_b", "own", "cls", "weight", "h1", "h2", "text").groupBy("bucket").applyInArrow(_verifier(threshold, width), "a long, b long, links long"))
    discard(met, sizes, members)
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"))
    groups = connected_components(found.where("b is not null").select("a", "b")).withColumnRenamed("id", "cls")
    least = groups.join(reps.select("cls", "rep"), "cls").groupBy("component").agg(F.min("rep").alias("least"))
    groups = groups.join(least, "component").select("cls", "least")
    classes = reps.select("cls", "h1", "h2", "rep", "weight").join(links, "cls", "left").join(groups, "cls", "left")
    classes = classes.select("h1", "h2", F.coalesce("least", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = known.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "class_id", "n_links")
    alone = rows.where("id is null or n = 0").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return out.union(alone).select(F.col("id").alias(key), "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"), F.lit(measured).alias("audited_recall"))
