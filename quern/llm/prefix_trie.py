"""Conversations as a trie of their prefixes, by polynomial rolling fingerprints.

Turns are sorted by conversation and place, dealt by range, and scanned with
numpy: turn d of a conversation adds its hash times BASE to the power d, modulo
2 ** 64, so a running sum is the fingerprint of the prefix. A scan of one
partition needs of those before it only how many turns the conversation that
runs across the border has, and their sum: one row per partition. So a
conversation with a third of all turns is scanned by many tasks.

Prefixes of one depth and fingerprint are a group of candidates. Each group is
verified: the last turn of every member is compared with that of its
representative, the least conversation, character by character. As this holds
for every depth, members that pass all of it have equal prefixes. Members that
differ get the number of their turn among the group's different ones, and the
numbers met so far split the group and all that hangs below it.

Subtrees are summed along chains. A node belongs to its least member; the nodes
of one conversation are the last ones of its path, without a gap. So the trie is
a tree of chains: sums run down each chain in one scan, and sums of whole chains
reach the chains above by pointer doubling, in rounds that grow with the
logarithm of the chains' depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import discard, give_back, one_array, small_batches, written

#: Of the polynomial; odd, so that no power of it vanishes.
BASE = 0x9E3779B97F4A7C15
#: Members whose numbers one row holds while they are sent to be hashed.
BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _powers(d: np.ndarray) -> np.ndarray:
    """BASE ** d modulo 2 ** 64, by squaring."""
    out, square, d = np.ones(len(d), np.uint64), np.uint64(BASE), d.astype(np.uint64)
    while d.any():
        out = np.where(d & np.uint64(1), out * square, out)
        with np.errstate(over="ignore"):
            square = np.uint64((int(square) * int(square)) & 0xFFFFFFFFFFFFFFFF)
        d = d >> np.uint64(1)
    return out


def scanned(df: DataFrame, order: list[str], mask: int = -1) -> DataFrame:
    """Rows of df (conv_id, t, ...) with depth (from 1, by `order` within conv_id) and print, the fingerprint of the turns so far.

    t is the hash of a turn. Rows equal in conv_id and order keep any order
    among them. print is cut to the bits of mask.
    """
    names = df.columns
    dealt = df.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order)
    kinds = ", ".join(f"`{k}` {v}" for k, v in df.dtypes)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, conv, seen, total, last = TaskContext.get().partitionId(), None, 0, np.uint64(0), None
        for b in batches:
            if b.num_rows == 0:
                continue
            ids, t = b.column("conv_id").to_numpy(), b.column("t").to_numpy().astype(np.uint64)
            first = np.r_[ids[0] != conv, ids[1:] != ids[:-1]]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
            goes_on = np.cumsum(first) == 0
            depth = np.arange(len(ids)) - begin + 1 + np.where(goes_on, seen, 0)
            part = t * _powers(depth)
            sums = np.cumsum(part, dtype=np.uint64)
            before = np.where(begin > 0, sums[begin - 1], np.uint64(0))
            sums = sums - before + np.where(goes_on, total, np.uint64(0))
            conv, seen, total = ids[-1], int(depth[-1]), sums[-1]
            if last is not None:
                yield last
            made = [*b.columns, pa.array(depth), pa.array(sums.view(np.int64)), pa.array(np.full(len(ids), task, np.int32))]
            whole = pa.record_batch([*made, pa.array(np.zeros(len(ids), bool))], out)
            # Only the last row of a partition is a border, and which it is shows at the end.
            last = whole.slice(len(ids) - 1)
            if len(ids) > 1:
                yield whole.slice(0, len(ids) - 1)
        if last is not None:
            yield pa.record_batch([*last.columns[:-1], pa.array([True])], out)
        give_back()

    out = [*names, "_depth", "_sum", "_task", "_border"]
    held = written(dealt.mapInArrow(local, f"{kinds}, _depth long, _sum long, _task int, _border boolean"))
    # One row per partition: the conversation that is open at its end.
    borders = sorted((r["_task"], r["conv_id"], r["_depth"], r["_sum"]) for r in held.where("_border").select("_task", "conv_id", "_depth", "_sum").collect())
    carried, open_id, count, total = {}, None, 0, 0
    for task, conv, depth, partial in borders:
        if open_id is not None:
            carried[task] = (open_id, count, total)
        same = conv == open_id
        power = pow(BASE, count, 1 << 64) if same else 1
        count, total = (count + depth, total + power * partial) if same else (depth, partial)
        open_id = conv

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, depth, sums, task = (b.column(c).to_numpy() for c in ("conv_id", "_depth", "_sum", "_task"))
            depth, sums = depth.copy(), sums.astype(np.uint64)
            for k in np.unique(task).tolist():
                if k in carried:
                    conv, n, total = carried[k]
                    of = (task == k) & (ids == conv)
                    power = np.uint64(pow(BASE, n, 1 << 64))
                    depth[of] += n
                    sums[of] = sums[of] * power + np.uint64(total & 0xFFFFFFFFFFFFFFFF)
            sums = sums & np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(depth), pa.array(sums.view(np.int64))], [*names, "depth", "print"])

    return held.mapInArrow(whole, f"{kinds}, depth long, print long")


def turns(df: DataFrame) -> DataFrame:
    """The turns of conversations that have an id: conv_id, turn, role, text (null: empty), t."""
    role, text = (F.coalesce(df[c].cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.where(df["conv_id"].isNotNull()).select(df["conv_id"].cast("long").alias("conv_id"), df["turn"].alias("turn"), role.alias("role"), text.alias("text"))
    return rows.withColumn("t", F.xxhash64("role", "text"))


def _split(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, print, role, text, ...) with path: the numbers by which conversations left the representatives of their groups.

    Each group's least and greatest last turn, and its representative's, come
    from one aggregate that is combined before it is shuffled. Groups in which
    they differ are taken apart by turn; there are none unless hashes collide.
    """
    turn = F.struct("role", "text")
    groups = rows.groupBy("depth", "print").agg(F.min(turn).alias("lo"), F.max(turn).alias("hi"))
    mixed = written(groups.where("lo <> hi").select("depth", "print"))
    if mixed.isEmpty():
        discard(mixed)
        return rows.withColumn("path", F.lit(""))
    own = rows.join(mixed, ["depth", "print"])
    kinds = own.groupBy("depth", "print", "role", "text").agg(F.min("conv_id").alias("least"))
    # The representative's turn counts as 0; a turn is numbered by the least conversation that has it, which no other turn has.
    numbered = kinds.join(kinds.groupBy("depth", "print").agg(F.min("least").alias("rep")), ["depth", "print"])
    left = numbered.where("least <> rep")
    met = own.join(left, ["depth", "print", "role", "text"]).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "least"))).alias("met"))
    met = written(met)
    path = F.transform(F.filter("met", lambda m: m["depth"] <= F.col("depth")), lambda m: F.concat_ws(":", m["depth"].cast("string"), m["least"].cast("string")))
    return rows.join(met, "conv_id", "left").withColumn("path", F.coalesce(F.concat_ws(",", path), F.lit(""))).drop("met")


def _hashed(ends: DataFrame, key: list[str]) -> DataFrame:
    """ends (key, conv_id) as (key, sha256 of the ids in order, joined by commas).

    Ids are sorted by range and packed into rows of up to BLOCK ids first, so
    that a node at which very many conversations end is few rows where its hash,
    which only runs from first to last, is made; no node's ids are held whole.
    """
    kinds = dict(ends.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in key)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            columns, ids = [b.column(k) for k in key], b.column("conv_id").to_numpy()
            same = np.ones(len(ids) - 1, bool)
            for c in columns:
                c = one_array(c).dictionary_encode().indices.to_numpy(zero_copy_only=False)
                same &= c[1:] == c[:-1]
            cuts = np.unique(np.r_[0, np.flatnonzero(~same) + 1, np.arange(0, len(ids), BLOCK)])
            text = [",".join(map(str, ids[a:z].tolist())).encode() for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ids)], strict=True)]
            yield pa.record_batch([*(c.take(pa.array(cuts)) for c in columns), pa.array(ids[cuts]), pa.array(text, pa.binary())], [*key, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, h = None, None
        for b in batches:
            done, hashes = [], []
            for row, ids in zip(zip(*(b.column(k).to_pylist() for k in key), strict=True), b.column("ids").to_pylist(), strict=True):
                if row != held:
                    if held is not None:
                        done.append(held)
                        hashes.append(h.hexdigest())
                    held, h = row, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            if done:
                yield rows(done, hashes)
        if held is not None:
            yield rows([held], [h.hexdigest()])

    def rows(done: list[tuple], hashes: list[str]) -> pa.RecordBatch:
        columns = [pa.array([d[k] for d in done], pa.string() if kinds[c] == "string" else pa.int64()) for k, c in enumerate(key)]
        return pa.record_batch([*columns, pa.array(hashes)], [*key, "ends_sha256"])

    blocks = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(pack, f"{schema}, first long, ids binary")
    return blocks.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, f"{schema}, ends_sha256 string")


def _rolled_up(chains: DataFrame) -> DataFrame:
    """Sums of each chain and of all that hang on it, from rows (chain, up, leaves, saved); up is null at the top.

    After round k a chain holds the sums of what lies less than 2 ** k chains
    below it, and points at the chain 2 ** k above.
    """
    state = written(chains)
    while not (going := state.where("up is not null")).isEmpty():
        more = going.groupBy(F.col("up").alias("chain")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        above = state.select(F.col("chain").alias("up"), F.col("up").alias("_next"))
        new = state.join(more, "chain", "left").join(above, "up", "left")
        new = written(new.select("chain", F.col("_next").alias("up"), (F.col("leaves") + F.coalesce("_l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0))).alias("saved")))
        discard(state)
        state = new
    return state


def _down_chains(nodes: DataFrame) -> DataFrame:
    """nodes (chain, depth, leaves, saved, ...) with sums over the node and all deeper nodes of its chain.

    Like scanned(), from the deepest node up: one row per partition says what a
    chain that runs across the border has so far.
    """
    names = nodes.columns
    kinds = ", ".join(f"`{k}` {v}" for k, v in nodes.dtypes)
    dealt = nodes.repartitionByRange(F.col("chain"), F.col("depth").desc()).sortWithinPartitions(F.col("chain"), F.col("depth").desc())
    sums = ["leaves", "saved"]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, chain, total, last = TaskContext.get().partitionId(), None, [0, 0], None
        for b in batches:
            if b.num_rows == 0:
                continue
            ids = b.column("chain").to_numpy()
            first = np.r_[ids[0] != chain, ids[1:] != ids[:-1]]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
            goes_on, made = np.cumsum(first) == 0, {}
            for k, c in enumerate(sums):
                run = np.cumsum(b.column(c).to_numpy())
                run = run - np.where(begin > 0, run[begin - 1], 0) + np.where(goes_on, total[k], 0)
                made[c], total[k] = pa.array(run), int(run[-1])
            chain = ids[-1]
            if last is not None:
                yield last
            whole = pa.record_batch([*(made.get(c, b.column(c)) for c in names), pa.array(np.full(len(ids), task, np.int32)), pa.array(np.zeros(len(ids), bool))], out)
            last = whole.slice(len(ids) - 1)
            if len(ids) > 1:
                yield whole.slice(0, len(ids) - 1)
        if last is not None:
            yield pa.record_batch([*last.columns[:-1], pa.array([True])], out)

    out = [*names, "_task", "_border"]
    held = written(dealt.mapInArrow(local, f"{kinds}, _task int, _border boolean"))
    carried, open_id, total = {}, None, (0, 0)
    for r in sorted(held.where("_border").select("_task", "chain", *sums).collect()):
        if open_id is not None:
            carried[r[0]] = (open_id, *total)
        total = (r[2] + total[0], r[3] + total[1]) if r[1] == open_id else (r[2], r[3])
        open_id = r[1]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, task = b.column("chain").to_numpy(), b.column("_task").to_numpy()
            made = {c: b.column(c).to_numpy().copy() for c in sums}
            for k in np.unique(task).tolist():
                if k in carried:
                    of = (task == k) & (ids == carried[k][0])
                    for c, more in zip(sums, carried[k][1:], strict=True):
                        made[c][of] += more
            yield pa.record_batch([pa.array(made[c]) if c in made else b.column(c) for c in names], names)

    return held.mapInArrow(whole, kinds)


def trie(df: DataFrame, ids: DataFrame | None = None, bits: int = 64) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text): a row for each distinct prefix, the empty one included.

    Returns conv_id (the node's least member), depth, parent_conv_id (null at
    the root), n_convs, members; n_children; n_leaves, childless nodes in its
    subtree; saved_tokens, over its subtree the members but one of each node
    times the words of its last text; ends_sha256, of the numbers of the members
    that end here, in order and joined by commas; role and text of its last
    turn (null at the root).

    Turns go by `turn`, nulls first, equal ones by role and text; repeated rows
    are turns of their own. A null role or text is empty. ids (conv_id) adds
    conversations without turns, members of the root. Rows without a conv_id
    belong to no conversation. Without conversations there are no nodes. bits is
    the width of fingerprints: any width gives the same trie, narrow ones split
    more groups. Other columns of df are ignored.
    """
    small_batches(df.sparkSession)
    rows = turns(df)
    everyone = rows.select("conv_id")
    if ids is not None:
        everyone = everyone.unionByName(ids.where("conv_id is not null").select(F.col("conv_id").cast("long")))
    everyone = written(everyone.distinct())
    prints = scanned(rows, ["turn", "role", "text"], (1 << bits) - 1)
    prints = written(prints.withColumn("words", F.regexp_count("text", F.lit(WORD)).cast("long")))
    paths = _split(prints)
    key = ["depth", "print", "path"]
    # The prefix before: its fingerprint lacks the last turn's summand, which is found on the row before.
    before = prints.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("print").alias("up_print"))
    whole = paths.join(before, ["conv_id", "depth"], "left")
    up_path = F.when(F.col("path").rlike("(^|,)[0-9]+:-?[0-9]+$") & (F.element_at(F.split(F.element_at(F.split("path", ","), -1), ":"), 1).cast("long") == F.col("depth")), F.regexp_replace("path", ",?[0-9]+:-?[0-9]+$", "")).otherwise(F.col("path"))
    whole = whole.select("conv_id", *key, F.coalesce("up_print", F.lit(0).cast("long")).alias("up_print"), F.when(F.col("path") == "", "").otherwise(up_path).alias("up_path"), "words", "role", "text")
    last = F.struct("role", "text")
    nodes = whole.groupBy(*key).agg(F.min("conv_id").alias("chain"), F.count(F.lit(1)).alias("n_convs"), F.first("up_print").alias("up_print"), F.first("up_path").alias("up_path"), F.first("words").alias("words"), F.min(last).alias("last"))
    root = everyone.agg(F.min("conv_id").alias("chain"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("print"), F.lit("").alias("path"), "chain", "n_convs", F.lit(None).cast("long").alias("up_print"), F.lit(None).cast("string").alias("up_path"), F.lit(0).cast("long").alias("words"), F.lit(None).cast("struct<role:string,text:string>").alias("last"))
    nodes = written(nodes.unionByName(root))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_print").alias("print"), F.col("up_path").alias("path")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    nodes = written(nodes.withColumn("leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("words")))
    # A chain's first node hangs on a node of another chain; every other node on its own chain.
    tops = nodes.groupBy("chain").agg(F.min("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    tops = tops.join(nodes.select("chain", "depth", "up_print", "up_path"), ["chain", "depth"])
    above = nodes.select(F.col("chain").alias("up"), (F.col("depth") + 1).alias("depth"), F.col("print").alias("up_print"), F.col("path").alias("up_path"))
    tops = written(tops.join(above, ["depth", "up_print", "up_path"], "left").select("chain", "depth", "up", "leaves", "saved"))
    sums = _rolled_up(tops.select("chain", "up", "leaves", "saved"))
    # What hangs on a node is added to it; then sums run down its chain.
    hung = tops.where("up is not null").select("chain", "up", "depth").join(sums.select("chain", "leaves", "saved"), "chain").groupBy(F.col("up").alias("chain"), (F.col("depth") - 1).alias("depth")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
    summed = nodes.join(hung, ["chain", "depth"], "left").join(tops.select("chain", F.col("depth").alias("_top"), "up"), "chain")
    summed = summed.select("chain", *key[:1], "print", "path", F.when(F.col("depth") == F.col("_top"), F.col("up")).otherwise(F.col("chain")).alias("parent"), "n_convs", "n_children", (F.col("leaves") + F.coalesce("_l", F.lit(0).cast("long"))).alias("leaves"), (F.col("saved") + F.coalesce("_s", F.lit(0).cast("long"))).alias("saved"), "last")
    summed = _down_chains(summed)
    finals = whole.groupBy("conv_id").agg(F.max(F.struct(*key)).alias("end"))
    finals = everyone.join(finals, "conv_id", "left").select("conv_id", F.coalesce("end.depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("end.print", F.lit(0).cast("long")).alias("print"), F.coalesce("end.path", F.lit("")).alias("path"))
    return summed.join(_hashed(finals, key), key, "left").select(
        F.col("chain").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), F.col("last.role").alias("role"), F.col("last.text").alias("text"),
    )


def grafted(df: DataFrame, family: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like the first of their family, and the ids of all.

    family and heads are columns of conv_id: the conversation whose first
    `heads` turns (at most `most`) take the place of the own first ones. Own
    turns after these stay, if there are any.
    """
    rows = scanned(turns(df), ["turn", "role", "text"]).drop("print", "turn", "t")
    rows = written(rows)
    ids = written(rows.select("conv_id").distinct())
    first = rows.where(F.col("depth") <= most).select(F.col("conv_id").alias("family"), F.col("depth").alias("turn"), "role", "text")
    theirs = ids.withColumn("family", family).withColumn("heads", heads).join(first.join(ids.select(family.alias("family")).distinct(), "family", "left_semi"), "family").where("turn <= heads")
    own = rows.where(F.col("depth") > heads).select("conv_id", F.col("depth").alias("turn"), "role", "text")
    return own.unionByName(theirs.select("conv_id", "turn", "role", "text")), ids
