"""Sharding by weighted rendezvous hashing.

Every record key draws one number for each shard from a hash of (key, shard),
weighs it with the shard's weight, and goes to the shard with the best draw.
A shard's draws do not depend on which other shards exist, so a new shard takes
rows only into itself and a removed shard's rows alone move.

All of it is DataFrame functions. Slots within a shard are numbered in two
steps, so that no task sees more than a sub-bucket of a shard: rows are ranked
inside (shard, sub-bucket), and the counts of the sub-buckets, a table of
shards x sub-buckets rows at most, give each its first slot. There are as many
sub-buckets as the count of rows asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sub-buckets of a shard at least, rows that one should hold, and rows up to which a side is broadcast.
SUB_BUCKETS, SUB_ROWS, SMALL = 64, 250_000, 1_000_000


def number(*parts: Column) -> Column:
    """52 bits that depend on the parts' texts alone, whatever engine computes them: the head of an MD5."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def draw(key: Column, shard: Column, weight: Column) -> Column:
    """The draw of a key for a shard: -ln(u) / weight with u in (0, 1); infinite for weight 0."""
    u = (number(key, shard).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(float("inf")))


def rendezvous(key: Column, weights: list[float]) -> Column:
    """(draw, shard): the shard, an int from 0, with the best weighted draw for key, and that draw.

    The least draw wins, which gives each shard its weight's share of the keys.
    A shard of weight 0 takes nothing. A null key counts as an empty one.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    table = F.array(*[F.lit(float(w)) for w in weights])
    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return F.array_min(F.transform(shards, lambda s: F.struct(draw(key, s, F.element_at(table, s + 1)).alias("draw"), s.alias("shard"))))


def shard(df: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", sub_buckets: int | None = None, next_weight: float | None = None) -> DataFrame:
    """Each row of df with its size, checksum, shard, slot and the shard it would have with one more shard.

    Returns key, size (UTF-8 bytes of the text plus 16), text_crc32, law, shard,
    slot (gapless from 0 in each shard) and grown_shard. A null text has no
    bytes and the checksum 0. Rows whose key is null or repeated keep a row
    each: equal keys share a shard, and all null keys do. An empty table gives
    an empty result. Other columns of df are ignored, whatever their names.
    """
    if sub_buckets is None:
        sub_buckets = max(SUB_BUCKETS, -(-df.count() // (SUB_ROWS * len(weights))))
    more = float(weights[-1] if next_weight is None else next_weight)
    checksum = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = df.select(
        F.col(key).alias(key), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 16).cast("long").alias("size"), checksum.alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("_best"), draw(F.col(key), F.lit(len(weights)), F.lit(more)).alias("_new"),
    )
    # One more shard takes a row only if its own draw is the best.
    rows = rows.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), F.col("_best.shard").cast("int").alias("shard"),
        F.when(F.col("_new") < F.col("_best.draw"), F.lit(len(weights))).otherwise(F.col("_best.shard")).cast("int").alias("grown_shard"),
        F.pmod(number(F.lit("slot"), F.col(key), F.col("text_crc32")), F.lit(sub_buckets)).cast("int").alias("_sub"),
    )
    counts = rows.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    firsts = counts.select("shard", "_sub", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_sub")) - F.col("_n")).alias("_first"))
    ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("shard", "_sub").orderBy(key, "text_crc32", "size")) - 1)
    # firsts holds at most len(weights) * sub_buckets rows.
    firsts = F.broadcast(firsts) if len(weights) * sub_buckets <= SMALL else firsts
    return ranked.join(firsts, ["shard", "_sub"]).select(
        key, "size", "text_crc32", "law", "shard", (F.col("_first") + F.col("_rank")).cast("long").alias("slot"), "grown_shard"
    )
