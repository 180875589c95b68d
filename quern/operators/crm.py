"""Counts of customer tickets by category, and evidence for patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def by_category(tickets: DataFrame, fallback: str = "Övrigt") -> DataFrame:
    return tickets.groupBy(T.first_text(F.col("category"), F.lit(fallback)).alias("category")).agg(F.count(F.lit(1)).alias("ticket_count"))


def _pieces(c: Column, most: int = 3) -> Column:
    """All distinct substrings of up to `most` characters, the empty one included."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1)))

    def of(n: int) -> Column:
        return F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))

    each = [of(n) for n in range(1, most + 1)]
    return F.array_distinct(F.concat(F.array(F.lit("")), *each))


def containing(names: DataFrame, parts: DataFrame) -> DataFrame:
    """(whole, part) of names (whole) that hold a part (part).

    Substrings have no equi-key, but a part's first three characters do: they
    are one of the pieces of each name that holds it. An empty part lies in
    every name.
    """
    wholes = names.select("whole", F.explode(_pieces(F.col("whole"))).alias("piece"))
    return wholes.join(parts.select("part", F.substring("part", 1, 3).alias("piece")), "piece").where(F.col("whole").contains(F.col("part"))).select("whole", "part")


def matches(patterns: DataFrame, snapshots: DataFrame, existing: DataFrame, now: Column, days: int = 60) -> DataFrame:
    """(pattern_id, snapshot_id, category) where a tag of the pattern holds the category or lies in it, in lower case.

    patterns is (pattern_id, tag), snapshots (snapshot_id, category, date) and
    existing the pairs there are already. Distinct tags meet distinct
    categories. An empty name matches everything.
    """
    recent = snapshots.where(F.col("date") >= now - F.expr(f"interval {days} days"))
    tags = patterns.select(F.lower("tag").alias("t")).distinct()
    names = recent.select(F.lower("category").alias("c")).distinct()
    holds = containing(tags.select(F.col("t").alias("whole")), names.select(F.col("c").alias("part"))).toDF("t", "c")
    lies = containing(names.select(F.col("c").alias("whole")), tags.select(F.col("t").alias("part"))).toDF("c", "t").select("t", "c")
    out = patterns.withColumn("t", F.lower("tag")).join(holds.union(lies).distinct(), "t").join(recent.withColumn("c", F.lower("category")), "c")
    return out.select("pattern_id", "snapshot_id", "category").distinct().join(existing, ["pattern_id", "snapshot_id"], "left_anti")
