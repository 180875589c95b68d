"""Flags, priority and groupings of patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.functions import text as T


def repetition(members: DataFrame, prefix: int = 30, shortest: int = 10) -> DataFrame:
    """(pattern, most, n) of patterns of three members or more in which one prefix is in three and in half of them."""
    form = F.substring(T.repeated_form(F.col("text")), 1, prefix)
    each = members.select("pattern", F.when(F.length(form) >= shortest, form).alias("prefix"))
    counts = each.groupBy("pattern", "prefix").agg(F.count(F.lit(1)).alias("k"))
    out = counts.groupBy("pattern").agg(F.coalesce(F.max(F.when(F.col("prefix").isNotNull(), F.col("k"))), F.lit(0)).alias("most"), F.sum("k").alias("n"))
    return out.where((F.col("n") >= 3) & (F.col("most") >= 3) & (F.col("most") * 2 >= F.col("n")))


def related(patterns: DataFrame) -> DataFrame:
    """(a, b): patterns (id, title, topics) with the same leading word (over two characters) or half of their topics.

    Both conditions need something equal, so both are equi-joins.
    """
    p = patterns.select("id", T.leading_word(F.col("title")).alias("lead"), F.transform("topics", lambda t: F.lower(T.trim(t))).alias("topics"))
    lead = p.where(F.length("lead") > 2).select("id", "lead")
    same = lead.alias("x").join(lead.alias("y"), (F.col("x.lead") == F.col("y.lead")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    t = p.select("id", "topics", F.explode(F.array_distinct("topics")).alias("t"))
    shared = t.alias("x").join(t.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.id") < F.col("y.id")))
    shared = shared.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.topics").alias("ta"), F.col("y.topics").alias("tb")).distinct()
    # A list's matches over the union of both: as many as the first list has, repeats included.
    ratio = F.size(F.filter("ta", lambda x: F.array_contains(F.col("tb"), x))) / F.size(F.array_union("ta", "tb"))
    return same.union(shared.where(ratio >= 0.5).select("a", "b")).distinct()


def trends(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, n, trend) by the timestamps of each key, in two aggregates; a null one does not count.

    No list of a key's dates is made, so a key may have any number of them.
    """
    each = df.where(F.col(at).isNotNull()).select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("_at"))
    ends = each.groupBy(*keys).agg(F.min("_at").alias("_low"), F.max("_at").alias("_high"))
    both = each.alias("e").join(ends.alias("b"), [F.col(f"e.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = both.select("e.*", "b._low", "b._high")
    out = both.groupBy(*keys, "_low", "_high").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("_at") - F.col("_low")) * 2 <= F.col("_high") - F.col("_low")).alias("_early"))
    return out.select(*keys, "n", scoring.trend_of(F.col("n"), F.col("_high") - F.col("_low"), F.col("_early")).alias("trend"))


def crossing(patterns: DataFrame) -> DataFrame:
    """(id) of patterns that related() pairs with some other, without the pairs of alike ones.

    Patterns with one leading word, or with the same list of topics, are counted;
    only different lists that share a topic meet.
    """
    p = patterns.select("id", T.leading_word(F.col("title")).alias("lead"), F.transform("topics", lambda t: F.lower(T.trim(t))).alias("topics"))
    many = p.where(F.length("lead") > 2).groupBy("lead").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lead")
    lists = p.where(F.size("topics") > 0).groupBy("topics").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    t = lists.select("topics", "low", "high", F.explode(F.array_distinct("topics")).alias("t"))
    met = t.alias("x").join(t.alias("y"), (F.col("x.t") == F.col("y.t")) & (F.col("x.topics") != F.col("y.topics")))
    met = met.select(F.col("x.topics").alias("topics"), F.col("y.topics").alias("other"), "y.low", "y.high").distinct()
    # Of two patterns the repeats of the first one's list count: a pattern has a match after it, or before it, or both.
    ratio = lambda a, b: F.size(F.filter(a, lambda x: F.array_contains(F.col(b), x))) / F.size(F.array_union(a, b))
    ends = met.groupBy("topics").agg(F.max(F.when(ratio("topics", "other") >= 0.5, F.col("high"))).alias("after"), F.min(F.when(ratio("other", "topics") >= 0.5, F.col("low"))).alias("before"))
    near = p.join(ends, "topics").where((F.col("id") < F.col("after")) | (F.col("id") > F.col("before"))).select("id")
    alike = p.join(lists.where("n > 1"), "topics", "left_semi").select("id")
    return p.join(many, "lead", "left_semi").select("id").union(alike).union(near).distinct()


def flags(patterns: DataFrame, members: DataFrame) -> DataFrame:
    """(id, flag): repetition, else cross-pattern; patterns without one are left out."""
    cross = crossing(patterns)
    again = repetition(members).select(F.col("pattern").alias("id"), F.lit("repetition").alias("flag"))
    return again.union(cross.join(again, "id", "left_anti").select("id", F.lit("cross-pattern").alias("flag")))


def priorities(patterns: DataFrame, flagged: DataFrame) -> DataFrame:
    """patterns (id, pattern_type, count, status) with flag, score and level."""
    out = patterns.join(flagged, "id", "left")
    out = out.withColumn("score", scoring.priority(F.col("flag"), F.col("pattern_type"), F.col("count"), F.col("status")))
    return out.withColumn("level", scoring.level(F.col("score")))


def commonest(members: DataFrame, value: str, floor: str | None = None) -> DataFrame:
    """(pattern, value, n): the commonest value of each pattern, ties by value; with floor, only above the count of nulls."""
    counts = members.where(F.col(value).isNotNull()).groupBy("pattern", value).agg(F.count(F.lit(1)).alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("pattern").orderBy(F.desc("n"), value))).where("rank = 1").drop("rank")
    if floor:
        none = members.groupBy("pattern").agg(F.count_if(F.col(value).isNull()).alias("none"))
        best = best.join(none, "pattern").where("n > none").drop("none")
    return best


#: Levels of priority in the order in which they are shown.
LEVELS = ["critical", "high", "medium", "low"]


def in_level_order(patterns: DataFrame) -> DataFrame:
    """patterns (level, score, id) with their place: levels as they are shown, then the highest score, ties by id."""
    place = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    w = Window.partitionBy("level").orderBy(F.desc("score"), "id")
    return patterns.where(F.col("level").isin(LEVELS)).withColumn("group_place", place).withColumn("place", F.row_number().over(w).cast("long"))


def in_tag_order(groups: DataFrame, key: str = "tag") -> DataFrame:
    """groups (a row per tag, null for none) with their place: by Swedish order of letters, without a tag last."""
    w = Window.orderBy(F.col(key).isNull(), F.collate(F.col(key), "sv_AI"), F.col(key))
    return groups.withColumn("place", F.row_number().over(w).cast("long"))


def in_import_order(groups: DataFrame) -> DataFrame:
    """groups (a row per import: import_id, date) with their place: newest first, without an import last."""
    w = Window.orderBy(F.col("import_id").isNull(), F.desc_nulls_last("date"), "import_id")
    return groups.withColumn("place", F.row_number().over(w).cast("long"))
