"""Quality of a set of patterns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def coverage(members: DataFrame, core: DataFrame, largest: int = 15) -> DataFrame:
    """One row: covered and core records, patterns, average, largest and smallest size, catch-alls, coverage and orphans in percent."""
    sizes = members.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    s = sizes.agg(F.count(F.lit(1)).alias("patterns"), F.avg("n").alias("avg_size"), F.max("n").alias("max_size"), F.min("n").alias("min_size"), F.count_if(F.col("n") > largest).alias("catch_alls"))
    c = core.select("id").distinct().join(members.select("id", F.lit(1).alias("hit")).distinct(), "id", "left").agg(F.count(F.lit(1)).alias("core"), F.count("hit").alias("covered"))
    # Two single rows side by side.
    return s.join(c, F.lit(True)).withColumn("coverage", F.round(F.col("covered") * 100 / F.col("core"), 1)).withColumn("orphan_rate", F.round(100 - F.col("covered") * 100 / F.col("core"), 1))


def reused(members: DataFrame) -> DataFrame:
    """(id, patterns) of records in more than one pattern."""
    return members.groupBy("id").agg(F.count_distinct("pattern").alias("patterns")).where("patterns > 1")


def lower_median(members: DataFrame) -> DataFrame:
    """The size at half the list of sizes from the largest.

    Sizes are counted first: the running count is over distinct sizes, which are
    few (their sum is at most the count of members).
    """
    sizes = members.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    down = Window.orderBy(F.desc("n"))
    upto = sizes.withColumn("upto", F.sum("k").over(down.rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("k").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    place = F.floor(F.col("total") / 2) + 1
    return upto.where((F.col("upto") >= place) & (F.col("upto") - F.col("k") < place)).select(F.col("n").alias("median_size"))


def overlaps(members: DataFrame, least: float = 0.5) -> DataFrame:
    """(a, b, shared) of patterns that share over `least` of the smaller one."""
    m = members.select("pattern", "id").distinct()
    sizes = m.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    pairs = m.alias("x").join(m.alias("y"), (F.col("x.id") == F.col("y.id")) & (F.col("x.pattern") < F.col("y.pattern"))).groupBy(F.col("x.pattern").alias("a"), F.col("y.pattern").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    return pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(F.col("shared") / F.least("na", "nb") > least).select("a", "b", "shared")


def distribution(patterns: DataFrame, column: str) -> DataFrame:
    """(value, n) of a column of patterns; a row per value, of which there are few."""
    return patterns.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def count_map(patterns: DataFrame, column: str) -> DataFrame:
    """One row: the map from value to count of a column with few values."""
    counts = distribution(patterns, column).where("value is not null")
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias("counts"))


def _meets(titles: DataFrame, expected: DataFrame) -> DataFrame:
    """(expected, pattern) where a title holds one of the keywords, whatever the case. Both are lists of one scenario."""
    words = expected.select("expected", F.explode("keywords").alias("word")).select("expected", F.lower("word").alias("word"))
    return titles.join(words, F.lower("title").contains(F.col("word"))).select("expected", "pattern").distinct()


def matched(detected: DataFrame, expected: DataFrame) -> DataFrame:
    """(expected, pattern): a keyword is in the title, or the pattern has all required ids.

    detected is (pattern, title, ids), expected (expected, keywords, include); a
    pattern that requires nothing is met by every pattern.
    """
    all_in = detected.join(expected, F.size(F.array_except("include", "ids")) == 0).select("expected", "pattern")
    return _meets(detected, expected).union(all_in).distinct()


def scenario_parts(detected: DataFrame, expected: DataFrame, records: DataFrame, low: int, high: int) -> DataFrame:
    """One row of the six parts of a scenario's score, each in 0 .. 1, and their weighed sum.

    detected is (pattern, title, ids, pattern_type), expected (expected,
    keywords, include, exclude), records (id); low and high bound the count of
    patterns. A scenario is small, and its parts are single rows.
    """
    ids = detected.select("pattern", F.explode("ids").alias("id"))
    unknown = ids.join(records.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    named = _meets(detected, expected)
    stuffed = named.join(expected.select("expected", F.explode("exclude").alias("id")), "expected").join(ids.distinct(), ["pattern", "id"], "left_semi").agg(F.count(F.lit(1)).alias("stuffed"))
    count = detected.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("links"), F.count_if(F.col("pattern_type").isin("RECURRING", "ESCALATING", "CROSS_PERSON", "CROSS_TEAM")).alias("typed"))
    wanted, hit = expected.agg(F.count(F.lit(1)).alias("wanted")), matched(detected, expected).agg(F.count_distinct("expected").alias("hit"))
    precise, double = named.agg(F.count_distinct("pattern").alias("precise")), overlaps(ids).agg(F.count(F.lit(1)).alias("double"))
    one = count
    for part in (unknown, stuffed, wanted, hit, precise, double):
        one = one.join(F.broadcast(part), F.lit(True))
    n, none = F.col("n"), F.lit(1.0)
    share = lambda a, b, empty: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(empty)
    parts = one.select(
        F.when(n.between(low, high), none).when(n < low, n / low).otherwise(F.lit(float(high)) / n).alias("count_fit"),
        share("hit", "wanted", none).alias("matched"),
        share("precise", "n", F.when(F.col("wanted") == 0, 1.0).otherwise(0.0)).alias("precise"),
        F.when(F.col("links") > 0, F.greatest(F.lit(0.0), 1 - (F.col("unknown") + F.col("stuffed")) / F.col("links"))).otherwise(none).alias("unstuffed"),
        share("typed", "n", none).alias("type_fit"),
        F.when(n > 1, F.greatest(F.lit(0.0), 1 - F.col("double") / (n - 1))).otherwise(none).alias("no_overlap"),
    )
    return scenario_score(parts)


def scenario_score(found: DataFrame) -> DataFrame:
    """score of rows (count_fit, matched, precise, unstuffed, type_fit, no_overlap), each in 0 .. 1, by fixed weights."""
    weights = {"count_fit": 0.1, "matched": 0.25, "precise": 0.2, "unstuffed": 0.2, "type_fit": 0.15, "no_overlap": 0.1}
    return found.withColumn("score", sum((F.col(k) * w for k, w in weights.items()), F.lit(0.0)))


#: Thresholds that are compared.
THRESHOLDS = [0.36, 0.39, 0.42, 0.45]


def sweep(run: Callable[[float], DataFrame], core: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """A row of coverage() for each threshold; run(threshold) gives the members (pattern, id) it makes."""
    rows = [coverage(run(t), core).withColumn("threshold", F.lit(t)) for t in thresholds]
    return reduce(DataFrame.unionByName, rows)


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the fewest catch-alls, then the most coverage, then the lowest threshold."""
    return sweep.orderBy("catch_alls", F.desc("coverage"), "threshold").limit(1)
