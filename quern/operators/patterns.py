"""Patterns from clusters: titles, scope, trend, confidence, type, evidence, description."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed, scoring
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import set_join


def _words() -> Column:
    """Distinct lower-case words of a text, of more than three characters."""
    return F.array_distinct(F.filter(F.split(F.lower("text"), f"{T.SPACE}+"), lambda w: F.length(w) > 3))


def words_of(members: DataFrame) -> DataFrame:
    """(cluster, id, word) of distinct lower-case words of more than three characters."""
    return members.select("cluster", "id", F.explode(_words()).alias("word"))


def ranked_words(members: DataFrame, share: float) -> DataFrame:
    """(cluster, size, ranked): structs (word, n) of the words in at least the rounded-up share of the members, commonest first; ties by word."""
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    counts = words_of(members).groupBy("cluster", "word").agg(F.count(F.lit(1)).alias("n")).join(sizes, "cluster")
    kept = counts.where(F.col("n") >= F.ceil(F.col("size") * F.lit(share)))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("word"))))
    return kept.groupBy("cluster", "size").agg(F.transform(listed, lambda x: F.struct(x["word"].alias("word"), (-x["k"]).alias("n"))).alias("ranked"))


def common_words(members: DataFrame, share: float, k: int, below_all: bool = False) -> DataFrame:
    """(cluster, words): the k commonest words in at least the rounded-up share of the members (and not in all); ties by word."""
    found = ranked_words(members, share)
    words = F.filter("ranked", lambda x: x["n"] < F.col("size")) if below_all else F.col("ranked")
    return found.select("cluster", F.slice(F.transform(words, lambda x: x["word"]), 1, k).alias("words")).where(F.size("words") > 0)


def _action_counts() -> list[Column]:
    low = F.lower("text")
    return [F.count_if(low.contains(a)).alias(f"a{k}") for k, a in enumerate(fixed.TITLE_ACTIONS)]


def _best_action(size: str, share: float = 0.3) -> Column:
    best = F.array_min(F.array(*[F.struct((-F.col(f"a{k}")).alias("n"), F.lit(k).alias("k"), F.lit(a).alias("word")) for k, a in enumerate(fixed.TITLE_ACTIONS)]))
    return F.when((-best["n"] >= F.ceil(F.col(size) * F.lit(share))) & (best["n"] < 0), best["word"]).alias("action")


def action_words(members: DataFrame, share: float = 0.3) -> DataFrame:
    """(cluster, action): the title action word in most members, if in the rounded-up share of them; ties by list order."""
    counts = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *_action_counts())
    return counts.select("cluster", _best_action("size", share))


def keyword(words: Column, exclude: Column) -> Column:
    """The first word that is neither the excluded one nor an action word; null if there is none."""
    return F.get(F.filter(words, lambda w: (w != F.lower(exclude)) & ~w.isin(fixed.TITLE_ACTIONS)), 0)


def title(topics: Column, action: Column, common: Column, top: Column, count: Column) -> Column:
    """By what there is: a name with an action, a topic, another name or a keyword; two topics; one; common words."""
    names = F.filter(topics, T.is_proper_topic)
    others = F.filter(topics, lambda t: ~T.is_proper_topic(t))
    name, other, second = F.get(names, 0), F.get(others, 0), F.get(names, 1)
    dash = lambda a, b: F.concat_ws(" — ", a, b)
    return (
        F.when(name.isNotNull() & action.isNotNull(), dash(name, action))
        .when(name.isNotNull() & other.isNotNull(), dash(name, other))
        .when(second.isNotNull(), F.concat_ws(" + ", name, second))
        .when(name.isNotNull(), dash(name, keyword(common, name)))
        .when(F.size(topics) >= 2, dash(F.get(topics, 0), F.get(topics, 1)))
        .when(F.size(topics) == 1, dash(F.get(topics, 0), F.coalesce(action, keyword(common, F.get(topics, 0)))))
        .when(F.size(top) > 0, F.array_join(top, " "))
        .otherwise(F.concat(F.lit("Mönster ("), count.cast("string"), F.lit(" ärenden)")))
    )


def evidence(members: DataFrame, texts: DataFrame, order: str, k: int = 3) -> DataFrame:
    """(cluster, pos, id) of the first k members (cluster, id and order) of each cluster, from 1, with what texts has for their ids.

    Only ids are ranked; a cluster of any size sends k rows of each task to the
    window, and texts are joined to what is left.
    """
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(order))
    first = members.select("cluster", "id", order).withColumn("pos", rank).where(F.col("pos") <= k)
    return first.select("cluster", F.col("pos").cast("long").alias("pos"), "id").join(texts, "id")


def scored(members: DataFrame, topics: DataFrame) -> DataFrame:
    """A row per cluster of members (cluster, pos from 0, id, text, person, org, date) with topics (cluster, topics).

    ids, evidence (the first three) and reporters (those who have a name) are in
    the order of pos. Three texts of a cluster and the distinct words of each
    member, of whom clustering leaves few, are collected, in one aggregate: texts
    move once, and none of their words, if members are dealt by cluster.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "id", F.nullif("person", F.lit("")).alias("person"), "date")))
    shown = F.when(F.col("pos") < 3, F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.nullif("person", F.lit("")), F.lit("Okänd")).alias("person")))
    names = lambda c: F.size(F.collect_set(F.nullif(c, F.lit("")))).cast("long")
    base = members.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("count"), names("org").alias("orgs"), names("person").alias("persons"), listed.alias("m"), F.array_sort(F.collect_list(shown)).alias("e"),
        F.array_sort(F.flatten(F.collect_list(_words()))).alias("w"), *_action_counts(),
    )
    out = base.withColumn("action", _best_action("count")).join(topics, "cluster", "left")
    # Equal words stand together: where each begins, and how many there are up to the next.
    out = out.withColumn("at", F.filter(F.transform("w", lambda x, k: F.when((k == 0) | (x != F.get("w", k - 1)), k)), lambda k: k.isNotNull()))
    often = F.transform("at", lambda b, k: F.struct((b - F.coalesce(F.get("at", k + 1), F.size("w"))).alias("k"), F.get("w", b).alias("word")))
    out = out.withColumn("ranked", F.array_sort(F.filter(often, lambda x: -x["k"] >= F.ceil(F.col("count") * F.lit(0.4)))))
    half = F.filter("ranked", lambda x: -x["k"] >= F.ceil(F.col("count") * F.lit(0.5)))
    out = out.withColumn("common", F.transform("ranked", lambda x: x["word"])).withColumn("top", F.slice(F.transform(half, lambda x: x["word"]), 1, 3))
    empty = F.array().cast("array<string>")
    out = out.select(
        "cluster", "count", "orgs", "persons", F.coalesce("topics", empty).alias("topics"), "action", F.coalesce("common", empty).alias("common"), F.coalesce("top", empty).alias("top"),
        F.transform("m", lambda x: x["id"]).alias("ids"), F.transform("e", lambda x: F.struct(x["text"].alias("text"), x["person"].alias("person"))).alias("evidence"),
        F.array_distinct(F.filter(F.transform("m", lambda x: x["person"]), lambda p: p.isNotNull())).alias("reporters"), F.transform("m", lambda x: x["date"]).alias("dates"),
    )
    out = out.withColumn("scope", scoring.scope(F.col("orgs"), F.col("persons"))).withColumn("trend", scoring.trend(F.col("dates")))
    out = out.withColumn("confidence", scoring.confidence(F.col("count"), F.size("topics") > 0)).withColumn("pattern_type", scoring.pattern_type(F.col("scope"), F.col("trend")))
    first = F.nullif(F.array_join(F.slice("topics", 1, 5), ", "), F.lit(""))
    describe = F.concat_ws(
        ". ", F.concat(F.col("count").cast("string"), F.lit(" ärenden")), F.concat(F.lit("Ämnen: "), first), F.concat(F.lit("Scope: "), "scope"), F.concat(F.lit("Trend: "), "trend"),
        F.concat(F.lit("Rapportörer: "), F.array_join(F.slice("reporters", 1, 5), ", ")),
    )
    out = out.withColumn("title", title(F.col("topics"), F.col("action"), F.col("common"), F.col("top"), F.col("count"))).withColumn("description", F.concat(describe, F.lit(".")))
    return out.withColumn("topics", F.slice("topics", 1, 5)).drop("common", "top", "dates", "action")


def by_entities(members: DataFrame, titled: DataFrame) -> DataFrame:
    """A row per cluster of members (cluster, pos from 0, id, text, person, date), described by what they name.

    titled is (cluster, size, systems, title) with systems as structs (name, n).
    The scope counts persons; confidence asks for a system. Evidence is the first
    three members, ids and reporters are in the order of pos, entities the three
    commonest systems. Only three texts of a cluster are collected.
    """
    shown = F.when(F.col("pos") < 3, F.struct("pos", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.nullif("person", F.lit("")), F.lit("Okänd")).alias("person")))
    base = members.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("pos", "id", F.nullif("person", F.lit("")).alias("person"), "date"))).alias("m"), F.array_sort(F.collect_list(shown)).alias("e"))
    people = F.array_distinct(F.filter(F.transform("m", lambda x: x["person"]), lambda p: p.isNotNull()))
    out = base.join(titled, "cluster").select(
        "cluster", "title", F.col("size").alias("count"), F.transform("m", lambda x: x["id"]).alias("ids"), people.alias("reporters"), F.slice("systems", 1, 3).alias("_systems"),
        F.transform("e", lambda x: F.struct(x["text"].alias("text"), x["person"].alias("person"))).alias("evidence"), scoring.trend(F.transform("m", lambda x: x["date"])).alias("trend"),
    )
    out = out.withColumn("scope", scoring.scope(F.lit(0), F.size("reporters"))).withColumn("confidence", scoring.confidence(F.col("count"), F.size("_systems") > 0))
    out = out.withColumn("pattern_type", scoring.pattern_type(F.col("scope"), F.col("trend"))).withColumn("entities", F.transform("_systems", lambda x: x["name"]))
    listed = F.array_join(F.transform("_systems", lambda x: F.concat(x["name"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ")
    describe = F.concat_ws(
        ". ", F.concat(F.col("count").cast("string"), F.lit(" ärenden")), F.concat(F.lit("System: "), F.nullif(listed, F.lit(""))), F.concat(F.lit("Scope: "), "scope"),
        F.concat(F.lit("Trend: "), "trend"), F.concat(F.lit("Rapportörer: "), F.array_join(F.slice("reporters", 1, 5), ", ")),
    )
    return out.withColumn("description", F.concat(describe, F.lit("."))).drop("_systems")


def numbered_titles(df: DataFrame, order: list[str], title_: str = "title", person: str = "person", by: tuple[str, ...] = ()) -> DataFrame:
    """Titles that several rows (of one `by`) share get the person (first two) or their number (later ones)."""
    w = Window.partitionBy(*by, title_)
    k, n = F.row_number().over(w.orderBy(*order)), F.count(F.lit(1)).over(w)
    new = F.when(n == 1, F.col(title_)).when((k <= 2) & (F.col(person) != ""), F.concat(title_, F.lit(" ("), person, F.lit(")"))).otherwise(F.concat(F.col(title_), F.lit(" #"), k.cast("string")))
    return df.withColumn("_new", new).drop(title_).withColumnRenamed("_new", title_)


def centroids(members: DataFrame) -> DataFrame:
    """(cluster, centroid) of members (cluster, vector); members without a vector do not count."""
    each = members.where(F.col("vector").isNotNull()).select("cluster", F.posexplode("vector").alias("pos", "x"))
    means = each.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))


def linkage(members: DataFrame) -> DataFrame:
    """(cluster, linkage, n): the average cosine of all n pairs of members (cluster, vector), without making pairs.

    The cosines of all ordered pairs add up to the squared length of the sum of
    the unit vectors; a zero vector has none with any other.
    """
    v = members.where(F.col("vector").isNotNull()).withColumn("_size", F.sqrt(V.dot(F.col("vector"), F.col("vector"))))
    unit = v.where("_size > 0").select("cluster", F.posexplode("vector").alias("pos", "x"), "_size").withColumn("x", F.col("x").cast("double") / F.col("_size"))
    total = unit.groupBy("cluster", "pos").agg(F.sum("x").alias("x")).groupBy("cluster").agg(F.sum(F.col("x") * F.col("x")).alias("square"))
    count = v.groupBy("cluster").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("_size") > 0).alias("own"))
    out = count.where("k > 1").join(total, "cluster", "left").withColumn("n", (F.col("k") * (F.col("k") - 1) / 2).cast("long"))
    return out.select("cluster", ((F.coalesce("square", F.lit(0.0)) - F.col("own")) / (2 * F.col("n"))).alias("linkage"), "n")


def merge_candidates(patterns: DataFrame, most: int = fixed.MERGE_SIZE, similarity: float = fixed.MERGE_CENTROID, overlap: float = fixed.MERGE_TOPICS) -> DataFrame:
    """(workspace, i, j, similarity, overlap) of patterns (workspace, cluster, centroid, topics, size) of a workspace that may merge.

    Pairs come from a join of similar sets (set_join), by a pattern's rarest
    topics: a topic that very many patterns share makes no pair of all of them.
    """
    p = patterns.select("workspace", "cluster", "centroid", "topics", "size").withColumn("_own", F.transform("topics", F.lower))
    pairs = set_join.similar(p, max(overlap, 1e-9), "workspace", "cluster", "_own")
    a, b = p.select("workspace", "cluster", "centroid", "size").toDF("workspace", "i", "ci", "si"), p.select("workspace", "cluster", "centroid", "size").toDF("workspace", "j", "cj", "sj")
    out = pairs.join(a, ["workspace", "i"]).join(b, ["workspace", "j"]).where(F.col("si") + F.col("sj") <= most)
    return out.select("workspace", "i", "j", V.cosine(F.col("ci"), F.col("cj")).alias("similarity"), "overlap").where(F.col("similarity") >= similarity)
