"""Joins, upserts and counters of the relational model, without row loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as T


def insert_absent(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing, and the rows of new whose keys it lacks, each key once (its least row)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[c for c in new.columns if c not in keys] or keys))
    fresh = new.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank").join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of new whose keys existing lacks."""
    return new.distinct().join(existing.select(*keys), keys, "left_anti")


#: Characters of a pattern's fields.
LONGEST = {"title": 200, "description": 2000}


def patched(df: DataFrame, patch: DataFrame, key: str, cleared: str = "_cleared") -> DataFrame:
    """df with the values that patch gives (not null) for a key; one patch per key.

    Fields that the patch names in `cleared`, an array column it may have, become
    null. A value longer than LONGEST allows is refused: the old one stays.
    """
    fields = [c for c in patch.columns if c not in (key, cleared)]
    given = [F.when(F.length(c) <= LONGEST[c], F.col(c)).alias(f"_{c}") if c in LONGEST else F.col(c).alias(f"_{c}") for c in fields]
    gone = F.coalesce(F.col(cleared), F.array().cast("array<string>")) if cleared in patch.columns else F.array().cast("array<string>")
    p = patch.select(key, *given, gone.alias("_gone"))
    value = lambda c: F.when(~F.coalesce(F.array_contains("_gone", c), F.lit(False)), F.coalesce(f"_{c}", c)).alias(c)
    return df.join(p, key, "left").select(*[value(c) if c in fields else F.col(c) for c in df.columns])


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """The row with a key; of several the first in the order of all columns."""
    own = df.where(F.col(key) == value)
    return own.orderBy(*[c for c, kind in own.dtypes if not kind.startswith("map")]).limit(1)


def offered_tags(tags: DataFrame, held: DataFrame, typed: str, k: int = 6) -> DataFrame:
    """The first k tags (tag_id, name) whose name holds what was typed, whatever the case, and that held (tag_id) lacks; none if nothing was typed."""
    if not typed.strip():
        return tags.limit(0)
    return tags.where(F.lower("name").contains(typed.lower())).join(held.select("tag_id"), "tag_id", "left_anti").orderBy("name", "tag_id").limit(k)


def checked(df: DataFrame, column: str, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose value is one of the allowed ones, and the others (null included)."""
    good = F.coalesce(F.col(column).isin(allowed), F.lit(False))
    return df.where(good), df.where(~good)


def branches(root: DataFrame, key: str, **parts: DataFrame) -> DataFrame:
    """root with an array for each part: the structs of its rows with the root's key, in their order, empty without any.

    Every part is aggregated before it is joined, so the parts do not multiply
    each other. A root's rows are a list that is shown, and as long as it is.
    """
    out = root
    for name, part in parts.items():
        fields = [c for c in part.columns if c != key]
        listed = part.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        kind = listed.schema[name].dataType
        out = out.join(listed, key, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def tagged(df: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """df with tags, the sorted names that links (id, tag_id) give it; none is an empty array."""
    names = links.join(tags, "tag_id").groupBy("id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return df.join(names, "id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def with_count(df: DataFrame, child: DataFrame, key: str, parent_key: str, name: str) -> DataFrame:
    """df with how many rows of child point at it, counted before the join."""
    n = child.groupBy(F.col(parent_key).alias(key)).agg(F.count(F.lit(1)).alias(name))
    return df.join(n, key, "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def next_order(df: DataFrame, group: str, order: str) -> DataFrame:
    """(group, next): one more than the largest order."""
    return df.groupBy(group).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next"))


def moved(links: DataFrame, person: str, team: str) -> DataFrame:
    """links (team, person, sort_order) with one person at the end of a team."""
    rest = links.where(F.col("person") != person)
    last = rest.where(F.col("team") == team).agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("sort_order"))
    return rest.unionByName(last.select(F.lit(team).alias("team"), F.lit(person).alias("person"), F.col("sort_order").cast(links.schema["sort_order"].dataType)))


def cascade(tables: dict[str, DataFrame], gone: DataFrame, order: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """tables without the rows that `gone` (key id, of order[0]'s parent) takes along.

    order holds (table, its id, its foreign key, parent table); a parent's
    deleted ids delete its children's rows.
    """
    dead, out = {order[0][3]: gone}, dict(tables)
    out[order[0][3]] = tables[order[0][3]].join(gone, "id", "left_anti")
    for name, key, foreign, parent in order:
        hit = tables[name].join(dead[parent].select(F.col("id").alias(foreign)), foreign, "left_semi")
        dead[name] = hit.select(F.col(key).alias("id"))
        out[name] = tables[name].join(dead[parent].select(F.col("id").alias(foreign)), foreign, "left_anti")
    return out


def without_orphans(patterns: DataFrame, links: DataFrame) -> DataFrame:
    """Patterns that a link still names, with their number of links."""
    n = links.groupBy(F.col("pattern_id").alias("id")).agg(F.count(F.lit(1)).alias("occurrence_count"))
    return patterns.drop("occurrence_count").join(n, "id")


def meeting_state(status: Column, started: Column, ended: Column, now: Column) -> tuple[Column, Column]:
    """startedAt and endedAt after a change of status."""
    return F.when(status == "ACTIVE", F.coalesce(started, now)).otherwise(started), F.when(status == "COMPLETED", now).otherwise(ended)


def tag_patterns(df: DataFrame, least: int = 3) -> DataFrame:
    """(tag, n, persons, sessions, pattern_type) of tags with `least` persons or sessions; a null session counts for none."""
    each = df.select("id", "person", "session", F.explode("tags").alias("tag"))
    out = each.groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("person").alias("persons"), F.count_distinct("session").alias("sessions"))
    return out.where((F.col("sessions") >= least) | (F.col("persons") >= least)).withColumn("pattern_type", F.when(F.col("persons") >= least, "CROSS_PERSON").otherwise("RECURRING"))


def suggested_tags(df: DataFrame, target: int, tags: DataFrame | None = None, stop: list[str] = fixed.TAG_STOP_WORDS, k: int = 3) -> DataFrame:
    """(tag, score): tags of other records by the words they share with the target's text; ties by tag.

    Where no other record has a tag, the k most used of tags (name), or of the
    records' own tags, come instead, with a score of 0. The target's words are
    one row's; they are joined as a broadcast side.
    """
    others = df.where((F.col("id") != target) & (F.size("tags") > 0))
    own = df.where(F.col("id") == target).select(F.explode(T.words_for_tags(F.col("text"), stop)).alias("word"))
    words = others.select("id", "tags", F.explode(T.words_for_tags(F.col("text"), stop)).alias("word"))
    hits = words.join(F.broadcast(own), "word").groupBy("id", "tags").agg(F.count(F.lit(1)).alias("shared"))
    best = hits.select(F.explode("tags").alias("tag"), "shared").groupBy("tag").agg(F.sum("shared").alias("score")).orderBy(F.desc("score"), "tag").limit(k)
    used = df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    known = used if tags is None else tags.select(F.col("name").alias("tag")).distinct().join(used, "tag", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = known.orderBy(F.desc("n"), "tag").limit(k).select("tag", F.lit(0).cast("long").alias("score"))
    # At most one row says whether there is anything to learn from.
    return best.unionByName(most.join(F.broadcast(others.limit(1).select("id")), F.lit(True), "left_anti"))


def linked_by_prefix(rows: DataFrame, records: DataFrame, size: int = 100) -> DataFrame:
    """(id, tag): rows (person, text, tag) tied to the latest record with the same person and first characters."""
    rank = F.row_number().over(Window.partitionBy("person", "_prefix").orderBy(F.desc("date"), F.desc("id")))
    latest = records.withColumn("_prefix", F.substring("text", 1, size)).withColumn("_rank", rank).where(F.col("_rank") == 1)
    return rows.withColumn("_prefix", F.substring("text", 1, size)).join(latest.select("person", "_prefix", "id"), ["person", "_prefix"]).select("id", "tag").distinct()
