"""Patterns that a model names: parsed, checked against the records, without those there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import batches, lineage

SCHEMA = "array<struct<title string, description string, patternType string, challengeIds array<string>, suggestion string>>"
#: Kinds of patterns, and what one without a kind is.
KINDS, DEFAULT = ["RECURRING", "ESCALATING", "CROSS_PERSON", "CROSS_TEAM"], "RECURRING"


def is_kind(c: Column) -> Column:
    return F.coalesce(c.isin(KINDS), F.lit(False))


def parsed(replies: DataFrame) -> DataFrame:
    """(batch, status, found) of replies (batch, reply): the objects of the outermost list; none and `failed` where it is no JSON.

    A reply without a list found nothing, which is no failure.
    """
    text = T.json_array(F.col("reply"))
    found = F.from_json(text, SCHEMA, {"mode": "PERMISSIVE"})
    empty = F.from_json(F.lit("[]"), SCHEMA)
    return replies.select("batch", F.when((text == "") | found.isNotNull(), "ok").otherwise("failed").alias("status"), F.coalesce(found, empty).alias("found"))


def detected(replies: DataFrame, records: DataFrame, existing: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(batch, place, title, description, pattern_type, ids, suggestion) of patterns with `least` ids of records (id).

    Ids that no record has are dropped; a pattern whose title existing (title)
    has, whatever the case, is left out.
    """
    each = parsed(replies).select("batch", F.posexplode("found").alias("place", "p")).where("p is not null")
    ids = each.select("batch", "place", F.posexplode("p.challengeIds").alias("pos", "id")).join(records.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    valid = ids.groupBy("batch", "place").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids")).where(F.size("ids") >= least)
    out = each.join(valid, ["batch", "place"]).select(
        "batch", "place", "p.title", "p.description", T.first_text(F.col("p.patternType"), F.lit(DEFAULT)).alias("pattern_type"), "ids", F.nullif("p.suggestion", F.lit("")).alias("suggestion")
    )
    if existing is not None:
        known = existing.select(F.lower("title").alias("_t")).distinct()
        out = out.withColumn("_t", F.lower("title")).join(known, "_t", "left_anti").drop("_t")
    return out


def tables(patterns: DataFrame) -> dict[str, DataFrame]:
    """What is stored of patterns (pattern_id, title, description, pattern_type, ids, suggestion): patterns, links, suggestions."""
    return {
        "patterns": patterns.select("pattern_id", "title", "description", "pattern_type", F.lit("AI_DETECTED").alias("source"), F.lit("EMERGING").alias("status"), F.size("ids").cast("long").alias("occurrence_count")),
        "pattern_links": patterns.select("pattern_id", F.explode(F.array_distinct("ids")).alias("id")),
        "suggestions": patterns.where("suggestion <> ''").select("pattern_id", F.col("suggestion").alias("content"), F.lit("AI_GENERATED").alias("source"), F.lit("PENDING").alias("status")),
    }


def _listed(replies: DataFrame, schema: str) -> DataFrame:
    """(batch, status, found) of replies (batch, reply, status): a failed call failed, a list that is no JSON too; no list is an empty one."""
    text = T.json_array(F.coalesce("reply", F.lit("")))
    found, empty = F.from_json(text, schema, {"mode": "PERMISSIVE"}), F.from_json(F.lit("[]"), schema)
    status = F.when((F.col("status") == "ok") & ((text == "") | found.isNotNull()), "ok").otherwise("failed")
    return replies.select("batch", status.alias("status"), F.coalesce(found, empty).alias("found"))


def pass_status(replies: DataFrame, schema: str) -> DataFrame:
    """(batches, failed) of a pass."""
    return _listed(replies, schema).agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("status") == "failed").alias("failed"))


#: What the replies of the passes hold.
NORMALISED, TAGGED, SUGGESTED = "array<string>", "array<struct<id string, tags array<string>>>", "array<struct<patternIndex int, suggestions array<string>>>"


def normalised(replies: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, content) of records (batch, place, id): the text at a record's place, where there is one that is not empty."""
    each = _listed(replies, NORMALISED).select("batch", F.posexplode("found").alias("place", "content")).where("content <> ''")
    return placed.select("batch", "place", "id").join(each, ["batch", "place"]).select("id", "content")


def tagged(replies: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, name), each once: trimmed names of tags for the records (batch, id) of the reply's own batch."""
    each = _listed(replies, TAGGED).select("batch", F.explode("found").alias("p")).select("batch", F.col("p.id").alias("_id"), F.explode("p.tags").alias("name"))
    own = placed.select("batch", "id").withColumn("_id", F.col("id").cast("string"))
    return own.join(each, ["batch", "_id"]).select("id", T.trim(F.col("name")).alias("name")).distinct()


def tag_tables(found: DataFrame, tags: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """What is stored of tagged() beside tags (name) and links (id, name): names and links that are not there yet, each once."""
    return {
        "tags": found.select("name").distinct().join(tags.select("name"), "name", "left_anti").withColumn("source", F.lit("AI_SUGGESTED")),
        "links": found.join(links.select("id", "name"), ["id", "name"], "left_anti"),
    }


def suggested(replies: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, pos, content, source, status) of patterns (batch, place, id): every suggestion for the pattern at the place that the reply names."""
    each = _listed(replies, SUGGESTED).select("batch", F.posexplode("found").alias("at", "p")).select("batch", "at", F.col("p.patternIndex").alias("place"), F.posexplode("p.suggestions").alias("pos", "content")).where("content is not null")
    out = placed.select("batch", "place", "id").join(each, ["batch", "place"])
    return out.select("id", (F.col("at") * 1000 + F.col("pos")).alias("pos"), "content", F.lit("AI_GENERATED").alias("source"), F.lit("PENDING").alias("status"))


def polished(titles: DataFrame, several: Callable[[list[str]], str], one: Callable[[str], str] | None = None, size: int = 8, most: int = 80) -> DataFrame:
    """(id, title, source) of titles (id, title, prompt): a better title from a call for a batch, else from one for the record alone, else the title itself.

    `several` takes the prompts of a batch and replies with a list of titles,
    `one` takes a prompt and replies with a title. What is empty, too long, or
    missing falls through; only those records are asked for alone. source is
    batch, single or original.
    """
    placed = lineage.stored(batches.assembled(titles.select("id", "title", "prompt"), size))
    made = normalised(batches.asked(placed, several, "prompt"), placed)
    none = F.lit(None).cast("string")
    first = lineage.stored(placed.join(made, "id", "left").select("id", "title", "prompt", T.clean_title(F.col("content"), none, most).alias("new")))
    done = first.where("new is not null").select("id", F.col("new").alias("title"), F.lit("batch").alias("source"))
    rest = first.where("new is null")
    if one is None:
        return done.unionByName(rest.select("id", "title", F.lit("original").alias("source")))

    def run(b: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in b:
            replies = []
            for prompt in part["prompt"]:
                try:
                    replies.append(one(prompt))
                except Exception:
                    replies.append(None)
            yield pd.DataFrame({"id": part["id"], "title": part["title"], "reply": pd.Series(replies, dtype=object, index=part.index)})

    alone = rest.select("id", "title", "prompt").mapInPandas(run, f"id {dict(titles.dtypes)['id']}, title string, reply string")
    better = T.clean_title(F.col("reply"), none, most)
    alone = alone.select("id", "title", better.alias("new"))
    return done.unionByName(alone.select("id", F.coalesce("new", "title").alias("title"), F.when(F.col("new").isNotNull(), "single").otherwise("original").alias("source")))
