"""Records: effective text, classes, duplicates within a batch, and the core that is left.

A frame of records has id, text, person, org, batch, tags (array), date and
ordinal (the input order: newest first, then id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import relational


def with_ordinal(df: DataFrame) -> DataFrame:
    """ordinal sorts as the input order does: newest first, equal dates by id."""
    return df.withColumn("ordinal", F.struct((-F.unix_micros("date")).alias("age"), F.col("id").alias("id")))


def scan(challenges: DataFrame, persons: DataFrame, sessions: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """Records with their person, session and tags, newest first.

    challenges is (id, person_id, session_id, import_id, raw, normalized,
    created_at, workspace), persons (person_id, person, org), sessions
    (session_id, started_at), links (id, tag_id), tags (tag_id, name). A record
    without a person is left out; one without a session keeps its own date.
    """
    df = challenges.join(persons.select("person_id", "person", "org"), "person_id").join(sessions.select("session_id", "started_at"), "session_id", "left")
    df = relational.tagged(df, links, tags)
    out = df.select(
        "id", T.first_text(F.col("normalized"), F.col("raw")).alias("text"), "person", "org", batch_key(F.col("session_id"), F.col("import_id"), F.col("id")).alias("batch"), "tags",
        F.coalesce("started_at", "created_at").alias("date"), F.struct((-F.unix_micros("created_at")).alias("age"), F.col("id").alias("id")).alias("ordinal"), "workspace",
    )
    return out


def unnormalised(df: DataFrame) -> DataFrame:
    """Records that have no normalised text yet."""
    return df.where(F.col("normalized").isNull())


def embedding_text(text: Column, tags: Column) -> Column:
    """What is embedded of a record: its text, and its tags in brackets. The person is no part of it."""
    return F.when(F.size(tags) > 0, F.concat(text, F.lit(" ["), F.array_join(tags, ", "), F.lit("]"))).otherwise(text)


def open_counts(df: DataFrame, person: str = "person") -> DataFrame:
    """(person, open, other) of records (person, status); also the split of a person's records in two."""
    return df.groupBy(person).agg(F.count_if(F.col("status") == "OPEN").alias("open"), F.count_if(F.coalesce(F.col("status") != "OPEN", F.lit(True))).alias("other"))


def captured_counts(persons: DataFrame, captured: DataFrame) -> DataFrame:
    """(person_id, n) of what was captured under each person's name in a session; 0 for the others."""
    n = captured.groupBy(F.col("person").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return persons.join(n, "name", "left").select("person_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classified(df: DataFrame, tables: dict[str, list[str]] | None = None) -> DataFrame:
    """ticket_class and is_noise of every record."""
    return df.withColumn("ticket_class", T.classify(F.col("text"), tables)).withColumn("is_noise", T.is_noise(F.col("ticket_class")))


def batch_key(session: Column, import_: Column, id_: Column) -> Column:
    """The session, else the import, else the record itself, so that it is no duplicate of anything."""
    return T.first_text(session, import_, id_.cast("string"))


def with_duplicates(df: DataFrame, *by: str) -> DataFrame:
    """is_duplicate: a record (of the same `by`) before it in input order has its batch, person and normalised title.

    The rows of one key may be many (copies), so the first is found by an
    aggregate with map-side combine and joined back, rather than by a window
    that sorts all rows of a key in one task. Titles meet by their SHA-256, for
    a title is a whole text.
    """
    keyed = df.withColumn("_title", F.sha2(T.normalize_title(F.col("text")), 256))
    keys = [*by, "batch", "person", "_title"]
    first = keyed.groupBy(*keys).agg(F.min("ordinal").alias("_first"))
    joined = keyed.alias("a").join(first.alias("f"), [F.col(f"a.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    return joined.select("a.*", (F.col("a.ordinal") > F.col("f._first")).alias("is_duplicate")).drop("_title")


def core(df: DataFrame, *by: str) -> DataFrame:
    """Records that are neither noise nor duplicates (of one `by`)."""
    return with_duplicates(classified(df), *by).where(~F.col("is_noise") & ~F.col("is_duplicate"))


def batch_context(df: DataFrame, k: int = 5) -> DataFrame:
    """Top persons, tags and classes of a classified frame: (kind, value, n), ties by value."""
    parts = [
        df.groupBy(F.lit("person").alias("kind"), F.col("person").alias("value")).agg(F.count(F.lit(1)).alias("n")),
        df.select(F.lit("tag").alias("kind"), F.explode("tags").alias("value")).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")),
    ]
    out = [p.orderBy(F.desc("n"), "value").limit(k) for p in parts]
    # Texts are classified once: noise is counted from the counts of classes, and is 0 where there are no records.
    classes = df.groupBy("ticket_class", "is_noise").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.lit("class").alias("kind"), F.col("ticket_class").alias("value"), "n"), F.struct(F.lit("noise").alias("kind"), F.lit("noise").alias("value"), F.when(F.col("is_noise"), F.col("n")).otherwise(0).alias("n")))
    none = df.sparkSession.range(1).select(F.lit("noise").alias("kind"), F.lit("noise").alias("value"), F.lit(0).cast("long").alias("n"))
    out.append(classes.select(F.inline(both)).union(none).groupBy("kind", "value").agg(F.sum("n").alias("n")))
    return out[0].union(out[1]).union(out[2])
