"""From rows of a spreadsheet to records: preview, owners, persons, tags.

Rows are as sources.readers.spreadsheets gives them, all fields text, with an
`ordinal` for their place in the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Fixed value: the owner of rows without one.
UNASSIGNED = "Ej tilldelad"
#: Characters of a description that a record keeps.
DESCRIPTION = 500
TAG_FIELDS = ["support_type", "priority", "product"]


def owner(df: DataFrame) -> Column:
    return T.first_text(df["owner"], F.lit(UNASSIGNED))


def preview(rows: DataFrame) -> DataFrame:
    """(kind, value, n): all rows, and the rows of each owner, account, status and type; what is empty does not count.

    A row's type is its kind of support, else its kind of case.
    """
    kinds = {"owner": F.col("owner"), "account": F.col("account"), "status": F.col("status"), "type": T.first_text(F.col("support_type"), F.col("case_type"))}
    each = F.array(F.struct(F.lit("rows").alias("kind"), F.lit("").alias("value")), *[F.struct(F.lit(k).alias("kind"), F.nullif(c, F.lit("")).alias("value")) for k, c in kinds.items()])
    values = rows.select(F.explode(each).alias("v")).select("v.kind", "v.value").where("value is not null")
    return values.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))


def sample(rows: DataFrame, k: int = 5) -> DataFrame:
    """The first k rows."""
    return rows.orderBy("ordinal").limit(k).select("case_number", "title", "owner", "account", "status", "priority")


def without_owners(rows: DataFrame, excluded: list[str]) -> DataFrame:
    return rows.where(~F.coalesce("owner", F.lit("")).isin(excluded)) if excluded else rows


def missing_persons(rows: DataFrame, persons: DataFrame) -> DataFrame:
    """(name, sort_order) of owners that persons (name) lacks, numbered from 1 as they first occur."""
    names = rows.groupBy(owner(rows).alias("name")).agg(F.min("ordinal").alias("first")).join(persons.select("name").distinct(), "name", "left_anti")
    # A row per new person: one task can number them.
    return names.select("name", F.row_number().over(Window.orderBy("first", "name")).cast("long").alias("sort_order"))


def content(df: DataFrame) -> Column:
    more = F.nullif(F.substring(df["description"], 1, DESCRIPTION), F.lit(""))
    return F.concat_ws("\n", df["title"], more)


def records(rows: DataFrame, persons: DataFrame, now: Column) -> DataFrame:
    """(ordinal, person_id, text, customer, created_at) of every row; persons is (person_id, name) and holds all owners."""
    own = rows.select("ordinal", owner(rows).alias("name"), content(rows).alias("text"), F.nullif("account", F.lit("")).alias("customer"), F.coalesce(F.try_to_timestamp(F.nullif("created_at", F.lit(""))), now).alias("created_at"))
    # The least id of persons with one name.
    return own.join(persons.groupBy("name").agg(F.min("person_id").alias("person_id")), "name").select("ordinal", "person_id", "text", "customer", "created_at")


def tag_rows(rows: DataFrame) -> DataFrame:
    """(ordinal, tag) of what a row says on support, priority and product."""
    return rows.select("ordinal", F.explode(F.array(*[F.nullif(c, F.lit("")) for c in TAG_FIELDS])).alias("tag")).where("tag is not null").distinct()


def touched(persons: DataFrame, active: DataFrame, now: Column) -> DataFrame:
    """persons with last_active_at now for those in active (person_id)."""
    hit = active.select("person_id").distinct().withColumn("_hit", F.lit(True))
    return persons.join(hit, "person_id", "left").withColumn("last_active_at", F.when(F.col("_hit"), now).otherwise(F.col("last_active_at"))).drop("_hit")


def team_persons(teams: DataFrame, memberships: DataFrame, persons: DataFrame) -> DataFrame:
    """Each person of any team of a workspace once, in the first team by sort order: teams (team_id, team_order), memberships (team_id, person_id, sort_order)."""
    first = teams.join(memberships, "team_id").groupBy("person_id").agg(F.min(F.struct("team_order", "team_id", "sort_order")).alias("f"))
    return first.select("person_id", "f.team_id").join(persons, "person_id")
