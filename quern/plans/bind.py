"""The model's frames over the driver's tables, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Records over documents, as SQL; the frame below is the same.
TICKETS = """tickets AS (SELECT doc_id AS id, text, 'p' || CAST(doc_id % 12 AS VARCHAR) AS person, source AS org, source AS batch, [lang, source] AS tags,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS date FROM documents)"""
NOW = "2024-06-01 00:00:00"


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with SQL for the same rows."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores where its files make fewer partitions than there are cores; else df itself, without a shuffle.

    Text costs far more to analyse than to move, and a small file of one row
    group is one partition.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over documents: id, text, person, org, batch, tags, date, ordinal, workspace."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    date = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("doc_id") % 60) * F.lit(86_400_000_000))
    d = d.select(
        F.col("doc_id").alias("id"), "text", F.concat(F.lit("p"), (F.col("doc_id") % 12).cast("string")).alias("person"), F.col("source").alias("org"), F.col("source").alias("batch"),
        F.array("lang", "source").alias("tags"), date.alias("date"), F.col("source").alias("workspace"),
    )
    return records.with_ordinal(d)


def now():
    return F.lit(NOW).cast("timestamp")
