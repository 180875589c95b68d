"""Streams: live capture, daily counts, deduplication within a batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions import text as T
from quern.operators import batches, records
from quern.operators.lineage import kept, stored
from quern.sources.log import TableLog


def captured(stream: DataFrame) -> DataFrame:
    """Records as they come in, classified; noise stays, so that it can be counted."""
    return records.classified(stream)


def deduplicated(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """The first of each batch, person and normalised title within the watermark."""
    keyed = stream.withColumn("title_key", T.normalize_title(F.col("text"))).withWatermark("date", delay)
    return keyed.dropDuplicatesWithinWatermark(["batch", "person", "title_key"]).drop("title_key")


def daily_counts(stream: DataFrame, at: str = "ts", category: str = "category", delay: str = "1 day") -> DataFrame:
    """(day, category, n) for days whose watermark has passed."""
    days = stream.withWatermark(at, delay).groupBy(F.window(at, "1 day"), category).agg(F.count(F.lit(1)).alias("n"))
    return days.select(F.col("window.start").alias("day"), category, "n")


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what is there now as Parquet, then stop; called again, it goes on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merged_to(stream: DataFrame, folder: str, table: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Insert what comes in and is not there yet, by keys, into a table with a log below folder; then stop.

    A micro-batch writes its new rows alone. One that is run again after a
    restart is known by its number, and does nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        TableLog(batch.sparkSession, folder).insert(table, batch, keys, (checkpoint, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embedded_to(stream: DataFrame, embed: Callable[[list[str]], list[list[float]]], folder: str, checkpoint: str) -> StreamingQuery:
    """Keep vectors (id, signature, vector) below folder: records (id, text) that are new, or whose text is, are embedded; then stop.

    Vectors that change take the place of the old ones in the parts that hold
    them; the other parts stay as they are.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        tables = TableLog(spark, folder)
        held = tables.read("vectors")
        own = batch.withColumn("signature", F.sha2("text", 256)).dropDuplicates(["id"])
        due = own if held is None else own.join(held.select("id", "signature"), ["id", "signature"], "left_anti")
        empty = spark.createDataFrame([], f"id {dict(batch.dtypes)['id']}, vector array<double>")
        # Embedded once: the write reads the rows more than once.
        made = kept(batches.embedded(due.select("id", "text"), embed, empty).join(due.select("id", "signature"), "id").select("id", "signature", "vector"))
        tables.upsert("vectors", made, ["id"], (checkpoint, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tickets_to(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep the last form of every ticket (connection_id, ticket_id, at, category) of a stream of feeds in table tickets below folder; then stop.

    Of forms of a ticket the one of the latest time stays, ties by category;
    tickets without an id are told apart by nothing, so the last one stays.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        keys, form = ["connection_id", "ticket_id"], F.struct("at", "category")
        tables = TableLog(spark, folder)
        # A feed is asked once: the write reads the rows more than once.
        new = stored(batch.groupBy(*keys).agg(F.max(form).alias("_new")))
        held = tables.read("tickets")
        if held is not None:
            n, h = new.alias("n"), held.select(*keys, form.alias("_old")).alias("h")
            same = [F.col(f"n.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
            new = n.join(h, same, "left").select("n.*", "_old").where("_old is null or _new > _old").drop("_old")
        tables.upsert("tickets", new.select(*keys, "_new.at", "_new.category"), keys, (checkpoint, number))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
