"""Live capture of sessions: who takes part, how much they bring, and what was said before, kept in state.

    query = sessions.captured_to(stream, folder, checkpoint)

A stream has rows (session, person_id, id, text, at). What has no session, no
person or a blank text is no capture and is left out. State is kept for each
session, person and one of PARTS parts of titles, so a person who brings a
third of all rows is spread over as many tasks. It has the ids that came, so a
row that is delivered again counts once; the first record of each normalised
title; and counters. A late row counts as any other, and is a duplicate if its
title came before it, whatever their times; of rows that come together the one
of the earliest time is first, null times before all, ties by id.

A part of a session that nothing came to for `quiet` hours (of the cluster's
clock, looked at when a batch with rows runs) is forgotten, so that state does
not grow with all sessions that ever were: its counters are in the table already, and those of what comes later are
added to them; a title that comes again then is first again.

Each micro-batch adds its records to table `captured` and sets its participants
in table `parts` below folder, once, also if it is run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from quern.functions import text as T
from quern.operators.lineage import stored
from quern.sources.log import TableLog

#: Parts that the titles of a person in a session are dealt to; hours after which a quiet part is forgotten.
PARTS, QUIET = 16, 12.0
#: Settings of the query: the state store that it needs, and no batches without rows, which would follow each other for ever as the clock goes on.
_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_RECORD = "id string, text string, at long, first_id string, is_duplicate boolean"
_COUNTS = "epoch long, n long, titles long, joined long, active long"
_TYPES = {"long": "Int64", "int": "int32", "boolean": "boolean"}
_OUT = f"session string, person_id string, part int, {_RECORD}, {_COUNTS}"


def capturable(stream: DataFrame) -> DataFrame:
    """(session, person_id, id, text, at, title) of rows that are captures, their texts trimmed."""
    text = F.regexp_replace("text", f"^{T.SPACE}+|{T.SPACE}+$", "")
    out = stream.select(F.col("session").cast("string"), F.col("person_id").cast("string"), F.col("id").cast("string"), text.alias("text"), F.unix_micros(F.col("at").cast("timestamp")).alias("at"))
    return out.where("session is not null and coalesce(person_id, '') <> '' and text <> ''").withColumn("title", T.normalize_title(F.col("text")))


class _Part(StatefulProcessor):
    """A session's person and part of titles."""

    def __init__(self, quiet: int):
        self.quiet = quiet

    def init(self, handle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "id string", "seen boolean")
        self.first = handle.getMapState("first", "title string", "id string")
        self.counts = handle.getValueState("counts", _COUNTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = timerValues.getCurrentProcessingTimeInMs(), []
        # Rows of one key and micro-batch.
        t = pd.concat([r for r in rows if len(r)]).astype({"at": "Int64"}).sort_values(["at", "id"], na_position="first", kind="stable")
        epoch, n, titles, joined, active = self.counts.get() or (now, 0, 0, None, None)
        for one, text, at, title in zip(t["id"], t["text"], t["at"], t["title"], strict=True):
            one, at = None if pd.isna(one) else one, None if pd.isna(at) else int(at)
            if one is not None:
                if self.ids.containsKey((one,)):
                    continue
                self.ids.updateValue((one,), (True,))
            again = self.first.containsKey((title,))
            if not again:
                self.first.updateValue((title,), (one,))
            out.append((*key, one, text, at, self.first.getValue((title,))[0] if again else one, again, *[None] * 5))
            n, titles = n + 1, titles + (not again)
            if at is not None:
                joined, active = at if joined is None else min(joined, at), at if active is None else max(active, at)
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + self.quiet)
        self.counts.update((epoch, n, titles, joined, active))
        if out:
            out.append((*key, *[None] * 5, epoch, n, titles, joined, active))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.ids, self.first, self.counts):
            state.clear()
        yield _frame([])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    columns = dict(c.split(" ") for c in _OUT.split(", "))
    out = pd.DataFrame(rows, columns=list(columns), dtype=object)
    return out.astype({name: _TYPES[kind] for name, kind in columns.items() if kind in _TYPES})


def captured(stream: DataFrame, quiet: float = QUIET, parts: int = PARTS) -> DataFrame:
    """Records with is_duplicate and first_id, and after those of a part a row with its counters (n is null in records)."""
    keyed = capturable(stream).withColumn("part", F.pmod(F.xxhash64("title"), F.lit(parts)).cast("int"))
    return keyed.groupBy("session", "person_id", "part").transformWithStateInPandas(_Part(int(quiet * 3_600_000)), _OUT, "Update", "ProcessingTime")


def captured_to(stream: DataFrame, folder: str, checkpoint: str, quiet: float = QUIET, parts: int = PARTS) -> StreamingQuery:
    """Capture what is there now into the tables below folder, then stop; called again, it goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        # State is gone through once: two tables are made of what it gives.
        both, tables = stored(batch), TableLog(batch.sparkSession, folder)
        time = lambda c: F.timestamp_micros(c).alias(c)
        records = both.where("n is null").select("session", "person_id", "id", "text", time("at"), "first_id", "is_duplicate")
        tables.append({"captured": records}, (f"{checkpoint}/captured", number))
        counts = both.where("n is not null").select("session", "person_id", "part", "epoch", "n", "titles", time("joined"), time("active"))
        tables.upsert("parts", counts, ["session", "person_id", "part", "epoch"], (f"{checkpoint}/parts", number))

    spark = stream.sparkSession
    was = {name: spark.conf.get(name) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)  # a query keeps what it was started with
    try:
        return captured(stream, quiet, parts).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in was.items():
            spark.conf.set(name, value)


def participants(spark, folder: str) -> DataFrame:
    """(session, person_id, n, titles, joined, active): records and different titles of each participant, and their first and last time."""
    parts = TableLog(spark, folder).read("parts")
    sums = [F.sum(c).alias(c) for c in ("n", "titles")] + [F.min("joined").alias("joined"), F.max("active").alias("active")]
    return parts.groupBy("session", "person_id").agg(*sums)


def last_active(taking_part: DataFrame) -> DataFrame:
    """(person_id, last_active) over all sessions."""
    return taking_part.groupBy("person_id").agg(F.max("active").alias("last_active"))


def counters(taking_part: DataFrame, persons: DataFrame) -> DataFrame:
    """(session, person, n) of participants, persons of one name (person_id, person) together; a person who is not known keeps the id as name."""
    named = taking_part.join(persons.select("person_id", "person"), "person_id", "left")
    return named.groupBy("session", F.coalesce("person", "person_id").alias("person")).agg(F.sum("n").alias("n"))
