"""Ticket feeds of CRM providers as a Spark data source, for batches and streams.

    spark.dataSource.register(feeds.TicketFeed)
    spark.read.format("ticket_feed").options(provider="ZENDESK", base_url=..., api_key=..., since=..., transport="my.module:fetch").load()
    spark.read.format("ticket_feed").options(connections=feeds.connections([...]), since=...).load()
    spark.dataSource.register(feeds.TicketStream)
    spark.readStream.format("ticket_stream").options(connections=feeds.connections([...]), since=...).load()

A feed is a chain of pages, each naming the next, so one task reads it; every
connection is a partition of its own. A page that fails for now (429, 500 and
above, no answer) is asked for again, `retries` times (2), after `wait` seconds
(0.5), then twice as long, and so on.

A batch is bounded: at most MOST pages of SIZE tickets of a connection. Rows are
(category, error): a ticket has a category, and a last row has an error if a page
failed; the tickets before it stay. With `connections` rows begin with
connection_id, and each connection ends with a row without category, so that one
without tickets shows, too.

A stream has rows (connection_id, ticket_id, at, category). Its offset is a time for
each connection, up to which tickets were read: a micro-batch reads those of its
span of time, so one that is run again reads the same span, and a restart goes on
where the last one ended. A connection that is new starts at `since`. Tickets
without a time come with that start. The end is now less `lag` seconds (60), for
feeds show tickets late, or `until`. No ticket is left out: a page that keeps
failing, or more than STREAM_MOST pages, fail the query, which can be started
again. A ticket that changes comes again; `capture.tickets_to` keeps its last form.
HubSpot's list has no filter by time, so all of its pages are read for each span.

`transport` names a function fetch(url, headers) -> (status, JSON), which is
imported where the feed is read; without one, urllib does it.
"""

from __future__ import annotations

import base64
import importlib
import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# Pages and tickets of a page that are read at most, days looked back, and the category of a ticket without one.
MOST, SIZE, DAYS, FALLBACK = 10, 100, 30, "Övrigt"
#: Pages of a connection in one span of a stream, beyond which the query fails.
STREAM_MOST = 10_000


class FeedError(RuntimeError):
    """What a provider, or the way to it, did not give."""


@dataclass(frozen=True)
class Provider:
    """How one provider's pages are asked for and read."""

    name: str
    first: Callable[[str, str], str]
    rows: Callable[[object], list]
    category: Callable[[dict], str | None]
    #: (base, since, page number, page) -> the next page's address, or None.
    following: Callable[[str, str, int, object], str | None]
    #: The time by which a feed is filtered, as text.
    at: Callable[[dict], str | None]
    basic: bool = False
    #: Whether a page with fewer tickets than SIZE is the last, whatever it names.
    short_ends: bool = True

    def headers(self, key: str) -> dict[str, str]:
        own = "Basic " + base64.b64encode(f"{key}:X".encode()).decode() if self.basic else f"Bearer {key}"
        return {"Authorization": own, "Content-Type": "application/json"}


def _desk_page(base: str, since: str, page: int) -> str:
    return f"{base}/api/v2/tickets?updated_since={since}&per_page={SIZE}&page={page}"


def _hub_page(after: str | None = None) -> str:
    more = {"after": after} if after else {}
    return "https://api.hubapi.com/crm/v3/objects/tickets?" + urllib.parse.urlencode({"limit": SIZE, "properties": "hs_pipeline_stage,subject,createdate", **more})


def _hub_next(base: str, since: str, page: int, data) -> str | None:
    after = ((data.get("paging") or {}).get("next") or {}).get("after")
    return _hub_page(after) if after else None


PROVIDERS = {
    "FRESHDESK": Provider("Freshdesk", lambda base, since: _desk_page(base, since, 1), lambda d: d, lambda t: t.get("type"), lambda base, since, page, _: _desk_page(base, since, page + 1), lambda t: t.get("updated_at"), basic=True),
    "ZENDESK": Provider(
        "Zendesk", lambda base, since: f"{base}/api/v2/search.json?query=type:ticket created>{since[:10]}&per_page={SIZE}", lambda d: d["results"], lambda t: next(iter(t.get("tags") or []), None),
        lambda base, since, page, d: d.get("next_page"), lambda t: t.get("created_at"), short_ends=False,
    ),
    "HUBSPOT": Provider("HubSpot", lambda base, since: _hub_page(), lambda d: d["results"], lambda t: (t.get("properties") or {}).get("hs_pipeline_stage"), _hub_next, lambda t: (t.get("properties") or {}).get("createdate")),
}


def _over_http(url: str, headers: dict[str, str]) -> tuple[int, object]:
    try:
        with urllib.request.urlopen(urllib.request.Request(urllib.parse.quote(url, safe=":/?&=%>"), headers=headers), timeout=60) as r:
            return r.status, json.load(r)
    except urllib.error.HTTPError as e:
        return e.code, None


def _page(provider: Provider, url: str, key: str, number: int, fetch: Callable, retries: int, wait: float) -> tuple[list, object]:
    """The tickets of a page, and the page."""
    for k in range(retries + 1):
        try:
            status, data = fetch(url, provider.headers(key))
            if 200 <= status < 300:
                return list(provider.rows(data)), data
            what, again = f"{provider.name} API {status} on page {number}", status == 429 or status >= 500
        except Exception as e:  # the feed is someone else's; what went wrong is data
            what, again = f"{provider.name}: {e}", True
        if not again:
            break
        if k < retries:
            time.sleep(wait * 2**k)
    raise FeedError(what)


def tickets(provider: Provider, base: str, key: str, since: str, fetch: Callable, most: int = MOST, whole: bool = False, retries: int = 0, wait: float = 0.5) -> Iterator[dict]:
    """The tickets of a feed, of at most `most` pages; with whole it is an error if there are more."""
    url, number = provider.first(base, since), 1
    while url and number <= most:
        rows, data = _page(provider, url, key, number, fetch, retries, wait)
        yield from rows
        if not rows or provider.short_ends and len(rows) < SIZE:
            return
        url, number = provider.following(base, since, number, data), number + 1
    if url and whole:
        raise FeedError(f"{provider.name}: more than {most} pages")


def pages(provider: Provider, base: str, key: str, since: str, fetch: Callable, **retry) -> Iterator[tuple[str | None, str | None]]:
    """(category, error) of a feed."""
    try:
        for t in tickets(provider, base, key, since, fetch, **retry):
            yield provider.category(t) or FALLBACK, None
    except FeedError as e:
        yield None, str(e)


def connections(each: list[dict]) -> str:
    """The option that names connections: dicts of connection_id, provider, base_url and api_key, each id once."""
    ids = [str(c["connection_id"]) for c in each]
    if len(set(ids)) < len(ids):
        raise ValueError("a connection_id stands twice")
    return json.dumps([{**c, "connection_id": str(c["connection_id"])} for c in each])


class TicketFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ticket_feed"

    def schema(self) -> str:
        return ("connection_id string, " if self.options.get("connections") else "") + "category string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class TicketStream(DataSource):
    """The source of streams, whose rows are tickets with their ids and times."""

    @classmethod
    def name(cls) -> str:
        return "ticket_stream"

    def schema(self) -> str:
        return "connection_id string, ticket_id string, at timestamp, category string"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(dict(self.options))


@dataclass
class _Connection(InputPartition):
    connection: dict
    start: str = ""
    end: str = ""


class _Common:
    def __init__(self, options: dict[str, str]):
        self.options = options
        # Names of options are in lower case.
        self.connections = json.loads(options["connections"]) if options.get("connections") else [options]
        for c in self.connections:
            if (c.get("provider") or "").upper() not in PROVIDERS:
                raise ValueError(f"unknown provider: {c.get('provider')}")

    def _feed(self, c: dict, since: str) -> tuple:
        fetch = _over_http
        if self.options.get("transport"):
            module, _, name = self.options["transport"].partition(":")
            fetch = getattr(importlib.import_module(module), name)
        return PROVIDERS[c["provider"].upper()], c.get("base_url") or "", c.get("api_key") or "", since, fetch

    @property
    def _retry(self) -> dict:
        return {"retries": int(self.options.get("retries", 2)), "wait": float(self.options.get("wait", 0.5))}


class _Reader(_Common, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return [_Connection(c) for c in self.connections]

    def read(self, partition: _Connection) -> Iterator[tuple]:
        found = pages(*self._feed(partition.connection, self.options["since"]), **self._retry)
        if not self.options.get("connections"):
            yield from found
            return
        own, failed = partition.connection["connection_id"], None
        for category, error in found:
            failed = failed or error
            if category is not None:
                yield own, category, None
        yield own, None, failed


def _time(text: str | None) -> datetime | None:
    """A time with its zone, UTC if it names none; None for what is no time."""
    try:
        at = datetime.fromisoformat(text or "")
    except (TypeError, ValueError):
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


class _StreamReader(_Common, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        if not options.get("connections") or _time(options.get("since")) is None:
            raise ValueError("a stream needs connections, and since as a time")
        for name in ("since", "until"):
            if options.get(name):
                self.options[name] = _time(options[name]).isoformat()

    def initialOffset(self) -> dict:  # noqa: N802
        return {c["connection_id"]: self.options["since"] for c in self.connections}

    def latestOffset(self) -> dict:  # noqa: N802
        end = self.options.get("until") or (datetime.now(UTC) - timedelta(seconds=float(self.options.get("lag", 60)))).isoformat(timespec="seconds")
        return {c["connection_id"]: end for c in self.connections}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A connection that was added since the last batch starts at `since`."""
        spans = [_Connection(c, start.get(c["connection_id"], self.options["since"]), end[c["connection_id"]]) for c in self.connections if c["connection_id"] in end]
        return [p for p in spans if _time(p.start) < _time(p.end)]

    def read(self, partition: _Connection) -> Iterator[tuple]:
        low, high, c = _time(partition.start), _time(partition.end), partition.connection
        first, since = low == _time(self.options["since"]), low.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        provider, *rest = self._feed(c, since)
        for t in tickets(provider, *rest, most=STREAM_MOST, whole=True, **self._retry):
            at = _time(provider.at(t))
            if first if at is None else low <= at < high:
                key = t.get("id")
                yield c["connection_id"], None if key is None else str(key), at, provider.category(t) or FALLBACK


def since(now: Column) -> Column:
    """Where a feed starts, as text."""
    return F.date_format(now - F.expr(f"interval {DAYS} days"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def synced(tickets: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Snapshots (connection_id, snapshot_date, category, ticket_count) and states (connection_id, sync_status, last_sync_at, error) of tickets (connection_id, category, error).

    A connection with an error is in state ERROR and gets no snapshots, whatever
    it delivered before; the others are IDLE. While it is read it is SYNCING.
    """
    state = tickets.groupBy("connection_id").agg(F.max("error").alias("error"))
    state = state.select("connection_id", F.when(F.col("error").isNotNull(), "ERROR").otherwise("IDLE").alias("sync_status"), F.when(F.col("error").isNull(), now).alias("last_sync_at"), "error")
    counts = tickets.where("category is not null").groupBy("connection_id", "category").agg(F.count(F.lit(1)).alias("ticket_count"))
    fine = state.where("sync_status = 'IDLE'").select("connection_id")
    return counts.join(fine, "connection_id", "left_semi").select("connection_id", now.alias("snapshot_date"), "category", "ticket_count"), state


def with_state(connections: DataFrame, states: DataFrame) -> DataFrame:
    """connections with the state of those that were read; a failed one keeps its last_sync_at."""
    s = states.select("connection_id", F.col("sync_status").alias("_status"), F.col("last_sync_at").alias("_at"))
    out = connections.join(s, "connection_id", "left")
    return out.withColumn("sync_status", F.coalesce("_status", "sync_status")).withColumn("last_sync_at", F.coalesce("_at", "last_sync_at")).drop("_status", "_at")


def syncing(connections: DataFrame, ids: list) -> DataFrame:
    return connections.withColumn("sync_status", F.when(F.col("connection_id").isin(ids), "SYNCING").otherwise(F.col("sync_status")))
