import feed_pages
import pytest
from pyspark.sql import functions as F

from quern.sources import feeds
from quern.sources.log import TableLog
from quern.streaming import capture


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(feeds.TicketFeed)
    spark.dataSource.register(feeds.TicketStream)
    spark.sparkContext.addPyFile(feed_pages.__file__)
    return spark


def each(folder, *ids):
    return feeds.connections([{"connection_id": k, "provider": "FRESHDESK", "base_url": f"http://x{folder}", "api_key": "k"} for k in ids])


def test_a_partition_for_each_connection(source, tmp_path):
    """Connections are read side by side; one without tickets is idle, and one that fails after its retries is in error."""
    read = lambda since, **o: source.read.format("ticket_feed").options(since=since, wait=0.01, **{"transport": "feed_pages:desk", **o}).load()
    df = read("2024-01-01T00:00:00Z", connections=each(tmp_path, 1, 2))
    assert df.columns == ["connection_id", "category", "error"] and df.rdd.getNumPartitions() == 2
    none = read("2025-01-01T00:00:00Z", connections=each(tmp_path, 3))
    bad = read("2024-01-01T00:00:00Z", connections=each(tmp_path, 4), transport="feed_pages:gone")
    counts, states = feeds.synced(df.union(none).union(bad), F.lit("2024-02-01").cast("timestamp"))
    got = {(r["connection_id"], r["category"]): r["ticket_count"] for r in counts.collect()}
    assert got == {(c, t): n for c in "12" for t, n in (("t0", 125), ("t1", 125), ("again", 84))}
    assert {(r["connection_id"], r["sync_status"], r["error"]) for r in states.collect()} == {("1", "IDLE", None), ("2", "IDLE", None), ("3", "IDLE", None), ("4", "ERROR", "Freshdesk API 500 on page 1")}


def test_retries_are_bounded():
    asked = []

    def fetch(url, headers):
        asked.append(url)
        return (429, None) if len(asked) < 3 else (404, None)

    desk = feeds.PROVIDERS["FRESHDESK"]
    assert list(feeds.pages(desk, "b", "k", "s", fetch, retries=5, wait=0)) == [(None, "Freshdesk API 404 on page 1")] and len(asked) == 3
    asked.clear()
    assert list(feeds.pages(desk, "b", "k", "s", fetch, retries=1, wait=0)) == [(None, "Freshdesk API 429 on page 1")] and len(asked) == 2
    odd = lambda url, headers: (200, {"no": "list"})
    assert [c for c, _ in feeds.pages(feeds.PROVIDERS["ZENDESK"], "b", "k", "s", odd)] == [None]
    with pytest.raises(feeds.FeedError, match="more than 2 pages"):
        list(feeds.tickets(desk, "b", "k", "s", lambda u, h: (200, [{}] * 100), most=2, whole=True))
    with pytest.raises(ValueError, match="twice"):
        each("", 1, 1)


def test_a_stream_goes_on_at_its_cursor(source, tmp_path):
    """Two runs read each span once; a connection added later starts from the beginning; a ticket's last form stays."""
    folder, checkpoint, at = str(tmp_path / "t"), str(tmp_path / "c"), str(tmp_path)

    def run(until, *ids, **more):
        options = {"connections": each(at, *ids), "since": "2024-01-01T00:00:00Z", "until": until, "wait": 0.01, "transport": "feed_pages:desk", **more}
        capture.tickets_to(source.readStream.format("ticket_stream").options(**options).load(), folder, checkpoint).awaitTermination()
        rows = TableLog(source, folder).read("tickets").collect()
        return {(r["connection_id"], r["ticket_id"]): r["category"] for r in rows}, len(rows)

    got, n = run("2024-01-05T00:00:00Z", 1)
    assert n == 96 and got == {("1", str(k)): f"t{k % 2}" for k in range(96)}
    got, n = run("2024-01-05T00:00:00Z", 1)
    assert n == 96
    with pytest.raises(Exception, match="Freshdesk API 500"):
        run("2024-01-21T00:00:00Z", 1, 2, transport="feed_pages:gone")
    got, n = run("2024-01-21T00:00:00Z", 1, 2)
    assert n == 500 and got == {(c, str(k)): f"t{k % 2}" if k % 3 else "again" for c in "12" for k in range(250)}
    # The second run asked from where the first ended, but for the new connection.
    asked = {p.name.split("-", 1)[1] for p in tmp_path.glob("failed-*")}
    assert asked == {"2024-01-01-2", "2024-01-05-2"}
