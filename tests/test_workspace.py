import json
from datetime import datetime

import feed_pages
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import analytics, batches, context, entities, evaluate, imports, records, relational, replies
from quern.sources import feeds, readers, sinks
from quern.streaming import capture


def desk(url, headers):
    """Three pages of 100, 100 and 7 tickets; every other one without a kind."""
    assert headers["Authorization"].startswith("Basic ")
    page = int(url.rsplit("page=", 1)[1])
    return 200, [{"type": "net" if k % 2 else None} for k in range(100 if page < 3 else 7)]


def hub(url, headers):
    if "after=2" in url:
        return 503, None
    return 200, {"results": [{"properties": {"hs_pipeline_stage": "1"}}] * 100, "paging": {"next": {"after": "2"}}}


def test_feeds(spark):
    spark.dataSource.register(feeds.TicketFeed)
    spark.sparkContext.addPyFile(feed_pages.__file__)
    read = lambda p: list(feeds.pages(feeds.PROVIDERS[p], "https://x", "k", "2024-01-01T00:00:00Z", {"FRESHDESK": desk, "ZENDESK": feed_pages.zen, "HUBSPOT": hub}[p]))
    assert len(read("FRESHDESK")) == 207 and sum(c == "Övrigt" for c, _ in read("FRESHDESK")) == 104
    assert len(read("ZENDESK")) == 30 and sum(c == "a" for c, _ in read("ZENDESK")) == 10
    assert len(read("HUBSPOT")) == 101 and read("HUBSPOT")[-1] == (None, "HubSpot API 503 on page 2")
    gone = lambda url, headers: 1 / 0
    assert [c for c, _ in feeds.pages(feeds.PROVIDERS["ZENDESK"], "", "", "", gone)] == [None]
    df = spark.read.format("ticket_feed").options(provider="zendesk", since="2024-01-01", transport="feed_pages:zen").load()
    assert df.groupBy("category").count().count() == 2
    both = df.withColumn("connection_id", F.lit(1)).union(spark.createDataFrame([("x", None, 2), (None, "HTTP 500", 2)], "category string, error string, connection_id int"))
    snaps, states = feeds.synced(both, F.lit("2024-02-01").cast("timestamp"))
    assert {(r["category"], r["ticket_count"]) for r in snaps.collect()} == {("a", 10), ("Övrigt", 20)}
    assert {(r["connection_id"], r["sync_status"]) for r in states.collect()} == {(1, "IDLE"), (2, "ERROR")}
    with pytest.raises(Exception, match="unknown provider"):
        spark.read.format("ticket_feed").options(provider="other", since="").load().collect()


def test_versions_of_tables(spark, tmp_path):
    top = str(tmp_path / "t")
    assert sinks.current(spark, top, "a") is None
    sinks.replace({"a": spark.range(3), "b": spark.range(1)}, top)
    old = sinks.current(spark, top, "a")
    sinks.added({"a": spark.range(10, 12), "b": spark.range(5)}, top)
    assert sinks.current(spark, top, "a").count() == 5 and sinks.current(spark, top, "b").count() == 6
    assert old.count() == 3  # a reader that began before goes on
    with pytest.raises(Exception):  # noqa: B017
        sinks.replace({"a": spark.range(1), "b": spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))}, top)
    assert sinks.current(spark, top, "a").count() == 5
    plain = str(tmp_path / "p")
    sinks.append(spark.range(4), plain)
    sinks.append(spark.range(4), plain)
    assert spark.read.parquet(plain).count() == 8
    sinks.result_json(spark.range(2), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_graph_load_and_manifest(spark, tmp_path):
    top = str(tmp_path / "g")
    out = sinks.loaded_graph({"files": spark.range(3)}, {"implements": spark.range(2)}, top, "2024-01-01")
    assert out["counts"] == {"files": 3, "implements": 2} and json.loads((tmp_path / "g" / "manifest.json").read_text()) == out


def test_index_and_manifest(spark, tmp_path):
    rows = [("b", "s", [0.12345678, 1.0], "embedded", None), ("a", "s", [1.0, 2.0], "reused", None), ("c", "s", None, "failed", "boom")]
    df = spark.createDataFrame(rows, "id string, signature string, vector array<double>, status string, error string")
    out = sinks.embedding_index(df, str(tmp_path / "i"), "m", "2024")
    assert out["counts"] == {"entities": 3, "output": 2, "embedded": 1, "reused": 1, "failed": 1} and out["failures"] == ["c: boom"] and out["dimensions"] == 2
    back = readers.vectors(spark, str(tmp_path / "i"))
    assert {r["id"]: r["vector"] for r in back.collect()} == {"a": [1.0, 2.0], "b": [0.123457, 1.0]} and readers.model_of(back) == "m"


def test_loose_rows(spark):
    rows = [("1", "p", "code", "80", "true", 7), ("2", "p", None, "x", "maybe", 8), ("3", "", "DOC", "1", "0", 9), (None, "p", "ADR", "1", "1", 9)]
    df = spark.createDataFrame(rows, "id string, path string, kind string, trust_level string, source_of_truth string, updated_at int")
    content = spark.createDataFrame([("1", "text")], "id string, content string")
    got = {r["id"]: r for r in readers.vertices(df, "documents", content).collect()}
    assert sorted(got) == ["1", "2"] and (got["1"]["kind"], got["1"]["trust_level"], got["1"]["source_of_truth"], got["1"]["content"], got["1"]["updated_at"]) == ("CODE", 80.0, True, "text", "7")
    assert (got["2"]["kind"], got["2"]["trust_level"], got["2"]["source_of_truth"], got["2"]["content"]) == ("DOC", 50.0, False, "")
    rules = readers.vertices(spark.createDataFrame([("r", 1)], "id string, priority int"), "rules").first()
    assert (rules["title"], rules["priority"], rules["scope"], rules["source_of_truth"]) == ("r", 1.0, "global", True)


def test_graph_else_cache(spark):
    cache, none = {"a": spark.range(2), "b": spark.range(3)}, spark.range(0)
    found, why = readers.chosen(lambda: {"a": none, "b": spark.range(9)}, cache)
    assert (found["a"].count(), found["b"].count(), why) == (2, 9, "")

    def broken():
        raise OSError("down")

    found, why = readers.chosen(broken, cache)
    assert found["b"].count() == 3 and "down" in why
    with pytest.raises(Exception, match="nope"):  # a mistake in the caller's plan is no matter of the store
        readers.chosen(lambda: {"a": spark.range(1).select("nope")}, cache)


def test_files_and_statements(spark, tmp_path):
    (tmp_path / "a").write_text("")
    assert readers.present(spark, str(tmp_path), ["a"], ["a", "b"]) == ["b"]
    with pytest.raises(FileNotFoundError, match="/b"):
        readers.present(spark, str(tmp_path), ["a", "b"])
    assert readers.statements("// c; d\nCREATE a;\n  // e\n CREATE b\n(c);; ") == ["CREATE a;", "CREATE b\n(c);"]


def test_stored_vectors(spark):
    blobs = spark.createDataFrame([("a", bytearray(V.pack([1.0, 2.0]))), ("b", bytearray(V.pack([1.0]))), ("c", None), ("d", bytearray(V.pack([3.0, 4.0])))], "id string, vector binary")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    assert [(r["id"], list(r["vector"])) for r in readers.stored_vectors(blobs, ids, 2).collect()] == [("a", [1.0, 2.0])]
    assert V.unpack(V.pack([0.5, 2.0])) == [0.5, 2.0]
    d = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0])], "a array<double>, b array<double>").select(V.squared_distance(F.col("a"), F.col("b")))
    assert d.first()[0] == 13.0


def test_import_of_a_sheet(spark):
    fields = ["case_number", "title", "account", "contact", "description", "case_type", "support_type", "status", "priority", "owner", "created_at", "product"]
    rows = [["1", "t", "acme", "", "d" * 600, "", "", "", "P1", "Ann", "2024-01-02", ""], ["2", "u", "", "", "", "c", "", "new", "", "", "bad", "X"]]
    df = spark.createDataFrame([(*r, "f", k) for k, r in enumerate(rows)], ", ".join(f"{f} string" for f in fields) + ", file string, ordinal long")
    assert [(r["name"], r["sort_order"]) for r in imports.missing_persons(df, spark.createDataFrame([("x",)], "name string")).collect()] == [("Ann", 1), ("Ej tilldelad", 2)]
    persons = spark.createDataFrame([(1, "Ann"), (2, "Ej tilldelad")], "person_id int, name string")
    got = imports.records(df, persons, F.lit("2030-01-01").cast("timestamp")).orderBy("ordinal").collect()
    assert [(r["person_id"], len(r["text"]), r["customer"], r["created_at"]) for r in got] == [(1, 502, "acme", datetime(2024, 1, 2)), (2, 1, None, datetime(2030, 1, 1))]
    e = readers.evaluation_records(df).orderBy("id").collect()
    assert [(r["id"], r["person"], r["org"], r["tags"]) for r in e] == [("f#1", "Ann", "acme", ["P1"]), ("f#2", "Okänd", None, ["X"])]


def test_replies(spark):
    rows = [(1, 'x [{"title": "A", "challengeIds": ["1", "9", "2"]}] y'), (2, "[{]"), (3, "none"), (4, None), (5, '[{"title": "B", "challengeIds": ["1"]}, {"title": "C"}, null]')]
    df = spark.createDataFrame(rows, "batch int, reply string")
    assert {r["batch"]: r["status"] for r in replies.parsed(df).collect()} == {1: "ok", 2: "failed", 3: "ok", 4: "failed", 5: "ok"}
    got = replies.detected(df, spark.range(3)).collect()
    assert [(r["title"], r["ids"], r["pattern_type"], r["suggestion"]) for r in got] == [("A", ["1", "2"], "RECURRING", None)]
    assert spark.createDataFrame([("ESCALATING",), ("x",), (None,)], "k string").where(replies.is_kind(F.col("k"))).count() == 1


def test_patches(spark):
    df = spark.createDataFrame([(1, "t", "d"), (2, "t", "d"), (3, "t", "d")], "id int, title string, description string")
    patch = spark.createDataFrame([(1, "x" * 201, "new", None), (2, None, None, ["description"])], "id int, title string, description string, _cleared array<string>")
    assert [tuple(r) for r in relational.patched(df, patch, "id").orderBy("id").collect()] == [(1, "t", "new"), (2, "t", None), (3, "t", "d")]


def test_states(spark):
    now = F.lit("2024-05-01").cast("timestamp")
    rows = [("ACTIVE", None), ("ACTIVE", datetime(2024, 1, 1)), ("COMPLETED", datetime(2024, 1, 1)), ("PLANNED", None)]
    df = spark.createDataFrame(rows, "s string, a timestamp").withColumn("b", F.lit(None).cast("timestamp"))
    a, b = relational.meeting_state(F.col("s"), F.col("a"), F.col("b"), now)
    may = datetime(2024, 5, 1)
    assert [tuple(r) for r in df.select(a, b).collect()] == [(may, None), (datetime(2024, 1, 1), None), (datetime(2024, 1, 1), may), (None, None)]


def test_text_forms(spark):
    one = lambda v, f: spark.createDataFrame([(v,)], "x string").select(f(F.col("x"))).first()[0]
    assert one("ﬁne ①", T.nfkc) == "fine 1" and one(None, T.nfkc) is None
    assert one("  ada  b. lovelace", T.initials) == "AB" and one(" ", T.initials) == "NY"
    title = lambda c: T.clean_title(c, F.lit("own"))
    assert one("<think>x</think> «Titel: Printer»", title) == "Printer" and one("2) Net", title) == "Net" and one("x" * 81, title) == "own"
    key = lambda a, b: spark.createDataFrame([(a, b)], "s string, i string").select(records.batch_key(F.col("s"), F.col("i"), F.lit(7))).first()[0]
    assert (key("s", "i"), key("", "i"), key(None, "")) == ("s", "i", "7")
    size = spark.createDataFrame([(1023,), (1024,), (1048576,)], "n long").select(T.file_size(F.col("n")))
    assert [r[0] for r in size.collect()] == ["1023 B", "1 KB", "1.0 MB"]


def test_search_meets_compatible_forms(spark):
    base = {k: "" for k in ("path", "kind", "label", "status", "snippet")}
    df = spark.createDataFrame([{"id": "a", "text": "ﬁnancial report", "entity_type": "x", "trust_level": 50.0, "source_of_truth": False, "updated_at": None, **base}], "id string, text string, entity_type string, trust_level double, source_of_truth boolean, updated_at timestamp, path string, kind string, label string, status string, snippet string")
    df = df.withColumn("matched_rules", F.array().cast("array<string>"))
    none = spark.createDataFrame([], "`from` string, `to` string, relation string, note string")
    assert context.search(df, none, "financial", F.current_timestamp()).count() == 1


def test_orders(spark):
    tags = spark.createDataFrame([("ö",), ("z",), (None,), ("å",), ("a",), ("ä",)], "tag string")
    assert [r["tag"] for r in analytics.in_tag_order(tags).orderBy("place").collect()] == ["a", "z", "å", "ä", "ö", None]
    got = analytics.in_import_order(spark.createDataFrame([(1, 5), (2, None), (None, 9), (3, 8)], "import_id int, date int"))
    assert [r["import_id"] for r in got.orderBy("place").collect()] == [3, 1, 2, None]


def test_group_titles(spark):
    rows = [(1, 0, 1, "TIMS saknas here", "p"), (1, 1, 2, "TIMS saknas there", "p"), (2, 0, 3, "words alike again", "p"), (2, 1, 4, "words alike once", "q"), (3, 0, 5, "TIMS", "p"), (4, 0, 6, "x y", "")]
    m = spark.createDataFrame(rows, "cluster int, pos int, id int, text string, person string")
    signed = entities.extracted(m.withColumn("tags", F.array().cast("array<string>")))
    got = {r["cluster"]: r["title"] for r in entities.group_titles(m, signed).collect()}
    assert got[1] == "TIMS — saknas" and got[2] == "alike words again" and got[3] in ("TIMS — tims", "TIMS (p)") and got[4] == "Kluster (1 ärenden)"


def test_best_threshold(spark):
    df = spark.createDataFrame([(0.36, 1, 99.0), (0.42, 0, 90.0), (0.45, 0, 95.0), (0.39, 0, 95.0)], "threshold double, catch_alls int, coverage double")
    assert evaluate.best_threshold(df).first()["threshold"] == 0.39


def test_chunks_are_part_of_files(spark):
    got = context.part_of(spark.createDataFrame([("c", "f"), ("d", "")], "id string, file_id string")).collect()
    assert [(r["from"], r["to"]) for r in got] == [("c", "f")]


def test_streams_merge(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id long, text string"

    def run(rows, embed):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        capture.merged_to(stream, f"{out}/p", "seen", ["id"], f"{out}/c1").awaitTermination()
        capture.embedded_to(stream, embed, f"{out}/v", f"{out}/c2").awaitTermination()

    run([(1, "a"), (2, "b"), (2, "b")], lambda texts: [[1.0]] * len(texts))
    run([(2, "b"), (1, "changed"), (3, "c")], lambda texts: [[2.0]] * len(texts))
    assert {r["id"]: r["text"] for r in sinks.current(spark, f"{out}/p", "seen").collect()} == {1: "a", 2: "b", 3: "c"}
    assert {r["id"]: r["vector"][0] for r in sinks.current(spark, f"{out}/v", "vectors").collect()} == {1: 2.0, 2: 1.0, 3: 2.0}


def test_vectors_of_a_length(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, text string")
    known = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0])], "id long, vector array<double>")
    got = batches.embedded(df, lambda texts: [[3.0, 4.0]] * len(texts), known, dimensions=2, normal=True)
    assert {r["id"]: list(r["vector"]) for r in got.collect()} == {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [0.6, 0.8]}
    with pytest.raises(Exception, match="vectors of 1 numbers, not 2"):
        batches.embedded(df, lambda texts: [[1.0]] * len(texts), known, dimensions=2).collect()


def test_daily_counts(spark, tmp_path):
    schema = "ts timestamp, category string"
    rows = [(datetime(2024, 1, d, h), c) for d, h, c in ((1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a"), (9, 1, "a"))]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    counts = capture.daily_counts(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    capture.append_to(counts, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = {(r["day"].day, r["category"]): r["n"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1, "a"] == 2 and got[1, "b"] == 1 and got[2, "a"] == 1 and (9, "a") not in got
