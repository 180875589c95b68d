import io
import json
import zipfile

from pyspark.sql import functions as F

from quern.operators import batches, context, relational
from quern.sources import readers, sinks
from quern.streaming import capture


def sheet():
    cells = [["Title", "Kund", "Created On"], ["Printer", "ACME", "45292.5"], ["", "none", ""], ["Scanner", "ACME", "2024-01-02"]]
    rows = "".join("<row>" + "".join(f'<c r="{"ABC"[k]}{i + 1}" t="inlineStr"><is><t>{v}</t></is></c>' for k, v in enumerate(r)) + "</row>" for i, r in enumerate(cells))
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="hiddenSheet" r:id="r1"/><sheet name="Cases" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="worksheets/b.xml"/></Relationships>')
        z.writestr("xl/worksheets/a.xml", f'<worksheet xmlns="{main}"/>')
        z.writestr("xl/worksheets/b.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_spreadsheet(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(sheet())
    got = sorted((r["title"], r["account"], r["created_at"]) for r in readers.spreadsheets(spark, str(tmp_path)).collect())
    assert got == [("Printer", "ACME", "2024-01-01T12:00:00"), ("Scanner", "ACME", "2024-01-02")]


def test_json_lines_with_defaults(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"id": "a", "kind": "code", "trust_level": 80}\nnot json\n{"path": "no id"}\n')
    r = readers.json_entities(spark, str(tmp_path / "d.jsonl"), "documents").collect()
    assert [(x["id"], x["kind"], x["trust_level"], x["status"]) for x in r] == [("a", "CODE", 80.0, "active")]
    (tmp_path / "r.jsonl").write_text(json.dumps({"from": "a", "to": "b", "note": "", "reason": "why"}) + "\n" + json.dumps({"from": "a"}) + "\n")
    assert [tuple(x) for x in readers.relations(spark, str(tmp_path / "r.jsonl"), "CONSTRAINS").collect()] == [("a", "b", "CONSTRAINS", "why")]


def test_rules_and_weights(spark):
    r = readers.rules_yaml(spark, "rules:\n  - id: one\n    description: text\n    priority: 7\n    enforce: false\n  - id: two\n").collect()
    assert [(x["id"], x["status"], x["priority"]) for x in r] == [("one", "draft", 7.0), ("two", "active", 0.0)]
    assert readers.weights("ranking:\n  semantic: 0.5\nother:\n  graph: 0.9\n") == {"semantic": 0.5, "graph": 0.25, "trust": 0.2, "recency": 0.15}


def test_seals(spark):
    key = b"0123456789abcdef"
    df = spark.createDataFrame([("secret",)], "s string").withColumn("c", sinks.sealed("s", key))
    assert df.select(sinks.unsealed("c", key)).first()[0] == "secret"


def test_model_batches_fail_alone(spark):
    def call(texts):
        if "bad" in texts:
            raise RuntimeError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "bad", "c"])], "id long, text string").coalesce(1)
    got = [(r["reply"], r["status"]) for r in batches.mapped(df, call, 2).orderBy("id").collect()]
    assert got == [("A", "ok"), ("B", "ok"), ("bad", "failed"), ("c", "failed")]


def test_search_and_related(spark):
    rel = spark.createDataFrame([("a", "b", "X", ""), ("b", "c", "Y", ""), ("d", "a", "Z", "")], "`from` string, `to` string, relation string, note string")
    start = spark.createDataFrame([("a",)], "id string")
    got = {r["id"]: (r["hops"], r["direction"]) for r in context.related(rel, start, 2).collect()}
    assert got == {"b": (1, "outgoing"), "d": (1, "incoming"), "c": (2, "outgoing")}
    assert context.traversed(rel, start, context.related(rel, start, 1), 1).count() == 2
    assert {r["id"]: r["degree"] for r in context.degrees(rel).collect()}["a"] == 2


def test_upsert_and_suggestions(spark):
    old = spark.createDataFrame([("a", 1)], "name string, v int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "name string, v int")
    assert sorted(map(tuple, relational.insert_absent(old, new, ["name"]).collect())) == [("a", 1), ("b", 3)]
    t = spark.createDataFrame([(1, "printer jam paper", []), (2, "paper jam", ["hw"]), (3, "invoice", ["fin"])], "id long, text string, tags array<string>")
    assert [tuple(r) for r in relational.suggested_tags(t, 1).collect()] == [("hw", 2)]


def test_streams(spark, tmp_path):
    rows = [(k, f"RE: t{k % 2}", "p", "b", f"2024-01-0{1 + k % 3} 00:00:00") for k in range(6)]
    spark.createDataFrame(rows, "id long, text string, person string, batch string, date string").withColumn("date", F.to_timestamp("date")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    capture.append_to(capture.captured(capture.deduplicated(stream)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 2 and "ticket_class" in got.columns
