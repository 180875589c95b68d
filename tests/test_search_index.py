"""Search by the index against the scan of every text."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import context, search_index
from quern.operators.search_index import SearchIndex

ENTITY = "id string, entity_type string, kind string, label string, path string, text string, status string, source_of_truth boolean, trust_level double, updated_at timestamp, snippet string, matched_rules array<string>"


@pytest.fixture(scope="module")
def data(spark):
    random.seed(2)
    word = lambda: random.choice(["red", "blue", "ﬁne", "Straße", "search", "rules", "x1", "the", "the", "the", "zeta"])
    rows = [(f"d{k}", "File", "DOC", f"l{k}", "p", " ".join(word() for _ in range(random.randint(0, 12))), random.choice(["active", "Deprecated", "draft"]), k % 3 == 0, float(k % 120), None, "s", ["r"]) for k in range(150)]
    rows.append(("dn", "File", "DOC", None, None, None, "active", False, 5.0, None, None, None))
    entities = spark.createDataFrame(rows, ENTITY).withColumn("updated_at", F.when(F.col("id") != "d7", F.timestamp_seconds(F.lit(1_700_000_000) + F.length("text") * 100_000)))
    rel = spark.createDataFrame([(f"d{k % 20}", f"d{k % 7}", "X", "") for k in range(60)], "`from` string, `to` string, relation string, note string")
    vectors = spark.createDataFrame([(f"d{k}", [float(k % 5), 1.0, float(k % 3) - 1]) for k in range(0, 150, 2)], "id string, vector array<double>")
    return entities, rel, vectors


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


@pytest.mark.parametrize("named", [1000, 2])
def test_equals_the_scan(spark, data, tmp_path, monkeypatch, named):
    monkeypatch.setattr(search_index, "NAMED", named)
    entities, rel, vectors = data
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.build(entities, rel, vectors)
    for query, options in [("red the", {}), ("fine strasse the zeta", {"top_k": 20}), ("sökning", {"include_deprecated": True}), ("the red", {"query_vector": [1.0, 0.5, -0.2], "top_k": 10}), ("", {"query_vector": [0.0, 1.0, 0.0]}), ("nowhere", {}), ("red", {"weights": {"semantic": -1.0}, "top_k": 7})]:
        scan = dict(options)
        want = context.search(entities, rel, query, now(), vectors=vectors if "query_vector" in options else None, **scan)
        assert list(map(tuple, index.search(query, now(), **options).collect())) == list(map(tuple, want.collect())), query


def test_reads_its_own_postings_without_python(spark, data, tmp_path):
    entities, rel, vectors = data
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.build(entities, rel, vectors, folders=64)
    found = index._candidates(["zeta"], index.log.version(), 64, False, None)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    there = index.log.read("postings").select(F.input_file_name()).distinct().count()
    own = index.log.read("postings").where(F.col("folder").isin([search_index._folder(F.lit("zeta"), 64)])).select(F.input_file_name()).distinct().count()
    assert 0 < own <= 4 < there
    assert "Python" not in index.search("zeta", now())._jdf.queryExecution().executedPlan().toString()


def test_add_and_reload(spark, data, tmp_path):
    entities, rel, vectors = data
    index, reader = (SearchIndex(spark, f"file://{tmp_path}/i") for _ in range(2))
    index.build(entities.where("id <> 'd5'"), rel, vectors)
    index.add(entities, rel.limit(0), None)
    assert reader.log.read("texts").count() == entities.count()
    index.build(entities.where("id in ('d1', 'd2')"), rel)
    assert {r["id"] for r in reader.search("red blue the search rules x1 zeta", now(), 20, True).collect()} <= {"d1", "d2"}


def test_a_token_is_a_row_for_many_entities(spark, data, tmp_path):
    entities, rel, vectors = data
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.build(entities.coalesce(1), rel, vectors)
    postings = index.log.read("postings")
    assert postings.count() == postings.select("token").distinct().count()
    want = entities.select("id", F.explode(F.array_distinct(search_index.T.tokens(search_index.T.nfkc(F.coalesce("text", F.lit(""))))))).groupBy("col").count()
    assert {(r["token"], r["n"]) for r in postings.select("token", F.size("places").alias("n")).collect()} == {tuple(r) for r in want.collect()}
    # Texts are written in place: no sort, no exchange.
    plan = index._tables(entities.coalesce(1), rel, vectors, None)["texts"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_inverted_over_blocks_and_batches(monkeypatch):
    monkeypatch.setattr(search_index, "TOGETHER", 40)
    random.seed(5)
    rows = {n: sorted({random.choice("abcdefgh") for _ in range(random.randint(0, 6))}) for n in [*range(32760, 32780), *range((1 << 33) + 65530, (1 << 33) + 65540), (7 << 33) + 98303]}
    batches = [search_index.pa.RecordBatch.from_pydict({"number": list(x), "tokens": search_index.pa.array([rows[n] for n in x], search_index.pa.list_(search_index.pa.string()))}) for x in (list(rows)[:9], list(rows)[9:10], list(rows)[10:])]
    got = [(t, (b << search_index.PLACE) + p) for out in search_index.inverted(iter(batches)) for t, b, places in zip(*(out[c].to_pylist() for c in ("token", "block", "places")), strict=True) for p in places]
    assert sorted(got) == sorted((t, n) for n, tokens in rows.items() for t in tokens)
    assert list(search_index.inverted(iter([]))) == []


def test_two_adds_give_the_same_numbers(spark, data, tmp_path):
    entities, rel, vectors = data
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.build(entities.where("id = 'd1'"), rel)
    both = [index._tables(entities.where(f"pmod(hash(id), 2) = {k} and id <> 'd1'").coalesce(1), rel, None, 16) for k in (0, 1)]
    for tables in both:
        del tables["settings"]
        index.log.append(tables, by={"postings": "folder"})
    want = context.search(entities, rel, "red the zeta", now(), 20)
    assert list(map(tuple, index.search("red the zeta", now(), 20).collect())) == list(map(tuple, want.collect()))
