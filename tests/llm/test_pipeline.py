from collections import defaultdict

import duckdb
import pytest
from conftest_llm import pairs
from pyspark.sql import functions as F
from test_near import components, grams
from test_substrings import covered

import corpus_pipeline
from quern.llm import queries

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, kept = docs.columns, None
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.written(stage(spark, docs, DIR))
        rows = docs.collect()
        if k < 3:
            assert docs.columns == columns and len(rows) > 100
            assert all(r["n_chars"] == len(r["text"]) for r in rows) or k < 2
            ids = {r["doc_id"] for r in rows}
            assert kept is None or (ids <= kept if k < 2 else ids == kept)
            kept = ids
    parts = defaultdict(int)
    for r in rows:
        parts[r["doc_id"]] += r["length"]
        assert len(r["ids"]) == r["length"]
    assert set(parts) == kept


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:3]])
def test_stages_take_odd_rows(spark, docs, none, stage):
    out = stage(spark, docs, DIR)
    assert out.columns == docs.columns and out.count() <= docs.count() and stage(spark, none, DIR).count() == 0
    bare = docs.select("doc_id", "text")
    assert stage(spark, bare, DIR).columns == bare.columns


def test_stages_equal_brute_force(spark):
    """The n-gram join and the suffix arrays, each on what the stage before kept."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    quality, join, suffix, _ = (f for _, f in corpus_pipeline.STAGES)
    docs = corpus_pipeline.written(quality(spark, docs, DIR))
    sets = {i: grams(t) for i, t in pairs(docs)}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    least = components(ids, near)
    docs = corpus_pipeline.written(join(spark, docs, DIR))
    assert near and {i for i, _ in pairs(docs)} == {i for i in ids if least[i] == i}
    left = dict(pairs(suffix(spark, docs, DIR)))
    for i, w, gone in covered(pairs(docs), 50, lambda t: (t or "").encode()):
        assert left[i] == bytes(x for x, g in zip(w, gone, strict=True) if not g).decode("utf-8", "ignore")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, DIR).toPandas()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_columns_stay_as_they_are(spark, docs):
    """Stages that rewrite or drop rows keep every other column's values: microseconds, bytes, decimals, NaN, odd names, and `_id`."""
    more = docs.where("doc_id is not null").select(
        "doc_id", "text", F.timestamp_micros(F.lit(1_700_000_000_123_456) + F.col("doc_id")).alias("at"), F.expr("timestamp_ntz'1850-01-02 03:04:05.678901'").alias("local"), F.encode(F.lit("a\x00ÿ"), "utf-8").alias("raw"),
        F.lit("12345678901234567890.123456789").cast("decimal(38,9)").alias("sum"), F.lit(float("nan")).alias("odd.name"), F.lit(float("-inf")).cast("float").alias("a`b"), F.lit(7).alias("_id"), F.lit(None).cast("string").alias("none"),
        F.struct(F.lit(0.1).alias("x"), F.to_date(F.lit("1582-10-04")).alias("day")).alias("deep"), F.lit("kept").alias("carried"), F.lit(1).alias("_more"),
    )
    plain = lambda df: {r[0]: str(r[2:]) for r in df.collect()}
    want = plain(more)
    for stage in (corpus_pipeline.ngram_jaccard, corpus_pipeline.suffix_array):
        out = stage(spark, more, "")
        assert out.columns == more.columns and out.dtypes == more.dtypes
        got = plain(out)
        assert got and got == {k: want[k] for k in got}
