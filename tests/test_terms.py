"""Terms that tasks count in numbers: the words of the column function, no shuffle of terms, one count over all slices."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import terms
from quern.functions import text as T
from quern.operators import topics


def test_words_and_sums(spark):
    random.seed(3)
    some = ["INC-12", "deadbeef", "a@b.c", "@x", "(SAP)", "it's", "...", "x", "år", "12", "1.5", "OK,", "„q“", "ref7", "ref_7"]
    texts = ["", *(random.choice(["", " "]).join(random.choice([" ", "\t", " ", "; ", ""]) + random.choice(some) for _ in range(12)) for _ in range(400))]
    doc, code, names = terms.words(pa.array(texts))
    want = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", T.words_for_topics(F.col("t")).alias("w")).collect()
    got = [[] for _ in texts]
    for d, c in zip(doc, code, strict=True):
        got[d].append(names[c])
    assert got == [r["w"] for r in sorted(want, key=lambda r: r["id"])]
    # Hashes that agree in one half only are told apart.
    assert terms.summed(np.array([[1, 2], [1, 3], [1, 2], [4, 2]], "u8"), np.array([1, 10, 100, 1000])).tolist() == [101, 10, 101, 1000]


def test_terms_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(topics, "PIECE", 40)
    monkeypatch.setattr(topics, "BUCKET", 40)
    df = spark.createDataFrame([(k, f"alpha beta{k % 7} gamma SAP{k % 3}", ["x"]) for k in range(60)], "id long, text string, tags array<string>")
    out = topics.term_counts(df)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString() and out.where("term = 'gamma'").count() == 60
    assert {r["term"]: r["df"] for r in topics.document_counts(df).collect()}["alpha beta0"] == 9
    assert {r["topics"][0] for r in topics.corpus_topics(df).collect()} == {"SAP0", "SAP1", "SAP2"}


def _turned(spark, monkeypatch):
    """Records, from whose slices terms are asked in one order of texts and told in another, as when several executors send them; and how to turn it on."""
    df = spark.createDataFrame([(k, f"alpha{k % 5} beta{k % 7} gamma{k % 11} SAP{k % 3}", ["x"]) for k in range(200)], "id long, text string, tags array<string>").repartition(3, "id")
    asked = topics._asked

    def turned(df, by):
        rows, back, buckets = asked(df, by)
        return rows.orderBy(F.desc("id")), back, buckets

    return df, lambda: monkeypatch.setattr(topics, "_asked", turned)


def test_counts_meet_their_terms_in_any_order(spark, monkeypatch):
    df, turn = _turned(spark, monkeypatch)
    turn()
    counts = {r["term"]: r["df"] for r in topics.document_counts(df).collect()}
    band = {r["term"] for r in topics.banded(df).collect()}
    got = topics.tf_idf(df).collect()
    assert {r["term"] for r in got} == band
    for r in got:
        assert abs(r["score"] - r["tf"] * np.log(200 / counts[r["term"]]) * (2 if r["term"].startswith("SAP") else 1)) < 1e-9


def test_topics_of_records_in_any_order(spark, monkeypatch):
    df, turn = _turned(spark, monkeypatch)
    want = topics.corpus_topics(df).orderBy("id").collect()
    turn()
    assert topics.corpus_topics(df).orderBy("id").collect() == want


def test_topics_of_clusters_in_any_order(spark, monkeypatch):
    df, turn = _turned(spark, monkeypatch)
    scores = lambda: topics.cluster_scores(topics.corpus_topics(df), df.selectExpr("id", "id % 2 as cluster")).orderBy("cluster", "topic").collect()
    want = scores()
    turn()
    assert scores() == want


def test_pruned_topics_in_any_order(spark, monkeypatch):
    df, turn = _turned(spark, monkeypatch)
    pruned = lambda: topics.cluster_topics(topics.corpus_topics(df), df.selectExpr("id", "id % 2 as cluster")).orderBy("cluster").collect()
    want = pruned()
    turn()
    assert pruned() == want
