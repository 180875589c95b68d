import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.functions import text as T
from quern.operators import records, topics


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_classes(spark):
    for text, want in [
        ("[NR] disk on host", "monitoring_alert"), ("Planned MAINTENANCE tonight", "config_change"), ("MÖTE på fredag", "administrative"), ("RE: the printer", "forwarded_email"),
        ("Printer prints nothing", "customer_incident"), ("maintenance meeting", "config_change"), ("", "customer_incident"),
    ]:
        assert one(spark, text, T.classify) == want, text


def test_title_forms(spark):
    assert one(spark, "RE: Printer   [x] #4 ", T.normalize_title) == "printer x 4"
    assert one(spark, "[x] RE: a", T.normalize_title) == "x re: a"
    assert one(spark, "Order 123 late", T.repeated_form) == "order N late"
    assert one(spark, "TIMS — sync", T.leading_word) == "tims"
    assert one(spark, None, T.normalize_title) is None


def test_duplicates_keep_the_newest_of_a_batch(spark):
    rows = [(1, "Fw: a b", "p", "x", 3), (2, "A  b", "p", "x", 5), (3, "a b", "p", "y", 1), (4, "a b", "q", "x", 1), (5, None, "p", None, 1)]
    df = spark.createDataFrame([(i, t, p, b, datetime(2024, 1, d)) for i, t, p, b, d in rows], "id long, text string, person string, batch string, date timestamp")
    got = {r["id"]: r["is_duplicate"] for r in records.with_duplicates(records.with_ordinal(df)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_ngrams(spark):
    words = one(spark, "TIMS crashed (again) on PubTrans 12 a@b.c", T.words_for_topics)
    assert words == ["TIMS", "crashed", "again", "on", "PubTrans", "12"]
    df = spark.createDataFrame([(1, "TIMS crashed (again) on PubTrans 12", ["x"]), (2, None, None)], "id long, text string, tags array<string>")
    grams = [r["term"] for r in topics.term_counts(df).where("id = 1").orderBy("first_pos").collect()]
    assert grams == ["TIMS", "crashed", "again", "on", "PubTrans", "tims crashed", "crashed again", "again on", "on pubtrans"]


@pytest.mark.parametrize("text", ["a@b.c x@ @y a@@ z", "IS-123 ref99 REFa CS12x cas-7.", "deadbeef cafe12g 1234567 \"0a1b2c3d\"", "..,;x!? , ;y; ... a,b .c", "(one)[two]{three}<four>", ",,,,,, a", "x" * 50 + "." * 50])
def test_words_for_topics_are_the_definition(spark, text):
    space = "[\\t-\\r \u00a0\ufeff]"
    want = re.sub(r"(?i)\b(?:IS-|INC-|REF|REQ|SESD-|CAS-|CS)[0-9]+\b", "", text)
    want = re.sub(r"(?i)\b[0-9A-F]{6,}\b", "", want)
    want = re.sub(r"\S+@\S+", "", want)
    want = re.sub(r"[()\[\]{}<>]", " ", re.sub("[\"'“”‘’`«»]", "", want))
    want = [w for w in (re.sub("^[.,;:!?]+|[.,;:!?]+$", "", w) for w in re.split(f"{space}+", want)) if len(w) >= 2]
    assert one(spark, text, T.words_for_topics) == want


def test_topics_keep_the_band(spark):
    rows = [(k, "printer broken" if k < 3 else f"word{k} other", []) for k in range(10)]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    got = {r["id"]: r["topics"] for r in topics.corpus_topics(df).collect()}
    assert "printer" in got[0] and got[5] == []  # 'other' is in 7 of 10, 'word5' in one


def test_bigram_pruning(spark):
    df = spark.createDataFrame([(["PubTrans", "TIMS", "pubtrans tims", "late bus"],)], "t array<string>")
    assert df.select(topics.prune_bigrams(F.col("t"))).first()[0] == ["PubTrans", "TIMS", "late bus"]


def test_trend_scope_confidence(spark):
    day = lambda *n: [datetime(2024, 1, k) for k in n]
    df = spark.createDataFrame([(day(1, 2),), (day(1, 2, 3),), (day(1, 9, 10, 10),), (day(1, 5, 9, 13),)], "d array<timestamp>")
    assert [r[0] for r in df.select(scoring.trend(F.col("d"))).collect()] == ["ISOLATED", "ISOLATED", "ESCALATING", "RECURRING"]
    s = spark.createDataFrame([(0, 1), (0, 3), (0, 4), (2, 9), (4, 1)], "o int, p int").select(scoring.scope(F.col("o"), F.col("p")))
    assert [r[0] for r in s.collect()] == ["SINGLE", "CROSS_PERSON", "CROSS_TEAM", "CROSS_PERSON", "CROSS_TEAM"]
    c = spark.createDataFrame([(5, True), (5, False), (3, True), (2, True)], "n int, h boolean").select(scoring.confidence(F.col("n"), F.col("h")))
    assert [r[0] for r in c.collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
