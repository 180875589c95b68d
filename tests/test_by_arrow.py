"""Functions of texts that Arrow runs, against the engine's own patterns; and plans that look at a text once."""

import random

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as T
from quern.operators import records


def _texts():
    random.seed(5)
    some = ["[NR]", "SQLJob:", "SQLJob", "heartbeat", "hållplats", "flytt", "HÅLLPLATS", "möte", "Mötet", "FW: ", "re:", "sv: ", "ping", "ping x", "FEL", "fel", "fungerar inte", "långsam", "LÅNGSAM", "felet", "åfel", "#1", "(a)", "{b}", "SAP", "SapHana", "Ångström", "ÅNG", "xÅNG", "foo SapHana", "a. Berlin", "a Oslo9"]
    gaps = [" ", "  ", "\t", " ", "\n", "  ", ""]
    return [None, "", " ", *("".join(random.choice([random.choice(gaps), random.choice(some)]) for _ in range(random.randint(1, 9))) for _ in range(800))]


def test_as_the_engine(spark):
    """Classes, titles, actions and names are those of the column expressions there were before."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(_texts())], "id long, t string")
    t = F.col("t")
    tables = {"monitoring_alert": fixed.MONITORING, "config_change": fixed.CONFIG, "administrative": fixed.ADMIN, "forwarded_email": fixed.FORWARD}
    title = T.trim(F.regexp_replace(T.squeeze(F.regexp_replace(F.lower(t), f"^(?:fw|fwd|vb|sv|re):{T.SPACE}*", "")), r"[#\[\](){}]", ""))
    acts = F.filter(F.array(*[F.when(t.rlike(f"(?iu){T.EDGE}{a}{T.EDGE}"), F.lit(a)) for a in fixed.ACTIONS]), lambda a: a.isNotNull())
    nouns = [f"{T.EDGE}([A-ZÄÖÅ][A-ZÄÖÅ0-9]{{2,19}}){T.EDGE}", f"{T.EDGE}([A-ZÄÖÅ][a-zäöå]+[A-ZÄÖÅ][a-zA-ZäöåÄÖÅ0-9]*){T.EDGE}", f"[a-zäöå.,;:]{T.SPACE}+([A-ZÄÖÅ][a-zäöåA-ZÄÖÅ0-9]{{3,}}){T.EDGE}"]
    names = F.filter(F.array_distinct(F.concat(*[F.regexp_extract_all(t, F.lit(p), 1) for p in nouns])), lambda w: ~T.is_noise_token(w))
    for new, old in ((T.classify(t), T.classify(t, tables)), (T.normalize_title(t), title), (T.actions(t), acts), (T.proper_nouns(t), names)):
        rows = df.select("id", "t", new.alias("new"), old.alias("old")).where(~F.col("new").eqNullSafe(F.col("old"))).collect()
        assert rows == []


def _udfs(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython")


def test_texts_are_classified_once_for_a_context(spark):
    """Before, classes and noise were two scans; a context of no records still has its row of noise."""
    df = records.classified(spark.createDataFrame([(1, "HeartBeat", "p", ["x"]), (2, "a", "p", None)], "id long, text string, person string, tags array<string>"))
    got = {(r["kind"], r["value"], r["n"]) for r in records.batch_context(df).collect()}
    assert got == {("person", "p", 2), ("tag", "x", 1), ("class", "monitoring_alert", 1), ("class", "customer_incident", 1), ("noise", "noise", 1)}
    assert _udfs(records.batch_context(df)) == 1
    assert [tuple(r) for r in records.batch_context(df.where("id > 5")).collect()] == [("noise", "noise", 0)]


def test_titles_meet_by_digest(spark):
    """No exchange is keyed by a whole text."""
    df = records.with_ordinal(spark.createDataFrame([(k, t, "p", "b", ["x"]) for k, t in enumerate(["RE: a  b", "a b", None, None])], "id long, text string, person string, batch string, tags array<string>").withColumn("date", F.lit("2024-01-01").cast("timestamp")))
    out = records.with_duplicates(df)
    assert {(r["id"], r["is_duplicate"]) for r in out.collect()} == {(0, False), (1, True), (2, False), (3, True)}
    assert "sha2" in out._jdf.queryExecution().optimizedPlan().toString()
