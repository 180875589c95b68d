"""Texts are shuffled once for a step, and neither their words nor their terms."""

import re

from pyspark.sql import functions as F

from quern.operators import patterns, topics


def exchanges(df) -> list[str]:
    return re.findall(r"(?<!Reused)(?<!Broadcast)Exchange hashpartitioning\([^)]*\)", df._jdf.queryExecution().executedPlan().toString())


def test_scoring_moves_members_once(spark):
    rows = [(f"c{k % 9}", k // 9, k, f"Felet  åter{k % 2} igen{k % 4} igen{k % 4} saknas", f"p{k % 3}", ["o", "", None][k % 3], "2024-01-01") for k in range(40)] + [("d", 0, 99, None, None, None, None)]
    m = spark.createDataFrame(rows, "cluster string, pos int, id long, text string, person string, org string, date string").withColumn("date", F.col("date").cast("timestamp")).repartition(4, "cluster")
    out = patterns.scored(m, spark.createDataFrame([("c0", ["x y"])], "cluster string, topics array<string>").hint("broadcast"))
    assert len(exchanges(out)) == 1
    got = {r["cluster"]: r for r in out.collect()}
    want = {r["cluster"]: r["words"] for r in patterns.common_words(m, 0.5, 3).collect()}
    assert len(got) == 10 and got["c0"]["title"] == "x y — saknas" and got["d"]["title"] == "Mönster (1 ärenden)"
    assert all(got[c]["title"] == " ".join(want[c]) for c in want if c != "c0")


def test_topics_deal_texts_once(spark):
    """Asked and told in one place, also where each workspace is a corpus; its size moves as a number."""
    df = spark.createDataFrame([(k, f"w{k % 3}", f"alpha beta{k % 7} SAP{k % 5}", ["x"]) for k in range(90)], "id long, workspace string, text string, tags array<string>")
    out = topics.tf_idf(df, "workspace")
    found = {r["term"] for r in out.collect()}
    assert found >= {"SAP0", "SAP4", "beta6"} and "alpha" not in found
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert len([x for x in final if re.search(r" Exchange hashpartitioning\(g#\d+, slice#\d+, \d+\), REPARTITION_BY_NUM", x) and "ReusedExchange" not in x]) == 1
