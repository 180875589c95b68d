"""Batches that do not depend on how rows are dealt, and passes whose calls fail."""

import json

from quern.operators import batches, replies


def rows(spark, n=103):
    return spark.createDataFrame([(k, f"t{k}") for k in range(n)], "id long, text string")


def test_same_batches_for_any_partitioning(spark):
    want = {k: (k // 10, k % 10) for k in range(103)}
    for n in (1, 3, 17):
        got = batches.assembled(rows(spark).repartition(n), 10).collect()
        assert {r["id"]: (r["batch"], r["place"]) for r in got} == want
    by = batches.assembled(rows(spark).selectExpr("id", "text", "id % 2 as w"), 10, by="w").collect()
    assert {r["id"]: (r["w"], r["batch"], r["place"]) for r in by} == {k: (k % 2, k // 2 // 10, k // 2 % 10) for k in range(103)}
    assert batches.assembled(rows(spark).limit(0), 10).count() == 0


def test_passes_with_failing_calls(spark):
    placed = batches.assembled(rows(spark, 30), 10)

    def call(texts):
        if "t10" in texts:
            raise RuntimeError("down")
        return "no list" if "t20" in texts else json.dumps([t.upper() for t in texts[:-1]] + [None, "too many"])

    found = batches.asked(placed, call)
    assert {r["id"]: r["content"] for r in replies.normalised(found, placed).collect()} == {k: f"T{k}" for k in range(9)} | {}
    assert tuple(replies.pass_status(found, replies.NORMALISED).first()) == (3, 1)


def test_polish_falls_back(spark):
    titles = rows(spark, 20).selectExpr("id", "text as title", "text as prompt")

    def several(prompts):
        if "t0" in prompts:
            raise RuntimeError("down")
        return "<think>[x]</think>" + json.dumps(["x" * 100 if p == "t9" else f"Title: new {p}" for p in prompts])

    def one(prompt):
        if prompt == "t1":
            raise RuntimeError("down")
        return "" if prompt == "t2" else f"1. one {prompt}"

    got = {r["id"]: (r["title"], r["source"]) for r in replies.polished(titles, several, one, size=8).collect()}
    want = {k: (f"one t{k}", "single") for k in (0, 3, 4, 5, 6, 7)} | {1: ("t1", "original"), 2: ("t2", "original")}
    assert {k: got[k] for k in want} == want and len(got) == 20
    plain = {r["source"] for r in replies.polished(titles, several, None, size=8).collect()}
    assert plain <= {"batch", "original"}
