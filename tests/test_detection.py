import numpy as np
from pyspark.sql import functions as F

from quern.operators import analytics, crm, patterns, records, relational
from quern.plans import pipelines

SCHEMA = "id long, text string, person string, org string, batch string, tags array<string>, date timestamp, workspace string"
THINGS = ["printer Foo jams", "login Bar breaks", "export Baz hangs"]


def tickets(spark, workspace, first):
    rows = []
    for k in range(36):
        text = f"{THINGS[k % 3]} again number {k // 6} in room{k % 5}"
        rows.append((first + k, text, f"p{k % 4}", f"o{k % 2}", None if k % 7 == 0 else f"b{k}", ["t"], f"2024-01-{k % 28 + 1:02d}", workspace))
    return spark.createDataFrame(rows, SCHEMA.replace("timestamp", "string")).withColumn("date", F.col("date").cast("timestamp"))


def vectors(spark, first):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(3, 8))
    return spark.createDataFrame([(first + k, [float(x) for x in centres[k % 3] + 0.05 * rng.normal(size=8)]) for k in range(36)], "id long, vector array<double>")


def found(df, vecs, **more):
    cols = ["workspace", "cluster", "title", "trend", "scope", "confidence", "topics", "ids"]
    return {tuple(str(r[c]) for c in cols) for r in pipelines.detect(records.with_ordinal(df), vecs, **more).select(*cols).collect()}


def test_a_run_per_workspace(spark):
    """Equal records in two workspaces, whose names are awkward, give what each gives alone."""
    a, b = tickets(spark, "x/y", 0), tickets(spark, "", 1000)
    va, vb = vectors(spark, 0), vectors(spark, 1000)
    none = a.limit(5).withColumn("workspace", F.lit(None).cast("string")).withColumn("id", F.col("id") + 5000)
    alone = found(a, va) | found(b, vb)
    assert len(alone) >= 4 and {w for w, *_ in alone} == {"x/y", ""}
    assert found(a.union(b).union(none), va.union(vb)) == alone


def test_existing_titles_are_a_workspace_s(spark):
    a, va = tickets(spark, "x", 0), vectors(spark, 0)
    titles = {(r[0], r[2]) for r in found(a, va)}
    first = min(t for _, t in titles)
    old = spark.createDataFrame([("x", first.upper()), ("y", max(t for _, t in titles))], "workspace string, title string")
    assert {(r[0], r[2]) for r in found(a, va, existing_titles=old)} == titles - {("x", first)}


def test_detection_merges_alike_clusters(spark):
    """Of six clusters of six, two for each subject, those whose topics are alike become one."""
    got = found(tickets(spark, "x", 0), vectors(spark, 0), target_max=6, target_min=4)
    ids = [eval(r[-1]) for r in got]
    assert sorted(i for x in ids for i in x) == list(range(36)) and 3 <= len(ids) < 6 and max(map(len, ids)) == 12
    assert all(len({i % 3 for i in x}) == 1 for x in ids)


def test_tags_by_shared_words(spark):
    rows = [(1, "Skrivaren-fungerar inte, hjälp", []), (2, "skrivaren nere", ["print"]), (3, "hjälp med skrivaren", ["help", "print"]), (4, "fungerar sedan igår", ["other"])]
    df = spark.createDataFrame(rows, "id long, text string, tags array<string>")
    assert [(r["tag"], r["score"]) for r in relational.suggested_tags(df, 1).collect()] == [("print", 3), ("help", 2), ("other", 1)]
    bare = df.withColumn("tags", F.when(F.col("id") == 1, F.array(F.lit("z"))).otherwise(F.array().cast("array<string>")))
    names = spark.createDataFrame([("c",), ("b",), ("z",), ("a",)], "name string")
    assert [(r["tag"], r["score"]) for r in relational.suggested_tags(bare, 1, names).collect()] == [("z", 0), ("a", 0), ("b", 0)]


def test_crossing_are_the_related(spark):
    rng = np.random.default_rng(2)
    words = list("abcdef")
    rows = [(k, f"{rng.choice(['one', 'two', 'xx'])} — {k}" if k % 3 else f"t{k}", [str(w) for w in rng.choice(words, rng.integers(0, 5))]) for k in range(40)]
    df = spark.createDataFrame(rows, "id long, title string, topics array<string>")
    want = {x for r in analytics.related(df).collect() for x in (r["a"], r["b"])}
    assert {r["id"] for r in analytics.crossing(df).collect()} == want


def test_containing_is_contains(spark):
    names = ["", "a", "ab", "abc", "abcd", "xabcdy", "bcd", "zz", "aab"]
    df = spark.createDataFrame([(n,) for n in names], "whole string")
    got = {(r["whole"], r["part"]) for r in crm.containing(df, df.toDF("part")).collect()}
    assert got == {(a, b) for a in names for b in names if b in a}


def test_linkage_is_the_average_of_pairs(spark):
    rng = np.random.default_rng(4)
    x = [*rng.normal(size=(7, 4)), np.zeros(4)]
    df = spark.createDataFrame([(1, [float(v) for v in r]) for r in x] + [(2, [1.0, 0.0, 0.0, 0.0])], "cluster int, vector array<double>")
    unit = [r / np.linalg.norm(r) if r.any() else r for r in x]
    want = np.mean([unit[i] @ unit[j] for i in range(8) for j in range(i + 1, 8)])
    got = patterns.linkage(df).collect()
    assert len(got) == 1 and got[0]["n"] == 28 and abs(got[0]["linkage"] - want) < 1e-12


def test_descriptions(spark):
    """Reporters without a name are none, also among the first five; five topics are named; three texts are shown."""
    people = [None, "", "a", "b", "a", "c", "d", "e", "f"]
    rows = [(1, k, k, None if k == 1 else f"text {k}", p, "", f"2024-01-{1 + k:02d}") for k, p in enumerate(people)] + [(2, 0, 20, "x", "", "o", None), (2, 1, 21, "y", None, "o", None)]
    m = spark.createDataFrame(rows, "cluster int, pos int, id long, text string, person string, org string, date string").withColumn("date", F.col("date").cast("timestamp"))
    topics = spark.createDataFrame([(1, list("uvwxyz"))], "cluster int, topics array<string>")
    got = {r["cluster"]: r for r in patterns.scored(m, topics).collect()}
    assert got[1]["description"] == "9 ärenden. Ämnen: u, v, w, x, y. Scope: CROSS_TEAM. Trend: RECURRING. Rapportörer: a, b, c, d, e."
    assert got[2]["description"] == "2 ärenden. Scope: SINGLE. Trend: ISOLATED. Rapportörer: ." and got[1]["topics"] == list("uvwxy")
    assert [tuple(e) for e in got[1]["evidence"]] == [("text 0", "Okänd"), ("", "Okänd"), ("text 2", "a")] and got[1]["ids"] == list(range(9))
