"""Queries over imports, model replies, feeds, evaluation and what a workspace shows."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import analytics, batches, entities, evaluate, imports, records, relational, replies
from quern.plans.bind import TICKETS, query, table, tickets
from quern.plans.corpus_queries import _ACTIONS_SQL, NOUNS
from quern.operators.lineage import checkpoint_dir, kept
from quern.sources import feeds, readers
from quern.sources.log import TableLog

#: Rows of a spreadsheet over customers, as SQL; the frame below is the same.
_ROWS = """r AS (SELECT c_custkey AS ordinal, 'C-' || c_custkey AS case_number, c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment || ' text' END AS description,
  CASE WHEN c_custkey % 7 = 0 THEN '' ELSE 'owner ' || c_nationkey END AS owner, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment END AS account, CASE WHEN c_acctbal < 0 THEN 'late' ELSE '' END AS status,
  CASE WHEN c_custkey % 2 = 0 THEN 'phone' ELSE '' END AS support_type, CASE WHEN c_custkey % 4 = 1 THEN 'bug' ELSE '' END AS case_type, 'P' || c_custkey % 4 AS priority, '' AS product FROM customer)"""


def sheet(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    text = lambda cond, value: F.when(cond, "").otherwise(value)
    return c.select(
        k.alias("ordinal"), F.concat(F.lit("C-"), k.cast("string")).alias("case_number"), F.col("c_name").alias("title"), text(k % 3 == 0, F.concat("c_mktsegment", F.lit(" text"))).alias("description"),
        text(k % 7 == 0, F.concat(F.lit("owner "), F.col("c_nationkey").cast("string"))).alias("owner"), text(k % 5 == 0, F.col("c_mktsegment")).alias("account"), text(F.col("c_acctbal") >= 0, F.lit("late")).alias("status"),
        text(k % 2 != 0, F.lit("phone")).alias("support_type"), text(k % 4 != 1, F.lit("bug")).alias("case_type"), F.concat(F.lit("P"), (k % 4).cast("string")).alias("priority"), F.lit("").alias("product"), F.lit("").alias("created_at"),
    )


@query("import_preview", f"""WITH {_ROWS}, e AS (SELECT 'rows' AS kind, '' AS value FROM r UNION ALL SELECT 'owner', owner FROM r WHERE owner <> '' UNION ALL SELECT 'account', account FROM r WHERE account <> ''
UNION ALL SELECT 'status', status FROM r WHERE status <> '' UNION ALL SELECT 'type', coalesce(nullif(support_type, ''), case_type) FROM r WHERE support_type <> '' OR case_type <> '') SELECT kind, value, count(*) AS n FROM e GROUP BY 1, 2""")
def import_preview(spark, sf_dir):
    return imports.preview(sheet(spark, sf_dir))


@query("import_sample", f"WITH {_ROWS} SELECT case_number, title, owner, account, status, priority FROM r ORDER BY ordinal LIMIT 5")
def import_sample(spark, sf_dir):
    return imports.sample(sheet(spark, sf_dir))


_KNOWN = "known AS (SELECT n_nationkey AS person_id, 'owner ' || n_nationkey AS name FROM nation WHERE n_nationkey % 2 = 0)"


def _persons(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("person_id"), F.concat(F.lit("owner "), F.col("n_nationkey").cast("string")).alias("name"))


@query("import_persons", f"""WITH {_ROWS}, {_KNOWN}, o AS (SELECT coalesce(nullif(owner, ''), 'Ej tilldelad') AS name, min(ordinal) AS first FROM r WHERE owner NOT IN ('owner 3', 'owner 4') GROUP BY 1)
SELECT name, row_number() OVER (ORDER BY first, name) AS sort_order FROM o WHERE name NOT IN (SELECT name FROM known)""")
def import_persons(spark, sf_dir):
    return imports.missing_persons(imports.without_owners(sheet(spark, sf_dir), ["owner 3", "owner 4"]), _persons(spark, sf_dir))


@query("import_records", f"""WITH {_ROWS}, {_KNOWN} SELECT ordinal, person_id, CASE WHEN description = '' THEN title ELSE title || chr(10) || left(description, 500) END AS text, nullif(account, '') AS customer
FROM r JOIN known ON name = coalesce(nullif(owner, ''), 'Ej tilldelad')""")
def import_records(spark, sf_dir):
    return imports.records(sheet(spark, sf_dir), _persons(spark, sf_dir), F.lit("2024-01-01").cast("timestamp")).drop("created_at")


@query("import_tags", f"WITH {_ROWS} SELECT ordinal, support_type AS tag FROM r WHERE support_type <> '' UNION SELECT ordinal, priority FROM r WHERE priority <> '' UNION SELECT ordinal, product FROM r WHERE product <> ''")
def import_tags(spark, sf_dir):
    return imports.tag_rows(sheet(spark, sf_dir))


@query("import_touched", "SELECT s_suppkey AS person_id, CASE WHEN s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49) THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS last_active_at FROM supplier")
def import_touched(spark, sf_dir):
    persons = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.lit("2024-01-01").cast("timestamp").alias("last_active_at"))
    active = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("person_id"))
    return imports.touched(persons, active, F.lit("2024-06-01").cast("timestamp")).withColumn("last_active_at", F.col("last_active_at").cast("timestamp_ntz"))


@query("team_persons", """WITH m AS (SELECT n_regionkey AS team_id, c_custkey AS person_id FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT c_custkey % 5, c_custkey FROM customer)
SELECT person_id, min(team_id) AS team_id, any_value(c_name) AS name FROM m JOIN customer ON c_custkey = person_id GROUP BY 1""")
def team_persons(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    home = c.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").cast("int").alias("team_id"), F.col("c_custkey").alias("person_id"))
    links = home.union(c.select((F.col("c_custkey") % 5).cast("int"), "c_custkey")).withColumn("sort_order", F.col("person_id"))
    teams = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("team_id"), F.col("r_regionkey").alias("team_order"))
    return imports.team_persons(teams, links, c.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name")))


@query("record_scan", """WITH s AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS session_id, TIMESTAMP '2024-03-01' + to_hours(CAST(conv_id AS INTEGER)) AS started_at FROM conversations),
d AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id // 2 AS VARCHAR) END AS sid, CASE WHEN doc_id % 5 = 0 THEN 'i' || doc_id % 7 END AS iid, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lower(text) END AS norm, TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS created_at FROM documents)
SELECT doc_id AS id, md5(coalesce(nullif(norm, ''), text)) AS text_md5, c_name AS person, c_mktsegment AS org, coalesce(sid, iid, CAST(doc_id AS VARCHAR)) AS batch,
CASE WHEN l.doc_id IS NULL THEN '' ELSE 'quality' || quality || ',toxic' || toxic END AS tags, coalesce(started_at, created_at) AS date
FROM d JOIN customer ON c_custkey = doc_id % 400 LEFT JOIN s ON session_id = sid LEFT JOIN labels l USING (doc_id)""")
def record_scan(spark, sf_dir):
    k = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(
        k.alias("id"), (k % 400).alias("person_id"), F.when(k % 2 == 0, F.floor(k / 2).cast("string")).alias("session_id"), F.when(k % 5 == 0, F.concat(F.lit("i"), (k % 7).cast("string"))).alias("import_id"),
        F.col("text").alias("raw"), F.when(k % 3 == 0, "").otherwise(F.lower("text")).alias("normalized"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + (k % 60) * 86_400_000_000).alias("created_at"), F.col("source").alias("workspace"),
    )
    persons = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("person"), F.col("c_mktsegment").alias("org"))
    sessions = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("session_id"), F.timestamp_micros(F.lit(1_709_251_200_000_000) + F.col("conv_id") * 3_600_000_000).alias("started_at")).distinct()
    labels = table(spark, sf_dir, "labels")
    links = labels.select(F.col("doc_id").alias("id"), F.explode(F.array(F.concat(F.lit("quality"), F.col("quality").cast("string")), F.concat(F.lit("toxic"), F.col("toxic").cast("string")))).alias("tag_id"))
    found = records.scan(d, persons, sessions, links, links.select("tag_id", F.col("tag_id").alias("name")).distinct())
    return found.select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"), "person", "org", "batch", F.array_join("tags", ",").alias("tags"), F.col("date").cast("timestamp_ntz").alias("date"))


@query("pattern_detail", """WITH l AS (SELECT o_custkey AS pattern_id, list(o_orderkey || ':' || o_orderstatus || ':' || lines ORDER BY o_orderkey) AS r FROM orders JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1),
s AS (SELECT p_partkey % 100 AS pattern_id, list(p_name ORDER BY p_name) AS n FROM part WHERE p_size < 5 GROUP BY 1), e AS (SELECT s_suppkey % 50 AS pattern_id, list(s_name || ':' || n_name ORDER BY s_name) AS x FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1)
SELECT c_custkey AS pattern_id, coalesce(array_to_string(r, ','), '') AS records, coalesce(array_to_string(n, ','), '') AS suggestions, coalesce(array_to_string(x, ','), '') AS evidence
FROM customer LEFT JOIN l ON l.pattern_id = c_custkey LEFT JOIN s ON s.pattern_id = c_custkey LEFT JOIN e ON e.pattern_id = c_custkey""")
def pattern_detail(spark, sf_dir):
    """Patterns with their records (and what these hold), suggestions and evidence with its snapshot."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("lines"))
    held = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("pattern_id"), "o_orderkey", "o_orderstatus", "lines")
    advice = table(spark, sf_dir, "part").where("p_size < 5").select((F.col("p_partkey") % 100).alias("pattern_id"), "p_name")
    proof = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 50).alias("pattern_id"), "s_name", "n_name")
    out = relational.branches(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pattern_id")), "pattern_id", records=held, suggestions=advice, evidence=proof)
    return out.select(
        "pattern_id", F.array_join(F.transform("records", lambda x: F.concat_ws(":", x["o_orderkey"].cast("string"), x["o_orderstatus"], x["lines"].cast("string"))), ",").alias("records"),
        F.array_join(F.transform("suggestions", lambda x: x["p_name"]), ",").alias("suggestions"), F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["s_name"], x["n_name"])), ",").alias("evidence"),
    )


@query("workspace_tree", """WITH m AS (SELECT c_nationkey AS team_id, list(c_custkey || ':' || orders ORDER BY c_custkey) AS members FROM customer JOIN (SELECT c_custkey AS k, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON k = c_custkey GROUP BY 1)
SELECT r_name AS workspace, n_name AS team, coalesce(array_to_string(members, ','), '') AS members FROM nation JOIN region ON r_regionkey = n_regionkey LEFT JOIN m ON team_id = n_nationkey""")
def workspace_tree(spark, sf_dir):
    """A workspace's teams, and their persons with how many records each has."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("team_id"), F.col("c_custkey").alias("person_id"))
    c = relational.with_count(c, table(spark, sf_dir, "orders"), "person_id", "o_custkey", "records").select("team_id", "person_id", "records")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("team_id"), F.col("r_name").alias("workspace"), F.col("n_name").alias("team"))
    out = relational.branches(n, "team_id", members=c)
    return out.select("workspace", "team", F.array_join(F.transform("members", lambda x: F.concat_ws(":", x["person_id"].cast("string"), x["records"].cast("string"))), ",").alias("members"))


@query("unnormalised", "SELECT doc_id AS id FROM documents WHERE doc_id % 3 = 0")
def unnormalised(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.lower("text")).alias("normalized"))
    return records.unnormalised(d).select("id")


@query("embedding_texts", f"WITH {TICKETS} SELECT id, md5(CASE WHEN id % 2 = 0 THEN text || ' [' || array_to_string(tags, ', ') || ']' ELSE text END) AS text_md5 FROM tickets")
def embedding_texts(spark, sf_dir):
    tags = F.when(F.col("id") % 2 == 0, F.col("tags")).otherwise(F.array().cast("array<string>"))
    return tickets(spark, sf_dir).select("id", F.md5(records.embedding_text(F.col("text"), tags).cast("binary")).alias("text_md5"))


@query("open_counts", "SELECT o_custkey AS person, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus <> 'O') AS other FROM orders GROUP BY 1")
def open_counts(spark, sf_dir):
    return records.open_counts(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person"), F.when(F.col("o_orderstatus") == "O", "OPEN").otherwise("CLOSED").alias("status")))


@query("captured_counts", "SELECT n_nationkey AS person_id, count(conv_id) AS n FROM nation LEFT JOIN conversations ON CASE WHEN role = 'user' THEN 'FRANCE' ELSE 'GERMANY' END = n_name GROUP BY 1")
def captured_counts(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "FRANCE").otherwise("GERMANY").alias("person"))
    return records.captured_counts(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("person_id"), F.col("n_name").alias("name")), said)


@query("offered_tags", "SELECT p_partkey AS tag_id, p_name AS name FROM part WHERE contains(lower(p_name), 'ring') AND p_partkey % 3 <> 0 ORDER BY p_name, p_partkey LIMIT 6")
def offered_tags(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("name"))
    return relational.offered_tags(p, p.where("tag_id % 3 = 0"), "RinG")


@query("checked_kinds", "SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'good' ELSE 'bad' END AS kind, count(*) AS n FROM orders GROUP BY 1")
def checked_kinds(spark, sf_dir):
    good, bad = relational.checked(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])
    return good.select(F.lit("good").alias("kind")).union(bad.select(F.lit("bad").alias("kind"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("by_key", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def by_key(spark, sf_dir):
    return relational.by_key(table(spark, sf_dir, "orders"), "o_orderkey", 7).select("o_orderkey", "o_custkey", "o_totalprice")


_REPLIES = """p AS (SELECT p_partkey, p_brand, p_type FROM part), r AS (SELECT p_partkey AS batch, p_partkey % 4 = 0 AS broken, p_brand || ' ' || p_partkey AS title, p_partkey AS k FROM p)"""


def _replies(spark, sf_dir):
    """A reply per part: prose, then a list of two patterns; every fourth is no JSON, and every tenth has no list."""
    k, text = F.col("p_partkey"), lambda c: c.cast("string")
    one = F.concat(F.lit('{"title": "'), "p_brand", F.lit(" "), text(k), F.lit('", "description": "d", "patternType": "ESCALATING", "challengeIds": ["'), text(k % 200), F.lit('", "none", "'), text((k + 1) % 200), F.lit('"], "suggestion": "do it"}'))
    two = F.concat(F.lit('{"title": "alone '), text(k), F.lit('", "challengeIds": ["'), text(k % 200), F.lit('", "none"]}'))
    reply = F.when(k % 10 == 0, "nothing new").when(k % 4 == 0, F.concat(F.lit("so: ["), one, F.lit(", {broken]"))).otherwise(F.concat(F.lit("so: ["), one, F.lit(", "), two, F.lit("] end")))
    return table(spark, sf_dir, "part").select(k.alias("batch"), reply.alias("reply"))


@query("reply_status", "SELECT CASE WHEN p_partkey % 4 = 0 AND p_partkey % 10 <> 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n FROM part GROUP BY 1")
def reply_status(spark, sf_dir):
    return replies.parsed(_replies(spark, sf_dir)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("reply_patterns", """SELECT p_partkey AS batch, 0 AS place, p_brand || ' ' || p_partkey AS title, 'd' AS description, 'ESCALATING' AS pattern_type, p_partkey % 200 || ',' || (p_partkey + 1) % 200 AS ids, 'do it' AS suggestion
FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 0 AND p_partkey NOT IN (1, 3)""")
def reply_patterns(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.where("p_partkey IN (1, 3)").select(F.upper(F.concat_ws(" ", "p_brand", F.col("p_partkey").cast("string"))).alias("title"))
    out = replies.detected(_replies(spark, sf_dir), spark.range(200), known)
    return out.withColumn("ids", F.array_join("ids", ","))


@query("stored_patterns", """SELECT 'patterns' AS name, count(*) AS n, sum(2) AS links FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 0
UNION ALL SELECT 'pattern_links', 2 * count(*), NULL FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 0 UNION ALL SELECT 'suggestions', count(*), NULL FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 10 <> 0""".replace(", sum(2) AS links", "").replace(", NULL", ""))
def stored_patterns(spark, sf_dir):
    made = replies.tables(replies.detected(_replies(spark, sf_dir), spark.range(200)).withColumnRenamed("batch", "pattern_id"))
    counts = [df.agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n")) for k, df in made.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("distribution", "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1")
def distribution(spark, sf_dir):
    return evaluate.distribution(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("count_map", "SELECT string_agg(value || '=' || n, ',' ORDER BY value) AS counts FROM (SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1)")
def count_map(spark, sf_dir):
    m = evaluate.count_map(table(spark, sf_dir, "orders"), "o_orderpriority")
    return m.select(F.array_join(F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


_SCENARIO = """det AS (SELECT p_partkey AS pattern, p_name AS title, [CAST(p_partkey AS BIGINT), p_partkey + 1, p_partkey + 2] AS ids, CASE WHEN p_partkey % 5 = 0 THEN 'OTHER' ELSE 'RECURRING' END AS pattern_type FROM part WHERE p_partkey <= 40),
want AS (SELECT n_nationkey AS expected, [lower(n_name), p_brand, split_part(p_name, ' ', 1)] AS keywords, [CAST(n_nationkey * 2 AS BIGINT), n_nationkey * 2 + 1] AS include, [CAST(n_nationkey AS BIGINT)] AS exclude FROM nation JOIN part ON p_partkey = n_nationkey * 3 + 1),
named AS (SELECT DISTINCT expected, pattern FROM (SELECT expected, unnest(keywords) AS w FROM want) k JOIN det ON contains(lower(title), lower(w)))"""


def _scenario(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    det = p.where("p_partkey <= 40").select(k.alias("pattern"), F.col("p_name").alias("title"), F.array(k, k + 1, k + 2).alias("ids"), F.when(k % 5 == 0, "OTHER").otherwise("RECURRING").alias("pattern_type"))
    n = F.col("n_nationkey").cast("long")
    want = table(spark, sf_dir, "nation").join(p, k == n * 3 + 1).select(
        F.col("n_nationkey").alias("expected"), F.array(F.lower("n_name"), F.col("p_brand"), F.split("p_name", " ")[0]).alias("keywords"), F.array(n * 2, n * 2 + 1).alias("include"), F.array(n).alias("exclude")
    )
    return det, want


@query("expected_matches", f"WITH {_SCENARIO} SELECT expected, pattern FROM named UNION SELECT expected, pattern FROM want JOIN det ON list_has_all(ids, include)")
def expected_matches(spark, sf_dir):
    return evaluate.matched(*_scenario(spark, sf_dir))


@query("scenario_score", f"""WITH {_SCENARIO}, link AS (SELECT pattern, unnest(ids) AS id FROM det), hit AS (SELECT expected FROM named UNION SELECT expected FROM want JOIN det ON list_has_all(ids, include)),
stuffed AS (SELECT count(*) AS n FROM (SELECT named.pattern, unnest(exclude) AS id FROM named JOIN want USING (expected)) x JOIN link USING (pattern, id)),
dup AS (SELECT count(*) AS n FROM (SELECT a.pattern, b.pattern FROM link a JOIN link b ON a.id = b.id AND a.pattern < b.pattern GROUP BY 1, 2 HAVING count(*) / 3.0 > 0.5)),
s AS (SELECT (SELECT count(*) FROM det) AS n, (SELECT count(*) FROM link) AS links, (SELECT count(*) FROM link WHERE id > 35) AS unknown, (SELECT n FROM stuffed) AS stuffed, (SELECT count(*) FROM want) AS wanted, (SELECT count(*) FROM hit) AS hits, (SELECT count(DISTINCT pattern) FROM named) AS precise, (SELECT count(*) FROM det WHERE pattern_type = 'RECURRING') AS typed, (SELECT n FROM dup) AS dups),
q AS (SELECT CASE WHEN n BETWEEN 5 AND 30 THEN 1.0 WHEN n < 5 THEN n / 5 ELSE 30.0 / n END AS count_fit, hits / wanted AS matched, precise / n AS precise, greatest(0.0, 1 - (unknown + stuffed) / links) AS unstuffed, typed / n AS type_fit, greatest(0.0, 1 - dups / (n - 1)) AS no_overlap FROM s)
SELECT round(count_fit, 8) AS count_fit, round(matched, 8) AS matched, round(precise, 8) AS precise, round(unstuffed, 8) AS unstuffed, round(type_fit, 8) AS type_fit, round(no_overlap, 8) AS no_overlap,
round(count_fit * 0.1 + matched * 0.25 + precise * 0.2 + unstuffed * 0.2 + type_fit * 0.15 + no_overlap * 0.1, 8) AS score FROM q""")
def scenario_score(spark, sf_dir):
    out = evaluate.scenario_parts(*_scenario(spark, sf_dir), spark.range(36), 5, 30)
    return out.select(*[F.round(c, 8).alias(c) for c in out.columns])


@query("threshold_sweep", """WITH t AS (SELECT unnest([0.36, 0.39, 0.42, 0.45])::DOUBLE AS threshold), m AS (SELECT threshold, p_partkey % CAST(threshold * 1000 AS INTEGER) AS pattern, p_partkey AS id FROM part, t WHERE p_partkey % 100 < threshold * 200),
z AS (SELECT threshold, pattern, count(*) AS n FROM m GROUP BY 1, 2), c AS (SELECT threshold, count(DISTINCT id) AS covered FROM m GROUP BY 1)
SELECT threshold, count(*) AS patterns, max(n) AS max_size, count(*) FILTER (n > 15) AS catch_alls, round(any_value(covered) * 100 / (SELECT count(*) FROM part), 1) AS coverage FROM z JOIN c USING (threshold) GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    run = lambda t: p.where(F.col("id") % 100 < F.lit(t * 200)).withColumn("pattern", F.col("id") % int(t * 1000))
    return evaluate.sweep(run, p).select("threshold", "patterns", "max_size", "catch_alls", "coverage")


@query("feed_snapshots", """WITH t AS (SELECT user_id % 20 AS connection_id, event_type AS category, CASE WHEN event_id = 11 THEN 'HTTP 500' END AS error FROM events)
SELECT connection_id, category, count(*) AS ticket_count FROM t WHERE connection_id NOT IN (SELECT connection_id FROM t WHERE error IS NOT NULL) GROUP BY 1, 2""")
def feed_snapshots(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("connection_id"), F.col("event_type").alias("category"), F.when(F.col("event_id") == 11, "HTTP 500").alias("error"))
    return feeds.synced(e, F.lit("2024-06-01").cast("timestamp"))[0].drop("snapshot_date")


@query("feed_states", """WITH t AS (SELECT user_id % 20 AS connection_id, CASE WHEN event_id = 11 THEN 'HTTP 500' END AS error FROM events), s AS (SELECT connection_id, max(error) AS error FROM t GROUP BY 1)
SELECT connection_id, CASE WHEN s.connection_id IS NULL THEN 'SYNCING' WHEN error IS NULL THEN 'IDLE' ELSE 'ERROR' END AS sync_status FROM (SELECT unnest(range(25)) AS connection_id) LEFT JOIN s USING (connection_id)""".replace("SELECT connection_id, CASE WHEN s.", "SELECT connection_id, CASE WHEN s."))
def feed_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("connection_id"), F.col("event_type").alias("category"), F.when(F.col("event_id") == 11, "HTTP 500").alias("error"))
    c = spark.range(25).select(F.col("id").alias("connection_id"), F.lit("IDLE").alias("sync_status"), F.lit(None).cast("timestamp").alias("last_sync_at"))
    return feeds.with_state(feeds.syncing(c, list(range(25))), feeds.synced(e, F.lit("2024-06-01").cast("timestamp"))[1]).select("connection_id", "sync_status")


@query("loose_vertices", """SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS path, CASE WHEN p_partkey % 3 = 0 THEN 'CODE' ELSE 'DOC' END AS kind, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) ELSE 50 END AS trust_level,
p_partkey % 5 = 0 AS source_of_truth, 'active' AS status FROM part WHERE p_partkey % 7 <> 0""")
def loose_vertices(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 7 == 0, "").otherwise(F.col("p_name")).alias("path"), F.when(k % 3 == 0, "code").otherwise("page").alias("kind"), F.when(k % 2 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("much").alias("trust_level"),
        F.when(k % 5 == 0, "TRUE").otherwise("no").alias("source_of_truth"),
    )
    return readers.vertices(rows, "documents").select("id", "path", "kind", "trust_level", "source_of_truth", "status")


@query("described_topics", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE lower(p_brand) || '|' || lower(p_type) END AS topics FROM part")
def described_topics(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 3 == 0, "3 ärenden. Scope: SINGLE.").otherwise(F.concat(F.lit("3 ärenden. Ämnen: "), "p_brand", F.lit(", "), "p_type", F.lit(". Scope: SINGLE.")))
    return table(spark, sf_dir, "part").select(k.alias("id"), F.array_join(T.described_topics(text), "|").alias("topics"))


@query("shown_values", """SELECT p_partkey AS id, upper(left(split_part(p_name, ' ', 1), 1)) || upper(left(split_part(p_name, ' ', 2), 1)) AS initials,
CASE WHEN p_partkey * 997 < 1024 THEN p_partkey * 997 || ' B' WHEN p_partkey * 997 < 1048576 THEN CAST(round(p_partkey * 997 / 1024, 0) AS BIGINT) || ' KB' ELSE printf('%.1f', p_partkey * 997 / 1048576) || ' MB' END AS size FROM part""")
def shown_values(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), T.initials(F.col("p_name")).alias("initials"), T.file_size(k * 997).alias("size"))


@query("shown_dates", f"SELECT o_orderkey AS id, day(o_orderdate) || ' ' || {T.MONTHS!r}[month(o_orderdate)] || ' ' || year(o_orderdate) AS shown FROM orders")
def shown_dates(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), T.swedish_date(F.col("o_orderdate")).alias("shown"))


@query("level_order", """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END AS group_place, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_custkey DESC, o_orderkey) AS place FROM orders""")
def level_order(spark, sf_dir):
    level = F.element_at(F.array(*map(F.lit, analytics.LEVELS)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), level.alias("level"), F.col("o_custkey").alias("score"))
    return analytics.in_level_order(o).select("id", F.col("group_place").cast("int").alias("group_place"), "place")


@query("import_order", "SELECT p_partkey AS import_id, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part")
def import_order(spark, sf_dir):
    return analytics.in_import_order(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("import_id"), F.col("p_size").alias("date"))).select("import_id", "place")


@query("group_entities", f"""WITH {TICKETS}, {NOUNS}, m AS (SELECT id, id // 5 AS cluster FROM tickets), s AS (SELECT cluster, noun, count(*) AS n, min(id) AS first FROM nouns JOIN m USING (id) GROUP BY 1, 2),
top AS (SELECT cluster, max(n) AS n FROM s GROUP BY 1), a AS (SELECT cluster, unnest({_ACTIONS_SQL}) AS action FROM tickets JOIN m USING (id)), ac AS (SELECT cluster, action, count(*) AS n FROM a GROUP BY 1, 2), atop AS (SELECT cluster, max(n) AS n FROM ac GROUP BY 1)
SELECT c.cluster, coalesce(top.n, 0) AS system_count, coalesce(atop.n, 0) AS action_count FROM (SELECT DISTINCT cluster FROM m) c LEFT JOIN top USING (cluster) LEFT JOIN atop USING (cluster) WHERE top.n IS NOT NULL OR atop.n IS NOT NULL""")
def group_entities(spark, sf_dir):
    """How many members name the system, and the action, that a cluster's title is made of."""
    t = tickets(spark, sf_dir).withColumn("cluster", F.floor(F.col("id") / 5)).withColumn("pos", F.col("id"))
    signed = kept(entities.extracted(t))
    titles = entities.group_entities(t, signed).select("cluster", F.get("systems", 0)["name"].alias("system"), F.get("actions", 0)["name"].alias("action"))
    both = t.select("id", "cluster").join(signed, "id").join(titles, "cluster")
    out = both.groupBy("cluster").agg(F.count_if(F.array_contains("systems", F.col("system"))).alias("s"), F.count_if(F.array_contains("actions", F.col("action"))).alias("a"))
    return out.where("s > 0 or a > 0").select("cluster", F.col("s").alias("system_count"), F.col("a").alias("action_count"))


@query("table_versions", """WITH o AS (SELECT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS step, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
v(version) AS (VALUES (1), (2), (3), (4), (5)),
s AS (SELECT version, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM v JOIN o ON o.step <= least(version, 3) WHERE version < 5 GROUP BY 1 UNION ALL
  SELECT 5, count(*), CAST(sum(CASE WHEN step = 1 THEN cents + 1 ELSE cents END) AS BIGINT) FROM o)
SELECT version, CASE version WHEN 4 THEN 'insert' WHEN 5 THEN 'upsert' ELSE 'append' END AS op, n, cents FROM s""")
def table_versions(spark, sf_dir):
    """Orders by state, appended commit by commit, then inserted as a whole, then partly put in place of themselves; read back version by version."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    state = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3)
    tables = TableLog(spark, f"{checkpoint_dir(spark)}/versions-{uuid.uuid4().hex}")
    for k in (1, 2, 3):
        tables.append({"orders": o.where(state == k)}, keys=["id"])
    tables.insert("orders", o, ["id"])
    tables.upsert("orders", o.where(state == 1).withColumn("cents", F.col("cents") + 1), ["id"])
    rows = [tables.read("orders", v).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).withColumn("version", F.lit(v)) for v in range(1, 6)]
    return reduce(DataFrame.unionByName, rows).join(tables.history().select("version", "op"), "version").select(F.col("version").cast("int").alias("version"), "op", "n", "cents")


#: Batches of parts by key, and whether a batch's reply is broken: its first text says so.
_PASS = """p AS (SELECT p_partkey AS id, p_name AS text, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part), b AS (SELECT *, k // {n} AS batch, k % {n} AS place, first_value(length(text)) OVER (PARTITION BY k // {n} ORDER BY k) % 5 = 0 AS broken FROM p)"""


def _placed(spark, sf_dir, task):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    return batches.assembled(parts, batches.SIZES[task])


def _model(answer):
    """A model that answers each text of a batch, in a list with words around it; for some batches the list is broken."""

    def call(texts: list[str]) -> str:
        body = json.dumps([answer(k, t) for k, t in enumerate(texts)])
        return "Here: " + (body[:-1] + ", {]" if len(texts[0]) % 5 == 0 else body) + " done"

    return call


@query("normalise_pass", f"WITH {_PASS.format(n=40)} SELECT id, upper(text) AS content FROM b WHERE NOT broken AND length(text) % 3 <> 0")
def normalise_pass(spark, sf_dir):
    """Texts as a model rewrites them, in batches of 40; an empty answer changes nothing."""
    placed = _placed(spark, sf_dir, "normalise")
    return replies.normalised(batches.asked(placed, _model(lambda k, t: "" if len(t) % 3 == 0 else t.upper())), placed)


@query("tag_pass", f"""WITH {_PASS.format(n=25)}, t AS (SELECT id, string_split(text, ' ')[1] AS name FROM b WHERE NOT broken UNION SELECT id, 'part' FROM b WHERE NOT broken),
old AS (SELECT id, 'part' AS name FROM b WHERE id % 2 = 0) SELECT 'tag' AS kind, name, NULL::BIGINT AS id FROM (SELECT DISTINCT name FROM t) WHERE name <> 'part' UNION ALL SELECT 'link', name, id FROM t WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.id = t.id AND old.name = t.name)""")
def tag_pass(spark, sf_dir):
    """Tags and links that a model adds, in batches of 25; answers for records of other batches do not count."""
    placed = _placed(spark, sf_dir, "tag").withColumn("text", F.concat_ws("|", F.col("id").cast("string"), "text"))
    answer = lambda k, t: {"id": t.split("|")[0] if k >= 0 else "", "tags": [t.split("|")[1].split(" ")[0] + " ", "part"]}

    def call(texts: list[str]) -> str:
        broken = len(texts[0].split("|", 1)[1]) % 5 == 0
        # The greatest id of the batch and one more: never a record of this batch, whatever ids there are.
        other = str(max(int(t.split("|")[0]) for t in texts) + 1)
        body = json.dumps([answer(k, t) for k, t in enumerate(texts)] + [{"id": other, "tags": ["nobody"]}])
        return body[:-1] + ", {]" if broken else body

    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    new = replies.tag_tables(replies.tagged(batches.asked(placed, call), placed), spark.createDataFrame([("part",)], "name string"), ids.where("id % 2 = 0").withColumn("name", F.lit("part")))
    return new["tags"].select(F.lit("tag").alias("kind"), "name", F.lit(None).cast("long").alias("id")).unionByName(new["links"].select(F.lit("link").alias("kind"), "name", "id"))


@query("suggest_pass", f"WITH {_PASS.format(n=8)} SELECT id, unnest(['try ' || text, 'or not']) AS content FROM b WHERE NOT broken AND place % 2 = 0")
def suggest_pass(spark, sf_dir):
    """Suggestions for every second pattern of a batch of 8, by its place."""
    placed = _placed(spark, sf_dir, "suggest")
    answer = lambda k, t: {"patternIndex": k if k % 2 == 0 else 99, "suggestions": [f"try {t}", "or not"]}
    return replies.suggested(batches.asked(placed, _model(answer)), placed).select("id", "content")


@query("polished_titles", f"""WITH {_PASS.format(n=8)} SELECT id, CASE WHEN NOT broken AND length(text) % 3 <> 0 THEN 'new ' || text WHEN length(text) % 2 = 0 THEN 'one ' || text ELSE text END AS title,
CASE WHEN NOT broken AND length(text) % 3 <> 0 THEN 'batch' WHEN length(text) % 2 = 0 THEN 'single' ELSE 'original' END AS source FROM b""")
def polished_titles(spark, sf_dir):
    """Titles from batches, from single calls where these failed, else as they were."""
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_name").alias("prompt"))

    def one(prompt: str) -> str:
        if len(prompt) % 2:
            raise RuntimeError("no answer")
        return f'"one {prompt}"'

    return replies.polished(titles, _model(lambda k, t: "" if len(t) % 3 == 0 else f"new {t}"), one)
