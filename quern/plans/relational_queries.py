"""Queries over the relational surface: tags, joins, upserts, analytics, evidence, graph and search."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import analytics, context, crm, evaluate, relational
from quern.operators.lineage import checkpoint_dir
from quern.operators.search_index import SearchIndex
from quern.plans.bind import NOW, TICKETS, now, query, spread, table, tickets
from quern.plans.corpus_queries import _list
from quern.plans.vector_queries import vectors
from quern.functions import fixed

_P = "p AS (SELECT id % 40 AS pattern, * FROM tickets)"


def members(spark, sf_dir):
    return tickets(spark, sf_dir).withColumn("pattern", F.col("id") % 40)


@query("tag_patterns", f"""WITH {TICKETS}, e AS (SELECT unnest(tags) AS tag, person, CASE WHEN id % 4 = 0 THEN batch END AS session FROM tickets)
SELECT tag, count(*) AS n, count(DISTINCT person) AS persons, count(DISTINCT session) AS sessions, CASE WHEN count(DISTINCT person) >= 3 THEN 'CROSS_PERSON' ELSE 'RECURRING' END AS pattern_type
FROM e GROUP BY 1 HAVING count(DISTINCT session) >= 3 OR count(DISTINCT person) >= 3""")
def tag_patterns(spark, sf_dir):
    return relational.tag_patterns(tickets(spark, sf_dir).withColumn("session", F.when(F.col("id") % 4 == 0, F.col("batch"))))


_TAG_WORDS = f"""w AS (SELECT DISTINCT id, tags, unnest(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+')) AS word FROM tickets),
k AS (SELECT * FROM w WHERE length(word) > 2 AND NOT list_contains({_list(fixed.TAG_STOP_WORDS)}, word))"""


@query("suggest_tags", f"""WITH {TICKETS}, {_TAG_WORDS}, h AS (SELECT id, any_value(tags) AS tags, count(*) AS shared FROM k WHERE id <> 1 AND word IN (SELECT word FROM k WHERE id = 1) GROUP BY 1)
SELECT tag, CAST(sum(shared) AS BIGINT) AS score FROM (SELECT unnest(tags) AS tag, shared FROM h) GROUP BY 1 ORDER BY score DESC, tag LIMIT 3""")
def suggest_tags(spark, sf_dir):
    return relational.suggested_tags(tickets(spark, sf_dir), 1)


@query("suggest_most_used", """SELECT p_brand AS tag, CAST(0 AS BIGINT) AS score FROM (SELECT p_brand, count(*) FILTER (p_partkey = 1) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 3)""")
def suggest_most_used(spark, sf_dir):
    """Only the target has a tag: the tags used most."""
    p = table(spark, sf_dir, "part")
    df = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.when(F.col("p_partkey") == 1, F.array("p_brand")).otherwise(F.array().cast("array<string>")).alias("tags"))
    return relational.suggested_tags(df, 1, p.select(F.col("p_brand").alias("name")))


@query("tagged_semi", "SELECT doc_id AS id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def tagged_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "lang")


@query("untagged_anti", "SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def untagged_anti(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select(F.col("doc_id").alias("id"), "lang")


@query("pattern_tree", """WITH o AS (SELECT o_custkey, count(*) AS orders, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1)
SELECT r_name AS region, n_name AS nation, count(c_custkey) AS customers, CAST(coalesce(sum(orders), 0) AS BIGINT) AS orders, CAST(coalesce(sum(cents), 0) AS BIGINT) AS cents
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN o ON o_custkey = c_custkey GROUP BY 1, 2""")
def pattern_tree(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(F.count("c_custkey").alias("customers"), F.sum("orders").alias("orders"), F.sum("cents").alias("cents"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return n.select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), *[F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("customers", "orders", "cents")])


@query("record_tags", """SELECT c_custkey AS id, coalesce(array_to_string(t, ','), '') AS tags FROM customer LEFT JOIN (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def record_tags(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    links = o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("tag_id")).distinct()
    tags = o.select(F.col("o_orderpriority").alias("tag_id"), F.col("o_orderpriority").alias("name")).distinct()
    return relational.tagged(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), links, tags).select("id", F.array_join("tags", ",").alias("tags"))


_OLD = "SELECT DISTINCT p_brand AS name, 'old' AS source FROM part WHERE p_size < 5"


@query("upsert_tags", f"WITH o AS ({_OLD}) SELECT * FROM o UNION ALL SELECT DISTINCT p_brand, 'new' FROM part WHERE p_brand NOT IN (SELECT name FROM o) UNION ALL SELECT DISTINCT p_type, 'new' FROM part")
def upsert_tags(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    old = p.where("p_size < 5").select(F.col("p_brand").alias("name"), F.lit("old").alias("source")).distinct()
    new = p.select(F.col("p_brand").alias("name"), F.lit("new").alias("source")).union(p.select(F.col("p_type"), F.lit("new")))
    return relational.insert_absent(old, new, ["name"])


@query("new_links", "SELECT DISTINCT p_brand AS brand, p_type AS type FROM part EXCEPT SELECT p_brand, p_type FROM part WHERE p_size < 3")
def new_links(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_type").alias("type"), "p_size")
    return relational.absent(p.select("brand", "type"), p.where("p_size < 3").select("brand", "type").distinct(), ["brand", "type"])


@query("partial_update", "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 <> 0 THEN 'CHANGED' ELSE c_mktsegment END AS segment, c_name AS name FROM customer")
def partial_update(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"))
    return relational.patched(c, c.where("id % 5 = 0").select("id", F.when(F.col("id") % 10 != 0, F.lit("CHANGED")).alias("segment")), "id")


@query("delete_cascade", """WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone))
SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone) UNION ALL SELECT 'orders', count(*) FROM o
UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))""")
def delete_cascade(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    tables = {"customer": c, "orders": table(spark, sf_dir, "orders"), "lineitem": table(spark, sf_dir, "lineitem")}
    left = relational.cascade(tables, c.where("c_nationkey = 3").select("id"), [("orders", "o_orderkey", "o_custkey", "customer"), ("lineitem", "l_linenumber", "l_orderkey", "orders")])
    counts = [left[k].agg(F.lit(k).alias("name"), F.count(F.lit(1)).alias("n")) for k in ("customer", "orders", "lineitem")]
    return counts[0].union(counts[1]).union(counts[2])


@query("occurrence_counts", "SELECT c_custkey AS id, count(*) AS occurrence_count FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def occurrence_counts(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pattern_id"))
    return relational.without_orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), links)


@query("next_sort_order", "SELECT o_custkey AS customer, max(o_orderkey) + 1 AS next FROM orders GROUP BY 1")
def next_sort_order(spark, sf_dir):
    return relational.next_order(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "customer"), "customer", "o_orderkey")


@query("relation_counts", "SELECT c_custkey AS id, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def relation_counts(spark, sf_dir):
    return relational.with_count(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "orders"), "id", "o_custkey", "orders")


@query("latest_orders", "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def latest_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))


@query("prefix_links", f"""WITH {TICKETS}, l AS (SELECT *, left(text, 100) AS k, row_number() OVER (PARTITION BY person, left(text, 100) ORDER BY date DESC, id DESC) AS r FROM tickets)
SELECT DISTINCT l.id, t.org AS tag FROM tickets t JOIN l ON l.person = t.person AND l.k = left(t.text, 100) AND r = 1""")
def prefix_links(spark, sf_dir):
    t = tickets(spark, sf_dir)
    return relational.linked_by_prefix(t.select("person", "text", F.col("org").alias("tag")), t.select("id", "person", "text", "date"))


@query("crm_snapshots", "SELECT date_trunc('month', o_orderdate) AS month, o_orderpriority AS category, count(*) AS ticket_count, round(avg(o_totalprice), 4) AS avg_value FROM orders GROUP BY 1, 2")
def crm_snapshots(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("month"), F.col("o_orderpriority").alias("category"))
    return o.agg(F.count(F.lit(1)).alias("ticket_count"), F.round(F.avg("o_totalprice"), 4).alias("avg_value")).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("crm_counts", "SELECT coalesce(nullif(CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type END, ''), 'Övrigt') AS category, count(*) AS ticket_count FROM events GROUP BY 1")
def crm_counts(spark, sf_dir):
    return crm.by_category(table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type")).alias("category")))


@query("crm_match", """WITH tag AS (SELECT p_partkey AS pattern_id, unnest(string_split(p_name, ' ')) AS tag FROM part), snap AS (SELECT min(p_partkey) AS snapshot_id, split_part(p_name, ' ', 2) AS category FROM part GROUP BY split_part(p_name, ' ', 2), p_type HAVING min(p_partkey) % 2 = 0)
SELECT DISTINCT pattern_id, snapshot_id, category FROM tag JOIN snap ON contains(lower(tag), lower(category)) OR contains(lower(category), lower(tag)) WHERE (pattern_id + snapshot_id) % 3 <> 0""")
def crm_match(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    tags = p.select(F.col("p_partkey").alias("pattern_id"), F.explode(F.split("p_name", " ")).alias("tag"))
    snaps = p.groupBy(F.element_at(F.split("p_name", " "), 2).alias("category"), "p_type").agg(F.min("p_partkey").alias("snapshot_id"))
    # Odd snapshots are too old.
    snaps = snaps.select("snapshot_id", "category", F.when(F.col("snapshot_id") % 2 == 0, now()).otherwise(now() - F.expr("interval 61 days")).alias("date"))
    known = crm.matches(tags, snaps, spark.createDataFrame([], "pattern_id long, snapshot_id long"), now()).where((F.col("pattern_id") + F.col("snapshot_id")) % 3 == 0).select("pattern_id", "snapshot_id")
    return crm.matches(tags, snaps, known, now())


_FORM = "left(trim(regexp_replace(regexp_replace(lower(text), '[0-9]+', 'N', 'g'), '\\s+', ' ', 'g')), 30)"
_REPEAT = f"""WITH {TICKETS}, m AS (SELECT id % 40 AS pattern, CASE WHEN id % 40 < 10 THEN lang2 || ' repeated message number ' || id ELSE text END AS text FROM (SELECT *, tags[1] AS lang2 FROM tickets)),
c AS (SELECT pattern, CASE WHEN length({_FORM}) >= 10 THEN {_FORM} END AS prefix, count(*) AS k FROM m GROUP BY 1, 2), r AS (SELECT pattern, coalesce(max(CASE WHEN prefix IS NOT NULL THEN k END), 0) AS most, CAST(sum(k) AS BIGINT) AS n FROM c GROUP BY 1),
repeats AS (SELECT * FROM r WHERE n >= 3 AND most >= 3 AND most * 2 >= n)"""


def _repeating(spark, sf_dir):
    m = members(spark, sf_dir)
    told = F.concat(F.element_at("tags", 1), F.lit(" repeated message number "), F.col("id").cast("string"))
    return m.withColumn("text", F.when(F.col("pattern") < 10, told).otherwise(F.col("text")))


@query("repetition_flags", _REPEAT + " SELECT pattern, most, n FROM repeats")
def repetition_flags(spark, sf_dir):
    return analytics.repetition(_repeating(spark, sf_dir))


_TITLES = "titles AS (SELECT min(p_partkey) AS id, p_name AS title, [p_type, split_part(p_name, ' ', 1), p_name] AS topics, count(*) AS count FROM part GROUP BY p_name, p_type)"


def _titled(spark, sf_dir):
    """A pattern for every name and type of parts, with how many there are."""
    p = table(spark, sf_dir, "part").groupBy("p_name", "p_type").agg(F.min("p_partkey").alias("id"), F.count(F.lit(1)).alias("count"))
    return p.select("id", F.col("p_name").alias("title"), F.array(F.col("p_type"), F.element_at(F.split("p_name", " "), 1), F.col("p_name")).alias("topics"), "count")


_RELATED = f"""{_TITLES}, rel AS (SELECT a.id AS a, b.id AS b FROM titles a JOIN titles b ON a.id < b.id WHERE lower(a.title) = lower(b.title) OR
 len(list_filter(list_transform(a.topics, lambda t: lower(t)), lambda t: list_contains(list_transform(b.topics, lambda u: lower(u)), t)))::DOUBLE / len(list_distinct(list_transform(list_concat(a.topics, b.topics), lambda t: lower(t)))) >= 0.5)"""


@query("cross_pattern_flags", f"WITH {_RELATED} SELECT a, b FROM rel")
def cross_pattern_flags(spark, sf_dir):
    return analytics.related(_titled(spark, sf_dir))


@query("priority_score", _REPEAT + f""", {_RELATED}, q AS (SELECT id, CASE id % 4 WHEN 0 THEN 'ESCALATING' WHEN 1 THEN 'CROSS_TEAM' WHEN 2 THEN 'CROSS_PERSON' ELSE 'RECURRING' END AS t, count, CASE WHEN id % 3 = 0 THEN 'EMERGING' ELSE 'CONFIRMED' END AS status FROM titles),
f AS (SELECT pattern AS id, 'repetition' AS flag FROM repeats UNION ALL SELECT id, 'cross-pattern' FROM (SELECT a AS id FROM rel UNION SELECT b FROM rel) WHERE id NOT IN (SELECT pattern FROM repeats)),
s AS (SELECT q.id, flag, (CASE WHEN flag = 'repetition' THEN 40 WHEN flag IS NOT NULL THEN 20 ELSE 0 END + CASE t WHEN 'ESCALATING' THEN 30 WHEN 'CROSS_TEAM' THEN 15 WHEN 'CROSS_PERSON' THEN 10 ELSE 0 END + CASE WHEN count >= 10 THEN 20 WHEN count >= 5 THEN 10 ELSE 3 END + CASE WHEN status = 'EMERGING' THEN 5 ELSE 0 END) AS score FROM q LEFT JOIN f USING (id))
SELECT id, flag, score, CASE WHEN score >= 50 THEN 'critical' WHEN score >= 30 THEN 'high' WHEN score >= 15 THEN 'medium' ELSE 'low' END AS level FROM s""")
def priority_score(spark, sf_dir):
    titled = _titled(spark, sf_dir)
    p = titled.select(
        "id", F.element_at(F.array(*map(F.lit, ["ESCALATING", "CROSS_TEAM", "CROSS_PERSON", "RECURRING"])), (F.col("id") % 4 + 1).cast("int")).alias("pattern_type"),
        "count", F.when(F.col("id") % 3 == 0, "EMERGING").otherwise("CONFIRMED").alias("status"),
    )
    return analytics.priorities(p, analytics.flags(titled, _repeating(spark, sf_dir))).select("id", "flag", "score", "level")


@query("group_by_tag", f"""WITH {TICKETS}, {_P}, c AS (SELECT pattern, unnest(tags) AS tag, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, tag) AS k FROM c) SELECT tag, count(*) AS patterns, CAST(sum(n) AS BIGINT) AS n FROM r WHERE k = 1 GROUP BY 1""")
def group_by_tag(spark, sf_dir):
    best = analytics.commonest(members(spark, sf_dir).select("pattern", F.explode("tags").alias("tag")), "tag")
    return best.groupBy("tag").agg(F.count(F.lit(1)).alias("patterns"), F.sum("n").alias("n"))


@query("group_by_import", f"""WITH {TICKETS}, m AS (SELECT id % 40 AS pattern, CASE WHEN id % 3 <> 0 THEN 'i' || (id // 40) % 2 END AS import FROM tickets), c AS (SELECT pattern, import, count(*) AS n FROM m WHERE import IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY n DESC, import) AS k FROM c), z AS (SELECT pattern, count(*) FILTER (import IS NULL) AS none FROM m GROUP BY 1) SELECT r.pattern, import, n FROM r JOIN z USING (pattern) WHERE k = 1 AND n > none""")
def group_by_import(spark, sf_dir):
    m = members(spark, sf_dir).select("pattern", F.when(F.col("id") % 3 != 0, F.concat(F.lit("i"), (F.floor(F.col("id") / 40) % 2).cast("string"))).alias("import"))
    return analytics.commonest(m, "import", floor="import")


_REL = """rel AS (SELECT 'n' || n_nationkey AS f, 'r' || n_regionkey AS t, 'IN' AS relation FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'OF' FROM customer
 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'OF' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'BY' FROM orders)"""


def relations(spark, sf_dir):
    def edges(name, a, one, b, other, kind):
        return table(spark, sf_dir, name).select(F.concat(F.lit(a), F.col(one).cast("string")).alias("from"), F.concat(F.lit(b), F.col(other).cast("string")).alias("to"), F.lit(kind).alias("relation"), F.lit("").alias("note"))

    out = edges("nation", "n", "n_nationkey", "r", "n_regionkey", "IN").union(edges("customer", "c", "c_custkey", "n", "c_nationkey", "OF"))
    return out.union(edges("supplier", "s", "s_suppkey", "n", "s_nationkey", "OF")).union(edges("orders", "o", "o_orderkey", "c", "o_custkey", "BY"))


@query("degree", f"WITH {_REL} SELECT id, count(*) AS degree FROM (SELECT f AS id FROM rel UNION ALL SELECT t FROM rel) GROUP BY 1")
def degree(spark, sf_dir):
    return context.degrees(relations(spark, sf_dir))


_BFS = f"""WITH RECURSIVE {_REL}, hop AS (SELECT f AS a, t AS b FROM rel UNION ALL SELECT t, f FROM rel), w AS (SELECT 'n3' AS id, 0 AS n UNION SELECT hop.b, n + 1 FROM w JOIN hop ON hop.a = w.id WHERE n < 2), r AS (SELECT id, min(n) AS hops FROM w GROUP BY 1)"""


@query("related_2hop", _BFS + " SELECT id, hops FROM r WHERE hops > 0")
def related_2hop(spark, sf_dir):
    start = spark.range(1).select(F.lit("n3").alias("id"))
    return context.related(relations(spark, sf_dir), start, 2).select("id", "hops")


@query("related_edges", _BFS + ' SELECT DISTINCT f AS "from", t AS "to", relation FROM rel WHERE f IN (SELECT id FROM r WHERE hops < 2) OR t IN (SELECT id FROM r WHERE hops < 2)')
def related_edges(spark, sf_dir):
    r, start = relations(spark, sf_dir), spark.range(1).select(F.lit("n3").alias("id"))
    return context.traversed(r, start, context.related(r, start, 2), 2).select("from", "to", "relation")


@query("graph_counts", f"WITH {_REL} SELECT left(id, 1) AS name, count(*) AS n FROM (SELECT DISTINCT f AS id FROM rel UNION SELECT t FROM rel) GROUP BY 1 UNION ALL SELECT relation, count(*) FROM rel GROUP BY 1")
def graph_counts(spark, sf_dir):
    r = relations(spark, sf_dir)
    nodes = r.select(F.explode(F.array("from", "to")).alias("id")).distinct().withColumn("label", F.substring("id", 1, 1))
    return context.graph_counts(nodes, r)


@query("loaded_edges", f"""WITH {_REL}, n AS (SELECT DISTINCT f AS id FROM rel WHERE relation <> 'BY' UNION SELECT t FROM rel WHERE relation = 'IN') SELECT f AS "from", t AS "to", relation FROM rel WHERE f IN (SELECT id FROM n) AND t IN (SELECT id FROM n)""")
def loaded_edges(spark, sf_dir):
    r = relations(spark, sf_dir)
    nodes = r.where("relation <> 'BY'").select(F.col("from").alias("id")).union(r.where("relation = 'IN'").select("to"))
    return context.loaded_edges(r, nodes).select("from", "to", "relation")


@query("rule_links", """WITH rel AS (SELECT 'p' || l_partkey AS f, 's' || l_suppkey AS t, CASE WHEN l_linenumber % 2 = 0 THEN 'CONSTRAINS' ELSE 'IMPLEMENTS' END AS relation FROM lineitem)
SELECT id, array_to_string(list(DISTINCT rule ORDER BY rule), ',') AS rules FROM (SELECT t AS id, f AS rule FROM rel WHERE relation = 'CONSTRAINS' UNION ALL SELECT f, t FROM rel WHERE relation = 'IMPLEMENTS') GROUP BY 1""")
def rule_links(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    rel = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to"), F.when(F.col("l_linenumber") % 2 == 0, "CONSTRAINS").otherwise("IMPLEMENTS").alias("relation"))
    return context.rule_links(rel).select("id", F.array_join("rules", ",").alias("rules"))


_RULES = "rules AS (SELECT 'rule' || p_partkey AS id, p_name AS title, p_type || ' ' || p_name AS body, CASE WHEN p_brand = 'Brand#1' THEN 'global' ELSE p_brand END AS scope, CASE WHEN p_partkey % 5 = 0 THEN 'draft' ELSE 'active' END AS status, p_size AS priority, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey % 90 AS INTEGER)) AS updated_at, p_partkey % 2 = 0 AS source_of_truth, p_size * 2.0 AS trust_level FROM part)"


def rules(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(
        F.concat(F.lit("rule"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.concat_ws(" ", "p_type", "p_name").alias("body"), F.when(F.col("p_brand") == "Brand#1", "global").otherwise(F.col("p_brand")).alias("scope"),
        F.when(F.col("p_partkey") % 5 == 0, "draft").otherwise("active").alias("status"), F.col("p_size").alias("priority"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("p_partkey") % 90) * F.lit(86_400_000_000)).alias("updated_at"),
        (F.col("p_partkey") % 2 == 0).alias("source_of_truth"), (F.col("p_size") * F.lit(2.0)).alias("trust_level"),
    )


@query("rules_by_scope", f"WITH {_RULES} SELECT id, title, body AS description, priority, scope, status FROM rules WHERE status = 'active' AND scope IN ('Brand#2', 'global')")
def rules_by_scope(spark, sf_dir):
    return context.rules(rules(spark, sf_dir), "Brand#2")


_QUERY = "small red ring the nd of"
_TOKENS = "['" + "', '".join(T.query_tokens(_QUERY)) + "']"
_FOUND = f"""{_RULES}, found AS (SELECT 'd' || doc_id AS id, 'File' AS entity_type, 'src/' || source || chr(10) || left(text, 200) || chr(10) || text AS text, CASE WHEN doc_id % 11 = 0 THEN 'Deprecated' ELSE 'active' END AS status, doc_id % 3 = 0 AS source_of_truth, (doc_id % 120)::DOUBLE AS trust_level,
 TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 60 AS INTEGER)) AS updated_at FROM documents UNION ALL SELECT id, 'Rule', id || chr(10) || title || chr(10) || body, status, source_of_truth, trust_level, updated_at FROM rules),
deg AS (SELECT id, count(*) AS degree FROM (SELECT 'd' || (l_partkey % 200) AS id FROM lineitem UNION ALL SELECT 'rule' || l_suppkey FROM lineitem) GROUP BY 1),
lex AS (SELECT *, len(list_intersect({_TOKENS}, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2)))::DOUBLE / len({_TOKENS}) AS share, contains(lower(text), '{_QUERY}') AS phrase FROM found WHERE lower(status) <> 'deprecated'),
lexical AS (SELECT *, CASE WHEN share > 0 THEN least(1.0, share * 0.85 + CASE WHEN phrase THEN 0.15 ELSE 0 END) ELSE 0 END AS lexical FROM lex)"""
_SCORE = f"""SELECT id, entity_type, round(semantic * 0.4 + least(1.0, coalesce(degree, 0) / 4) * 0.25 + least(1.0, greatest(0.0, trust_level / 100)) * 0.2 + 1 / (1 + greatest(0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(updated_at)) / 864e8) / 30) * 0.15 + CASE WHEN source_of_truth THEN semantic * 0.1 ELSE 0 END, 4) AS score,
 round(semantic, 4) AS semantic_score, round(embedding, 4) AS embedding_score, round(lexical, 4) AS lexical_score FROM sem LEFT JOIN deg USING (id) ORDER BY score DESC, id LIMIT 20"""


def found(spark, sf_dir):
    """Search entities over documents (files) and parts (rules), and what relates them."""
    d = spread(table(spark, sf_dir, "documents"), "doc_id")
    documents = d.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.concat(F.lit("src/"), "source").alias("path"), F.lit("DOC").alias("kind"), F.substring("text", 1, 200).alias("excerpt"), F.col("text").alias("content"),
        F.when(F.col("doc_id") % 11 == 0, "Deprecated").otherwise("active").alias("status"), (F.col("doc_id") % 3 == 0).alias("source_of_truth"), (F.col("doc_id") % 120).cast("double").alias("trust_level"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("doc_id") % 60) * F.lit(86_400_000_000)).alias("updated_at"),
    )
    empty = "id string, path string, title string, body string, status string, source_of_truth boolean, trust_level double, decision_date timestamp"
    chunk = "id string, file_id string, name string, kind string, signature string, body string, status string, source_of_truth boolean, trust_level double, updated_at timestamp"
    li = table(spark, sf_dir, "lineitem")
    rel = li.select(F.concat(F.lit("d"), (F.col("l_partkey") % 200).cast("string")).alias("from"), F.concat(F.lit("rule"), F.col("l_suppkey").cast("string")).alias("to"), F.lit("SUPERSEDES").alias("relation"), F.lit("").alias("note"))
    return context.entities(documents, rules(spark, sf_dir), spark.createDataFrame([], empty), spark.createDataFrame([], chunk), rel), rel


_SHOWN = ["id", "entity_type", "score", "semantic_score", "embedding_score", "lexical_score"]


@query("lexical_search", f"WITH {_FOUND}, sem AS (SELECT *, 0.0 AS embedding, lexical AS semantic FROM lexical WHERE lexical >= 0.05) {_SCORE}")
def lexical_search(spark, sf_dir):
    entities, rel = found(spark, sf_dir)
    return context.search(entities, rel, _QUERY, now(), 20).select(*_SHOWN)


_ASKED = [((k * 7) % 13 - 6) / 10 for k in range(64)]


@query("hybrid_search", f"""WITH {_FOUND}, vec AS (SELECT 'd' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), asked AS (SELECT {_ASKED}::DOUBLE[] AS q),
sims AS (SELECT id, least(1.0, greatest(0.0, list_dot_product(x, q) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(q, q))))) AS e FROM vec, asked),
hy AS (SELECT lexical.*, coalesce(e, 0.0) AS embedding FROM lexical LEFT JOIN sims USING (id)), sem AS (SELECT *, CASE WHEN embedding > 0 THEN embedding * 0.75 + lexical * 0.25 ELSE lexical END AS semantic FROM hy WHERE lexical >= 0.05 OR embedding >= 0.2) {_SCORE}""")
def hybrid_search(spark, sf_dir):
    entities, rel = found(spark, sf_dir)
    v = vectors(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), "vector")
    return context.search(entities, rel, _QUERY, now(), 20, vectors=v, query_vector=_ASKED).select(*_SHOWN)


#: Indexes of this session by their tables: built once, searched by every query.
_INDEXES: dict[tuple, SearchIndex] = {}


def _index(spark, sf_dir) -> SearchIndex:
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _INDEXES:
        entities, rel = found(spark, sf_dir)
        v = vectors(spark, sf_dir).select(F.concat(F.lit("d"), F.col("id").cast("string")).alias("id"), "vector")
        made = SearchIndex(spark, f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex}")
        made.build(entities, rel, v)
        _INDEXES[at] = made
    return _INDEXES[at]


@query("indexed_search", f"WITH {_FOUND}, sem AS (SELECT *, 0.0 AS embedding, lexical AS semantic FROM lexical WHERE lexical >= 0.05) {_SCORE}")
def indexed_search(spark, sf_dir):
    """lexical_search from the inverted index."""
    return _index(spark, sf_dir).search(_QUERY, now(), 20).select(*_SHOWN)


@query("indexed_hybrid", f"""WITH {_FOUND}, vec AS (SELECT 'd' || vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), asked AS (SELECT {_ASKED}::DOUBLE[] AS q),
sims AS (SELECT id, least(1.0, greatest(0.0, list_dot_product(x, q) / (sqrt(list_dot_product(x, x)) * sqrt(list_dot_product(q, q))))) AS e FROM vec, asked),
hy AS (SELECT lexical.*, coalesce(e, 0.0) AS embedding FROM lexical LEFT JOIN sims USING (id)), sem AS (SELECT *, CASE WHEN embedding > 0 THEN embedding * 0.75 + lexical * 0.25 ELSE lexical END AS semantic FROM hy WHERE lexical >= 0.05 OR embedding >= 0.2) {_SCORE}""")
def indexed_hybrid(spark, sf_dir):
    """hybrid_search from the inverted index."""
    return _index(spark, sf_dir).search(_QUERY, now(), 20, query_vector=_ASKED).select(*_SHOWN)


@query("incremental_embed", """WITH s AS (SELECT doc_id AS id, sha256(left(regexp_replace(trim(text), '\\s+', ' ', 'g'), 7000)) AS signature FROM documents) SELECT id, signature, id % 2 = 0 AND id % 3 = 0 AS reused FROM s""")
def incremental_embed(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    none = spark.createDataFrame([], "id long, signature string, model string, vector array<double>")
    index = context.to_embed(items.where("id % 2 = 0"), none, "m").select("id", "signature", F.when(F.col("id") % 3 == 0, "m").otherwise("other").alias("model"), F.array(F.lit(1.0)).alias("vector"))
    return context.to_embed(items, index, "m").select("id", "signature", F.col("vector").isNotNull().alias("reused"))


_MEM = "m AS (SELECT vec_id AS id, label AS pattern FROM embeddings UNION ALL SELECT vec_id, 100 + label FROM embeddings WHERE vec_id % 3 = 0)"


def _members(spark, sf_dir):
    v = vectors(spark, sf_dir).select("id", F.col("cluster").alias("pattern"))
    return v.union(v.where("id % 3 = 0").select("id", F.col("pattern") + 100))


@query("coverage_metrics", f"""WITH {_MEM}, s AS (SELECT pattern, count(*) AS n FROM m GROUP BY 1), c AS (SELECT count(*) AS core, count(DISTINCT CASE WHEN doc_id IN (SELECT id FROM m) THEN doc_id END) AS covered FROM documents)
SELECT count(*) AS patterns, avg(n) AS avg_size, max(n) AS max_size, min(n) AS min_size, count(*) FILTER (n > 15) AS catch_alls, any_value(core) AS core, any_value(covered) AS covered, round(any_value(covered) * 100 / any_value(core), 1) AS coverage, round(100 - any_value(covered) * 100 / any_value(core), 1) AS orphan_rate FROM s, c""")
def coverage_metrics(spark, sf_dir):
    return evaluate.coverage(_members(spark, sf_dir), table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))


@query("ticket_reuse", f"WITH {_MEM} SELECT id, count(DISTINCT pattern) AS patterns FROM m GROUP BY 1 HAVING count(DISTINCT pattern) > 1")
def ticket_reuse(spark, sf_dir):
    return evaluate.reused(_members(spark, sf_dir))


@query("lower_median", f"WITH {_MEM}, s AS (SELECT list(n ORDER BY n DESC) AS l FROM (SELECT count(*) AS n FROM m GROUP BY pattern)) SELECT l[len(l) // 2 + 1] AS median_size FROM s")
def lower_median(spark, sf_dir):
    return evaluate.lower_median(_members(spark, sf_dir))


@query("pattern_overlap", f"""WITH {_MEM}, s AS (SELECT pattern, count(*) AS n FROM m GROUP BY 1), p AS (SELECT x.pattern AS a, y.pattern AS b, count(*) AS shared FROM m x JOIN m y ON x.id = y.id AND x.pattern < y.pattern GROUP BY 1, 2)
SELECT a, b, shared FROM p JOIN s sa ON sa.pattern = a JOIN s sb ON sb.pattern = b WHERE shared / least(sa.n, sb.n) > 0.5""")
def pattern_overlap(spark, sf_dir):
    return evaluate.overlaps(_members(spark, sf_dir))
