"""Queries over single forms: titles, replies, states, distances, slices, seals."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import clusters, context, evaluate, patterns, records, relational
from quern.plans.bind import TICKETS, query, table, tickets
from quern.plans.corpus_queries import _list, members
from quern.plans.vector_queries import vectors
from quern.plans.workspace_queries import _ROWS, sheet
from quern.sources import readers, sinks


def _k():
    return F.col("p_partkey")


# Titles: names are capitalised words; brands hold a #, so they are no names; every branch occurs.
_TITLE = """t AS (SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN ['TIMS', lower(p_brand)] WHEN 1 THEN ['TIMS', lower(p_brand)] WHEN 2 THEN ['TIMS', 'PubTrans'] WHEN 3 THEN ['Tims'] WHEN 4 THEN ['late bus', 'slow'] WHEN 5 THEN ['slow'] WHEN 6 THEN ['slow'] ELSE [] END AS topics,
CASE WHEN p_partkey % 8 IN (0, 5) THEN 'fel' END AS action, ['fel', 'tims', split_part(p_name, ' ', 1)] AS common, CASE WHEN p_partkey % 16 = 7 THEN ['two', 'words'] ELSE [] END AS top, p_size AS n FROM part)"""


@query("pattern_titles", f"""WITH {_TITLE}, w AS (SELECT *, common[3] AS k FROM t) SELECT id, CASE id % 8 WHEN 0 THEN 'TIMS — fel' WHEN 1 THEN 'TIMS — ' || topics[2] WHEN 2 THEN 'TIMS + PubTrans' WHEN 3 THEN 'Tims — ' || k WHEN 4 THEN 'late bus — slow'
WHEN 5 THEN 'slow — fel' WHEN 6 THEN 'slow — tims' ELSE CASE WHEN len(top) > 0 THEN 'two words' ELSE 'Mönster (' || n || ' ärenden)' END END AS title FROM w""")
def pattern_titles(spark, sf_dir):
    case, brand = _k() % 8, F.lower("p_brand")
    lists = [F.array(F.lit("TIMS"), brand), F.array(F.lit("TIMS"), brand), F.array(F.lit("TIMS"), F.lit("PubTrans")), F.array(F.lit("Tims")), F.array(F.lit("late bus"), F.lit("slow")), F.array(F.lit("slow")), F.array(F.lit("slow")), F.array().cast("array<string>")]
    topics = F.coalesce(*[F.when(case == k, x) for k, x in enumerate(lists)])
    top = F.when(_k() % 16 == 7, F.array(F.lit("two"), F.lit("words"))).otherwise(F.array().cast("array<string>"))
    common = F.array(F.lit("fel"), F.lit("tims"), F.split("p_name", " ")[0])
    return table(spark, sf_dir, "part").select(_k().alias("id"), patterns.title(topics, F.when(case.isin(0, 5), "fel"), common, top, F.col("p_size")).alias("title"))


@query("proper_topics", r"SELECT DISTINCT p_name AS topic, regexp_matches(p_name, '^[A-ZÄÖÅ][a-zäöå]{2,}$') AS proper FROM (SELECT unnest([p_brand, split_part(p_name, ' ', 1), upper(left(p_name, 1)) || split_part(substr(p_name, 2), ' ', 1), p_name]) AS p_name FROM part)")
def proper_topics(spark, sf_dir):
    first = F.split("p_name", " ")[0]
    forms = F.array("p_brand", first, F.concat(F.upper(F.substring("p_name", 1, 1)), F.split(F.substring("p_name", 2, 99), " ")[0]), F.col("p_name"))
    return table(spark, sf_dir, "part").select(F.explode(forms).alias("topic")).distinct().select("topic", T.is_proper_topic(F.col("topic")).alias("proper"))


@query("clean_titles", "SELECT p_partkey AS id, CASE WHEN p_partkey % 5 = 0 THEN 'own' ELSE p_name END AS title FROM part")
def clean_titles(spark, sf_dir):
    """Replies with thoughts, quotes, numbering and labels, and some that are too long."""
    name = F.col("p_name")
    reply = F.when(_k() % 5 == 0, F.repeat(name, 20)).when(_k() % 5 == 1, F.concat(F.lit("<think>a\nb</think> "), name)).when(_k() % 5 == 2, F.concat(F.lit('"'), name, F.lit("”"))).when(_k() % 5 == 3, F.concat(F.lit("12. "), name)).otherwise(F.concat(F.lit("Titel: "), name))
    return table(spark, sf_dir, "part").select(_k().alias("id"), T.clean_title(reply, F.lit("own")).alias("title"))


@query("json_lists", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '[' || p_size || ', [1]]' END AS list FROM part")
def json_lists(spark, sf_dir):
    reply = F.when(_k() % 3 == 0, "no list").otherwise(F.concat(F.lit("text ["), F.col("p_size").cast("string"), F.lit(",\x01 [1]] and more")))
    return table(spark, sf_dir, "part").select(_k().alias("id"), T.json_array(reply).alias("list"))


@query("meeting_states", """SELECT o_orderkey AS id, o_orderstatus = 'O' OR o_orderkey % 2 = 0 AS started, o_orderstatus = 'F' AS ended FROM orders""")
def meeting_states(spark, sf_dir):
    o, now = table(spark, sf_dir, "orders"), F.lit("2024-06-01").cast("timestamp")
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("PLANNED")
    a, b = relational.meeting_state(status, F.when(F.col("o_orderkey") % 2 == 0, F.lit("2024-01-01").cast("timestamp")), F.lit(None).cast("timestamp"), now)
    return o.select(F.col("o_orderkey").alias("id"), a.isNotNull().alias("started"), b.isNotNull().alias("ended"))


@query("batch_keys", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 's' || o_custkey END, CASE WHEN o_orderkey % 2 = 0 THEN 'i' || o_custkey END, CAST(o_orderkey AS VARCHAR)) AS batch FROM orders")
def batch_keys(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    return table(spark, sf_dir, "orders").select(k.alias("id"), records.batch_key(F.when(k % 3 == 0, F.concat(F.lit("s"), c)), F.when(k % 2 == 0, F.concat(F.lit("i"), c)).otherwise(""), k).alias("batch"))


@query("squared_distances", "SELECT a.vec_id AS id, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def squared_distances(spark, sf_dir):
    a = vectors(spark, sf_dir).select("id", F.col("vector").alias("a"))
    b = vectors(spark, sf_dir).select((F.col("id") - 1).alias("id"), F.col("vector").alias("b"))
    return a.join(b, "id").select("id", F.round(V.squared_distance(F.col("a"), F.col("b")), 6).alias("distance"))


@query("stored_vectors", "SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) + 0.0 AS total FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 2 = 0")
def stored_vectors(spark, sf_dir):
    """Every third stored vector is too short; even ids are asked for."""
    v = vectors(spark, sf_dir)
    stored = v.select("id", F.when(F.col("id") % 3 == 0, F.slice("vector", 1, 3)).otherwise(F.col("vector")).alias("vector"))
    got = readers.stored_vectors(stored, v.where("id % 2 = 0").select("id"), 64)
    return got.select("id", (F.round(F.aggregate("vector", F.lit(0.0), lambda m, x: m + x.cast("double")), 4) + F.lit(0.0)).alias("total"))


@query("clusters_without_vectors", f"""WITH {TICKETS}, r AS (SELECT id, org, row_number() OVER (PARTITION BY org ORDER BY date DESC, id) - 1 AS k, count(*) OVER (PARTITION BY org) AS n FROM tickets)
SELECT org AS workspace, id, CAST(CASE WHEN n <= 12 THEN 0 ELSE k // 8 END AS INTEGER) AS cluster, CAST(CASE WHEN n <= 12 THEN k ELSE k % 8 END AS INTEGER) AS pos FROM r""")
def clusters_without_vectors(spark, sf_dir):
    """Where most vectors are missing, consecutive records make the clusters."""
    t = tickets(spark, sf_dir).select("workspace", "id", "ordinal", F.lit(None).cast("array<double>").alias("vector"))
    return clusters.clustered(t)


@query("common_but_not_all", f"""WITH {TICKETS}, m AS (SELECT id % 40 AS cluster, id, text FROM tickets), sizes AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1),
words AS (SELECT cluster, word, count(*) AS n FROM (SELECT DISTINCT cluster, id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM m) WHERE length(word) > 3 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS rank FROM words JOIN sizes USING (cluster) WHERE n >= ceil(size * 0.1) AND n < size)
SELECT cluster, array_to_string(list(word ORDER BY rank), ',') AS words FROM ranked WHERE rank <= 4 GROUP BY 1""")
def common_but_not_all(spark, sf_dir):
    return patterns.common_words(members(spark, sf_dir), 0.1, 4, below_all=True).select("cluster", F.array_join("words", ",").alias("words"))


@query("best_threshold", "WITH s AS (SELECT p_size / 100.0 AS threshold, count(*) FILTER (p_retailprice > 1500) AS catch_alls, count(*) % 7 AS coverage FROM part GROUP BY 1) SELECT round(threshold, 2) AS threshold, catch_alls, coverage FROM s ORDER BY catch_alls, coverage DESC, threshold LIMIT 1")
def best_threshold(spark, sf_dir):
    s = table(spark, sf_dir, "part").groupBy(F.round(F.col("p_size") / 100, 2).alias("threshold")).agg(F.count_if(F.col("p_retailprice") > 1500).alias("catch_alls"), (F.count(F.lit(1)) % 7).alias("coverage"))
    return evaluate.best_threshold(s).select("threshold", "catch_alls", "coverage")


@query("sheet_records", f"""WITH {_ROWS} SELECT 'f#' || row_number() OVER (ORDER BY ordinal) AS id, CASE WHEN description = '' THEN title ELSE title || chr(10) || left(description, 500) END AS text, coalesce(nullif(owner, ''), 'Okänd') AS person,
array_to_string(list_filter([support_type, priority, product], lambda t: t <> ''), ',') AS tags FROM r""")
def sheet_records(spark, sf_dir):
    got = readers.evaluation_records(sheet(spark, sf_dir).withColumn("file", F.lit("f")))
    return got.select("id", "text", "person", F.array_join("tags", ",").alias("tags"))


@query("sealed_names", "SELECT s_suppkey AS id, s_name AS name, s_suppkey % 2 = 0 AS hidden FROM supplier")
def sealed_names(spark, sf_dir):
    """Names that are sealed, or stored as they are, read back."""
    key = b"0123456789abcdef"
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    stored = s.select("id", "s_name", F.when(F.col("id") % 2 == 0, sinks.sealed("s_name", key)).otherwise(F.col("s_name")).alias("stored"))
    return stored.select("id", sinks.unsealed("stored", key).alias("name"), (F.col("stored") != F.col("s_name")).alias("hidden"))


def _aliases() -> str:
    return "aliases(a, b) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in fixed.ALIASES.items()) + ")"


@query("query_words", f"""WITH q AS (SELECT s_suppkey AS id, 'Semantisk SÖKNING, ' || s_name || ': a regel #' || s_nationkey AS q FROM supplier),
w AS (SELECT id, list_filter(string_split_regex(lower(q), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2) AS w FROM q), {_aliases()}
SELECT DISTINCT id, word FROM (SELECT id, unnest(w) AS word FROM w UNION ALL SELECT id, b FROM (SELECT id, unnest(w) AS a FROM w) JOIN aliases USING (a))""")
def query_words(spark, sf_dir):
    """The words of many queries, and their aliases."""
    s = table(spark, sf_dir, "supplier")
    q = F.concat(F.lit("Semantisk SÖKNING, "), "s_name", F.lit(": a regel #"), F.col("s_nationkey").cast("string"))
    return s.select(F.col("s_suppkey").alias("id"), F.explode(T.query_words(q)).alias("word"))


_KINDS = """d AS (SELECT 'd' || p_partkey AS id, 'src/' || p_name AS path, CASE p_partkey % 3 WHEN 0 THEN 'DOC' WHEN 1 THEN 'CODE' ELSE 'ADR' END AS kind, p_type AS excerpt, p_brand AS content FROM part),
a AS (SELECT 'a' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN ' SRC/' || upper(p_name) ELSE '' END AS path, CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE s_name END AS title FROM supplier JOIN part ON p_partkey = s_suppkey),
r AS (SELECT 'r' || r_regionkey AS id, r_name AS title FROM region), c AS (SELECT 'c' || o_orderkey AS id, 'd' || (o_custkey % 300) AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS name, o_orderstatus AS body FROM orders),
l AS (SELECT id, list(DISTINCT rule ORDER BY rule) AS rules FROM (SELECT 'd' || n_nationkey AS id, 'r' || n_regionkey AS rule FROM nation UNION ALL SELECT 'd' || n_nationkey * 3, 'r' || (n_regionkey + 1) % 5 FROM nation) GROUP BY 1)"""


@query("entity_rows", f"""WITH {_KINDS}, e AS (SELECT id, 'File' AS entity_type, kind, path AS label, path, path || chr(10) || excerpt || chr(10) || content AS text, rules FROM d LEFT JOIN l USING (id) WHERE kind <> 'ADR' OR lower(trim(path)) NOT IN (SELECT lower(trim(path)) FROM a)
UNION ALL SELECT id, 'Rule', 'RULE', title, '', id || chr(10) || title || chr(10) || 'body', [id] FROM r UNION ALL SELECT id, 'ADR', 'ADR', coalesce(nullif(title, ''), id), path, path || chr(10) || title || chr(10) || 'body', [] FROM a
UNION ALL SELECT c.id, 'Chunk', 'chunk', coalesce(nullif(name, ''), c.id), coalesce(d.path, ''), coalesce(d.path, '') || chr(10) || name || chr(10) || 'f()' || chr(10) || body, l.rules FROM c LEFT JOIN (SELECT * FROM d WHERE kind = 'CODE') d ON d.id = file_id LEFT JOIN l ON l.id = file_id)
SELECT id, entity_type, kind, label, path, md5(text) AS text_md5, coalesce(array_to_string(rules, ','), '') AS rules FROM e""")
def entity_rows(spark, sf_dir):
    """Files, rules, decisions and parts of code as one relation."""
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    more = [F.lit("active").alias("status"), F.lit(True).alias("source_of_truth"), F.lit(50.0).alias("trust_level")]
    at = F.lit("2024-01-01").cast("timestamp")
    p, n = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    kind = F.when(_k() % 3 == 0, "DOC").when(_k() % 3 == 1, "CODE").otherwise("ADR")
    documents = p.select(text("d", _k()).alias("id"), F.concat(F.lit("src/"), "p_name").alias("path"), kind.alias("kind"), F.col("p_type").alias("excerpt"), F.col("p_brand").alias("content"), *more, at.alias("updated_at"))
    k = F.col("s_suppkey")
    adrs = table(spark, sf_dir, "supplier").join(p, _k() == k).select(
        text("a", k).alias("id"), F.when(k % 2 == 0, F.concat(F.lit(" SRC/"), F.upper("p_name"))).otherwise("").alias("path"), F.when(k % 5 == 0, "").otherwise(F.col("s_name")).alias("title"), F.lit("body").alias("body"), *more, at.alias("decision_date")
    )
    rules = table(spark, sf_dir, "region").select(text("r", F.col("r_regionkey")).alias("id"), F.col("r_name").alias("title"), F.lit("body").alias("body"), *more, at.alias("updated_at"))
    o = F.col("o_orderkey")
    chunks = table(spark, sf_dir, "orders").select(
        text("c", o).alias("id"), text("d", F.col("o_custkey") % 300).alias("file_id"), F.when(o % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("name"), F.lit("").alias("kind"), F.lit("f()").alias("signature"),
        F.col("o_orderstatus").alias("body"), *more, at.alias("updated_at"),
    )
    own = n.select(text("r", F.col("n_regionkey")).alias("from"), text("d", F.col("n_nationkey")).alias("to"), F.lit("CONSTRAINS").alias("relation"), F.lit("").alias("note"))
    done = n.select(text("d", F.col("n_nationkey") * 3).alias("from"), text("r", (F.col("n_regionkey") + 1) % 5).alias("to"), F.lit("IMPLEMENTS").alias("relation"), F.lit("").alias("note"))
    out = context.entities(documents, rules, adrs, chunks, own.union(done))
    return out.select("id", "entity_type", "kind", "label", "path", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.array_join("matched_rules", ",").alias("rules"))


@query("part_of_links", "SELECT 'c' || o_orderkey AS \"from\", 'd' || o_custkey AS \"to\", 'PART_OF' AS relation FROM orders WHERE o_orderkey % 4 <> 0")
def part_of_links(spark, sf_dir):
    k = F.col("o_orderkey")
    chunks = table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), k.cast("string")).alias("id"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("d"), F.col("o_custkey").cast("string"))).alias("file_id"))
    return context.part_of(chunks).drop("note")
