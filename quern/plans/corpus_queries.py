"""Queries over the text of records: classes, duplicates, topics, names, titles."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed
from quern.functions import text as T
from quern.operators import entities, patterns, records, topics
from quern.plans.bind import TICKETS, query, table, tickets
from quern.sources import readers


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _regex(some) -> str:
    return "'(?i)" + "|".join(f"(?:{p})" for p in some).replace("'", "''") + "'"


STOP = _list(fixed.STOP_WORDS)
PROPER = r"(regexp_matches({0}, '^[A-ZÄÖÅ][A-ZÄÖÅ0-9]{{2,}}$') OR regexp_matches({0}, '^[A-ZÄÖÅ][a-zäöå]+[A-ZÄÖÅ]'))"
CLASSIFIED = f"""classified AS (SELECT *, CASE WHEN regexp_matches(trim(text), {_regex(fixed.MONITORING)}) THEN 'monitoring_alert' WHEN regexp_matches(trim(text), {_regex(fixed.CONFIG)}) THEN 'config_change'
  WHEN regexp_matches(trim(text), {_regex(fixed.ADMIN)}) THEN 'administrative' WHEN regexp_matches(trim(text), {_regex(fixed.FORWARD)}) THEN 'forwarded_email' ELSE 'customer_incident' END AS ticket_class FROM tickets)"""
DUPLICATES = r"""keyed AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '^(?:fw|fwd|vb|sv|re):\s*', ''), '\s+', ' ', 'g'), '[#\[\](){}]', '', 'g')) AS title FROM classified),
duplicates AS (SELECT *, row_number() OVER (PARTITION BY batch, person, title ORDER BY date DESC, id) > 1 AS is_duplicate FROM keyed)"""
CORE = f"WITH {TICKETS}, {CLASSIFIED}, {DUPLICATES}, core AS (SELECT * FROM duplicates WHERE ticket_class NOT IN ('monitoring_alert', 'administrative') AND NOT is_duplicate)"
TERMS = (
    r"""cleaned AS (SELECT id, list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  concat_ws(' ', text, array_to_string(tags, ' ')), '(?i)\b(?:IS-|INC-|REF|REQ|SESD-|CAS-|CS)[0-9]+\b', '', 'g'), '(?i)\b[0-9A-F]{6,}\b', '', 'g'), '\S+@\S+', '', 'g'), '["''“”‘’`«»]', '', 'g'), '[()\[\]{}<>]', ' ', 'g'), '\s+'),
  lambda w: regexp_replace(w, '^[.,;:!?]+|[.,;:!?]+$', '', 'g')), lambda w: length(w) >= 2) AS w FROM tickets),
grams AS (SELECT id, list_concat(list_transform(list_filter(w, lambda x: NOT list_contains(STOP, lower(x)) AND NOT regexp_matches(x, '^[0-9]+$') AND NOT regexp_matches(x, '^[0-9]+\.[0-9]+')), lambda x: CASE WHEN PROPER THEN x ELSE lower(x) END),
  list_transform(list_filter(list_transform(range(1, len(w)), lambda i: [lower(w[i]), lower(w[i + 1])]), lambda p: NOT list_contains(STOP, p[1]) AND NOT list_contains(STOP, p[2]) AND NOT regexp_matches(p[1], '^[0-9]+$') AND NOT regexp_matches(p[2], '^[0-9]+$')), lambda p: p[1] || ' ' || p[2])) AS g FROM cleaned),
terms AS (SELECT id, term, count(*) AS tf, min(pos) AS first_pos FROM (SELECT id, unnest(g) AS term, unnest(range(len(g))) AS pos FROM grams) GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM terms GROUP BY 1),
band AS (SELECT * FROM dfs WHERE df >= 2 AND df <= ceil((SELECT count(*) FROM tickets) * 0.4)),
scored AS (SELECT id, term, tf, first_pos, tf * ln((SELECT count(*) FROM tickets)::DOUBLE / df) * CASE WHEN PROPER2 THEN 2.0 ELSE 1.0 END AS score FROM terms JOIN band USING (term)),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, first_pos, term) AS rank FROM scored),
topics AS (SELECT id, list(term ORDER BY rank) AS topics FROM best WHERE rank <= 5 GROUP BY 1)"""
).replace("PROPER2", PROPER.format("term")).replace("PROPER", PROPER.format("x")).replace("STOP", STOP)
NOUNS = (
    r"""nouns AS (SELECT DISTINCT id, noun FROM (SELECT id, unnest(list_concat(list_concat(regexp_extract_all(t, '\b([A-ZÄÖÅ][A-ZÄÖÅ0-9]{2,19})\b', 1), regexp_extract_all(t, '\b([A-ZÄÖÅ][a-zäöå]+[A-ZÄÖÅ][a-zA-ZäöåÄÖÅ0-9]*)\b', 1)),
  regexp_extract_all(t, '[a-zäöå.,;:]\s+([A-ZÄÖÅ][a-zäöåA-ZÄÖÅ0-9]{3,})\b', 1))) AS noun FROM (SELECT id, text AS t FROM tickets UNION ALL SELECT id, array_to_string(tags, ' ') FROM tickets))
  WHERE length(noun) >= 3 AND NOT list_contains(STOP, lower(noun)) AND NOT regexp_matches(noun, '(?i)^(IS-|INC-|REF|REQ|SESD-|CAS-|CS[0-9])') AND NOT regexp_matches(noun, '(?i)^[0-9A-F]{6,}$'))"""
).replace("STOP", STOP)
MEMBERS = "members AS (SELECT id % 40 AS cluster, * FROM tickets)"


def members(spark, sf_dir):
    """Records dealt into clusters by id, in the order of ids."""
    return tickets(spark, sf_dir).withColumn("cluster", F.col("id") % 40).withColumn("pos", F.col("id"))


@query("classify_counts", f"WITH {TICKETS}, {CLASSIFIED} SELECT ticket_class, ticket_class IN ('monitoring_alert', 'administrative') AS is_noise, count(*) AS n FROM classified GROUP BY 1, 2")
def classify_counts(spark, sf_dir):
    return records.classified(tickets(spark, sf_dir)).groupBy("ticket_class", "is_noise").agg(F.count(F.lit(1)).alias("n"))


_OWN = {"ring": [r"\bring\b"], "coloured": ["red|blue|green"], "sized": ["^small", "^large"]}


@query("classify_rows", """SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '(?i)\\bring\\b') THEN 'ring' WHEN regexp_matches(p_name, '(?i)red|blue|green') THEN 'coloured'
 WHEN regexp_matches(p_name, '(?i)^small|^large') THEN 'sized' ELSE 'customer_incident' END AS ticket_class FROM part""")
def classify_rows(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.classify(F.col("p_name"), _OWN).alias("ticket_class"))


@query("batch_dedupe", f"WITH {TICKETS}, {CLASSIFIED}, {DUPLICATES} SELECT id, batch, person, is_duplicate FROM duplicates")
def batch_dedupe(spark, sf_dir):
    return records.with_duplicates(tickets(spark, sf_dir)).select("id", "batch", "person", "is_duplicate")


@query("core_filter", CORE + " SELECT id, batch, ticket_class FROM core")
def core_filter(spark, sf_dir):
    return records.core(tickets(spark, sf_dir)).select("id", "batch", "ticket_class")


@query("batch_context", f"""WITH {TICKETS}, {CLASSIFIED} SELECT * FROM (SELECT 'person' AS kind, person AS value, count(*) AS n FROM classified GROUP BY 2 ORDER BY n DESC, value LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'tag', tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM classified) GROUP BY 2 ORDER BY n DESC, tag LIMIT 5)
UNION ALL SELECT 'class', ticket_class, count(*) FROM classified GROUP BY 2
UNION ALL SELECT 'noise', 'noise', count(*) FILTER (ticket_class IN ('monitoring_alert', 'administrative')) FROM classified""")
def batch_context(spark, sf_dir):
    return records.batch_context(records.classified(tickets(spark, sf_dir)))


@query("line_import", "SELECT id, pos, trim(line) AS text FROM (SELECT doc_id AS id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE trim(line) <> ''")
def line_import(spark, sf_dir):
    return readers.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("raw"))).withColumn("pos", F.col("pos").cast("long"))


@query("term_freq", f"WITH {TICKETS}, {TERMS} SELECT id, term, tf FROM terms")
def term_freq(spark, sf_dir):
    return topics.term_counts(tickets(spark, sf_dir)).select("id", "term", "tf")


@query("doc_freq", f"WITH {TICKETS}, {TERMS} SELECT term, df FROM dfs")
def doc_freq(spark, sf_dir):
    return topics.document_counts(tickets(spark, sf_dir))


@query("df_band", f"WITH {TICKETS}, {TERMS} SELECT term, df FROM band")
def df_band(spark, sf_dir):
    return topics.banded(tickets(spark, sf_dir))


@query("tfidf", f"WITH {TICKETS}, {TERMS} SELECT id, term, tf, round(score, 6) AS score FROM scored")
def tfidf(spark, sf_dir):
    return topics.tf_idf(tickets(spark, sf_dir)).select("id", "term", "tf", (F.round(F.col("score") * 1e6) / 1e6).alias("score"))


@query("tfidf_top5", f"WITH {TICKETS}, {TERMS} SELECT t.id, coalesce(array_to_string(topics, ','), '') AS topics, CASE WHEN topics IS NULL THEN 'UNKNOWN' ELSE array_to_string(topics[1:3], '|') END AS signature FROM tickets t LEFT JOIN topics USING (id)")
def tfidf_top5(spark, sf_dir):
    return topics.corpus_topics(tickets(spark, sf_dir)).select("id", F.array_join("topics", ",").alias("topics"), "signature")


_CLUSTER_TOPICS = f"""WITH {TICKETS}, {TERMS}, each AS (SELECT id % 40 AS cluster, id, unnest(topics) AS topic, unnest(range(len(topics))) AS pos FROM topics),
sizes AS (SELECT id % 40 AS cluster, count(*) AS size FROM tickets GROUP BY 1),
ranked AS (SELECT cluster, topic, sum(5 - pos) AS score, count(*) AS held, min(struct_pack(id := id, pos := pos)) AS first, any_value(size) AS size FROM each JOIN sizes USING (cluster) GROUP BY 1, 2),
listed AS (SELECT cluster, list(topic ORDER BY score DESC, first, topic) AS topics FROM ranked WHERE held >= CASE WHEN size <= 3 THEN 1 ELSE 2 END GROUP BY 1),
single AS (SELECT cluster, topics, list_transform(list_filter(topics, lambda t: NOT contains(t, ' ')), lambda t: lower(t)) AS s FROM listed)"""


@query("cluster_topics", _CLUSTER_TOPICS + " SELECT cluster, array_to_string(topics, ',') AS topics FROM listed")
def cluster_topics(spark, sf_dir):
    t = tickets(spark, sf_dir)
    scored = topics.cluster_scores(topics.corpus_topics(t), t.select("id", (F.col("id") % 40).alias("cluster")))
    place = F.struct((-F.col("score")).alias("s"), F.col("first").alias("f"), F.col("topic").alias("t"))
    return scored.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["t"]), ",").alias("topics"))


@query("bigram_prune", _CLUSTER_TOPICS + " SELECT cluster, array_to_string(list_filter(topics, lambda t: NOT contains(t, ' ') OR len(list_filter(string_split(lower(t), ' '), lambda w: NOT list_contains(s, w))) > 0), ',') AS topics FROM single")
def bigram_prune(spark, sf_dir):
    t = tickets(spark, sf_dir)
    return topics.cluster_topics(topics.corpus_topics(t), t.select("id", (F.col("id") % 40).alias("cluster"))).select("cluster", F.array_join("topics", ",").alias("topics"))


@query("proper_nouns", f"WITH {TICKETS}, {NOUNS} SELECT noun, count(*) AS df FROM nouns GROUP BY 1")
def proper_nouns(spark, sf_dir):
    return entities.nouns(tickets(spark, sf_dir)).groupBy("noun").agg(F.count(F.lit(1)).alias("df"))


@query("corpus_entities", f"""WITH {TICKETS}, {NOUNS}, ok AS (SELECT noun FROM nouns GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= ceil((SELECT count(*) FROM tickets) * 0.5)),
kept AS (SELECT id, list(noun ORDER BY noun) AS e FROM nouns JOIN ok USING (noun) GROUP BY 1) SELECT id, coalesce(array_to_string(e, ','), '') AS entities FROM tickets LEFT JOIN kept USING (id)""")
def corpus_entities(spark, sf_dir):
    return entities.corpus_entities(tickets(spark, sf_dir)).select("id", F.array_join("entities", ",").alias("entities"))


_ACTIONS_SQL = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{a}\\b') THEN '{a}' END" for a in fixed.ACTIONS) + "], lambda a: a IS NOT NULL)"


@query("entity_signature", f"""WITH {TICKETS}, {NOUNS}, s AS (SELECT id, list(noun ORDER BY noun) AS s FROM nouns GROUP BY 1), a AS (SELECT id, {_ACTIONS_SQL} AS a FROM tickets)
SELECT id, coalesce(len(s), 0) AS systems, len(a) AS actions, CASE WHEN s IS NULL AND len(a) = 0 THEN 'UNKNOWN' ELSE array_to_string(list_concat(coalesce(s, []), a[1:1]), '|') END AS signature FROM a LEFT JOIN s USING (id)""")
def entity_signature(spark, sf_dir):
    return entities.extracted(tickets(spark, sf_dir)).select("id", F.size("systems").cast("long").alias("systems"), F.size("actions").cast("long").alias("actions"), "signature")


_WORDS_SQL = f"""WITH {TICKETS}, {MEMBERS}, sizes AS (SELECT cluster, count(*) AS size FROM members GROUP BY 1),
words AS (SELECT cluster, word, count(*) AS n FROM (SELECT DISTINCT cluster, id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM members) WHERE length(word) > 3 GROUP BY 1, 2)"""


@query("common_keywords", _WORDS_SQL + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS rank FROM words JOIN sizes USING (cluster) WHERE n >= ceil(size * 0.1))
SELECT cluster, array_to_string(list(word ORDER BY rank), ',') AS words FROM ranked WHERE rank <= 5 GROUP BY 1""")
def common_keywords(spark, sf_dir):
    return patterns.common_words(members(spark, sf_dir), 0.1, 5).select("cluster", F.array_join("words", ",").alias("words"))


@query("action_words", f"""WITH {TICKETS}, {MEMBERS}, sizes AS (SELECT cluster, count(*) AS size FROM members GROUP BY 1), acts AS (SELECT unnest({_list(fixed.TITLE_ACTIONS)}) AS word, unnest(range({len(fixed.TITLE_ACTIONS)})) AS k),
hits AS (SELECT cluster, k, word, count(*) AS n FROM members JOIN acts ON contains(lower(text), word) GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, k) AS r FROM hits JOIN sizes USING (cluster) WHERE n >= ceil(size * 0.02))
SELECT s.cluster, word AS action FROM sizes s LEFT JOIN (SELECT * FROM ranked WHERE r = 1) x USING (cluster)""")
def action_words(spark, sf_dir):
    return patterns.action_words(members(spark, sf_dir), 0.02)


@query("evidence_top3", f"""WITH {TICKETS}, {MEMBERS}, r AS (SELECT cluster, id, text, person, row_number() OVER (PARTITION BY cluster ORDER BY date DESC, id) AS pos FROM members)
SELECT cluster, pos, md5(text) AS text_md5, person FROM r WHERE pos <= 3""")
def evidence_top3(spark, sf_dir):
    m = tickets(spark, sf_dir).withColumn("cluster", F.col("id") % 40)
    out = patterns.evidence(m.select("cluster", "id", "ordinal"), m.select("id", "text", "person"), "ordinal")
    return out.select("cluster", "pos", F.md5(F.col("text").cast("binary")).alias("text_md5"), "person")
