"""Queries over vectors and over scores of scope, trend and confidence."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quern.functions import scoring
from quern.functions import vectors as V
from quern.operators import analytics, patterns, set_join
from quern.operators.lineage import kept
from quern.plans.bind import TICKETS, query, table

_V = "v AS (SELECT vec_id AS id, label AS cluster, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
_PAIRS = f"WITH {_V}, pairs AS (SELECT a.cluster, a.id AS i, b.id AS j, list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) AS sim FROM v a JOIN v b ON a.cluster = b.cluster AND a.id < b.id)"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))


#: Vectors of a cluster that a task multiplies with as many others.
BLOCK = 4096


def pairs(v, digits: int):
    """(cluster, i, j, sim) for all i < j of a cluster of v (id, cluster, vector): cosines to so many digits, 0 for zero vectors, null for missing ones and other lengths.

    A cluster is dealt into blocks; each two blocks meet in one place, where a
    matrix product gives all their pairs. Vectors get length 1 once.
    """
    spark, kinds = v.sparkSession, dict(v.dtypes)
    v = v.where("id is not null and cluster is not null").select("cluster", "id", F.col("vector").cast("array<double>").alias("vector"))
    v = v.withColumn("width", F.when(F.col("vector").isNull() | F.exists("vector", lambda x: x.isNull()), -1).otherwise(F.size("vector")))
    count = v.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    v = v.join(count, "cluster").withColumn("b", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def pack(t: pa.Table) -> pa.Table:
        width = t["width"][0].as_py()
        x = np.array(t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(t.num_rows, width) if width > 0 else np.zeros((t.num_rows, 0))
        size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        x = np.divide(x, size, out=np.zeros_like(x), where=~(size <= 0))
        return pa.table({"cluster": t["cluster"][:1], "name": [f"{t['b'][0]}/{width}"], "width": pa.array([width], pa.int32()), "ids": [t["id"].to_numpy().astype("<i8").tobytes()], "xs": [x.tobytes()]})

    packed = kept(v.groupBy("cluster", "b", "width").applyInArrow(pack, f"cluster {kinds['cluster']}, name string, width int, ids binary, xs binary"))
    # Few bytes become many rows, so tiles are dealt by number.
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tiles = packed.toDF("cluster", "a", "wa", "ia", "xa").join(packed.toDF("cluster", "b", "wb", "ib", "xb"), "cluster").where("a <= b").repartition(n, "cluster", "a", "b")

    def run(batches):
        for t in batches:
            for k in range(t.num_rows):
                row = {c: t.column(t.schema.names.index(c))[k].as_py() for c in t.schema.names}
                left, right = np.frombuffer(row["ia"], "<i8"), np.frombuffer(row["ib"], "<i8")
                known = row["wa"] == row["wb"] >= 0
                x, y = (np.frombuffer(row[c], "<f8").reshape(len(i), max(row["wa"], 0)) if known else None for c, i in (("xa", left), ("xb", right)))
                for lo in range(0, len(left), 64):
                    i, j = np.broadcast_arrays(left[lo : lo + 64, None], right[None, :])
                    keep = i < j if row["a"] == row["b"] else i != j
                    sim = None
                    if known:
                        # Half away from zero, as SQL rounds.
                        sim = (x[lo : lo + 64] @ y.T)[keep] * 10.0**digits
                        whole = np.trunc(sim)
                        sim = (whole + np.copysign(np.abs(sim - whole) >= 0.5, sim)) / 10.0**digits + 0.0
                    i, j = i[keep], j[keep]
                    cluster = pa.array([row["cluster"]], t.schema.field("cluster").type).take(pa.array(np.zeros(len(i), np.int32)))
                    yield pa.record_batch([cluster, pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j)), pa.array(sim) if known else pa.nulls(len(i), pa.float64())], ["cluster", "i", "j", "sim"])

    return tiles.mapInArrow(run, f"cluster {kinds['cluster']}, i long, j long, sim double")


@query("pair_similarity", _PAIRS + " SELECT cluster, i, j, round(sim, 4) + 0.0 AS sim FROM pairs")
def pair_similarity(spark, sf_dir):
    return pairs(vectors(spark, sf_dir), 4)


@query("avg_linkage", _PAIRS + " SELECT cluster, round(avg(sim), 8) AS linkage, count(*) AS n FROM pairs GROUP BY 1")
def avg_linkage(spark, sf_dir):
    return patterns.linkage(vectors(spark, sf_dir)).select("cluster", F.round("linkage", 8).alias("linkage"), "n")


_CENTROIDS = f"WITH {_V}, e AS (SELECT cluster, unnest(x) AS x, unnest(range(len(x))) AS pos FROM v), c AS (SELECT cluster, pos, avg(x) AS x FROM e GROUP BY 1, 2)"


@query("centroid", _CENTROIDS + " SELECT cluster, pos, round(x, 8) AS x FROM c")
def centroid(spark, sf_dir):
    return patterns.centroids(vectors(spark, sf_dir)).select("cluster", F.posexplode("centroid").alias("pos", "x")).select("cluster", F.col("pos").cast("long").alias("pos"), F.round("x", 8).alias("x"))


@query("centroid_pairs", _CENTROIDS + """, l AS (SELECT cluster, list(x ORDER BY pos) AS x FROM c GROUP BY 1)
SELECT a.cluster AS i, b.cluster AS j, round(list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))), 6) AS sim FROM l a JOIN l b ON a.cluster < b.cluster""")
def centroid_pairs(spark, sf_dir):
    c = patterns.centroids(vectors(spark, sf_dir))
    # A row per cluster on either side.
    both = c.toDF("i", "x").join(c.toDF("j", "y"), F.col("i") < F.col("j"))
    return both.select("i", "j", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("sim"))


@query("topic_jaccard", """WITH p AS (SELECT p_partkey AS id, p_brand AS brand, p_size AS size, list_distinct(string_split(lower(p_name), ' ')) AS t FROM part)
SELECT a.id AS i, b.id AS j, round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) AS jaccard FROM p a JOIN p b ON a.brand = b.brand AND a.size = b.size AND a.id < b.id""")
def topic_jaccard(spark, sf_dir):
    """Every pair is a row; overlaps are computed once for each two different names of a brand and size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.coalesce(F.concat(F.lit("="), "p_name"), F.lit("")).alias("t"))
    names = p.select("p_brand", "p_size", "t").distinct()
    words = names.select("p_brand", "p_size", "t", F.split(F.when(F.col("t") != "", F.substring("t", 2, 2**31 - 1)), " ").alias("w"))
    two = words.toDF("p_brand", "p_size", "a", "x").join(words.toDF("p_brand", "p_size", "b", "y"), ["p_brand", "p_size"])
    # As in SQL, a missing first name gives none, a missing second one 0.
    overlap = F.when(F.col("x").isNotNull(), F.round(V.jaccard(F.col("x"), F.col("y")), 6))
    two = two.select("p_brand", "p_size", "a", "b", overlap.alias("jaccard"))
    both = p.toDF("i", "p_brand", "p_size", "a").join(two, ["p_brand", "p_size", "a"]).join(p.toDF("j", "p_brand", "p_size", "b"), ["p_brand", "p_size", "b"])
    return both.where("i < j").select("i", "j", "jaccard")


@query("similar_topics", """WITH p AS (SELECT p_partkey AS id, p_size AS size, list_distinct(string_split(lower(p_name), ' ') || [p_brand, lower(p_type)]) AS t FROM part),
j AS (SELECT a.size, a.id AS i, b.id AS j, len(list_intersect(a.t, b.t)) AS k, len(a.t) AS n, len(b.t) AS m FROM p a JOIN p b ON a.size = b.size AND a.id < b.id)
SELECT size, i, j, round(k::DOUBLE / (n + m - k), 6) AS overlap FROM j WHERE k::DOUBLE / (n + m - k) >= 0.3""")
def similar_topics(spark, sf_dir):
    """Parts of one size whose words overlap by .3 or more, by the join of similar sets."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"), F.concat(F.split(F.lower("p_name"), " "), F.array("p_brand", F.lower("p_type"))).alias("t"))
    return set_join.similar(p, 0.3, "size", "id", "t").select("size", "i", "j", F.round("overlap", 6).alias("overlap"))


@query("trend", """WITH d AS (SELECT user_id, event_type, epoch_us(ts) AS t FROM events), m AS (SELECT user_id, event_type, min(t) AS lo, max(t) AS hi, count(*) AS n FROM d GROUP BY 1, 2),
e AS (SELECT user_id, event_type, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n, count(*) FILTER ((t - lo) * 2 <= hi - lo) AS early FROM d JOIN m USING (user_id, event_type) GROUP BY 1, 2)
SELECT user_id, event_type, n, CASE WHEN n < 3 OR hi - lo < 604800000000 THEN 'ISOLATED' WHEN n - early >= early * 2 THEN 'ESCALATING' ELSE 'RECURRING' END AS trend FROM e""")
def trend(spark, sf_dir):
    return analytics.trends(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts")


_META = f"""WITH {TICKETS}, g AS (SELECT id % 40 AS cluster, count(DISTINCT CASE WHEN id % 3 = 0 THEN nullif(org, '') END) AS orgs, count(DISTINCT person) AS persons, count(*) AS n FROM tickets GROUP BY 1),
s AS (SELECT *, CASE WHEN (CASE WHEN orgs > 0 THEN orgs ELSE persons END) <= 1 THEN 'SINGLE' WHEN (CASE WHEN orgs > 0 THEN orgs ELSE persons END) <= 3 THEN 'CROSS_PERSON' ELSE 'CROSS_TEAM' END AS scope FROM g)"""


def _scoped(spark, sf_dir):
    from quern.plans.bind import tickets

    t = tickets(spark, sf_dir).withColumn("cluster", F.col("id") % 40).withColumn("org", F.when(F.col("id") % 3 == 0, F.nullif("org", F.lit(""))))
    g = t.groupBy("cluster").agg(F.count_distinct("org").alias("orgs"), F.count_distinct("person").alias("persons"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("scope", scoring.scope(F.col("orgs"), F.col("persons")))


@query("scope", _META + " SELECT cluster, orgs, persons, scope FROM s")
def scope(spark, sf_dir):
    return _scoped(spark, sf_dir).select("cluster", "orgs", "persons", "scope")


@query("confidence", _META + " SELECT cluster, CASE WHEN n >= 5 AND cluster % 2 = 0 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM s")
def confidence(spark, sf_dir):
    return _scoped(spark, sf_dir).select("cluster", scoring.confidence(F.col("n"), F.col("cluster") % 2 == 0).alias("confidence"))


@query("pattern_type", _META + " SELECT cluster, CASE WHEN cluster % 5 = 0 THEN 'ESCALATING' WHEN scope = 'SINGLE' THEN 'RECURRING' ELSE scope END AS pattern_type FROM s")
def pattern_type(spark, sf_dir):
    t = F.when(F.col("cluster") % 5 == 0, "ESCALATING").otherwise("RECURRING")
    return _scoped(spark, sf_dir).select("cluster", scoring.pattern_type(F.col("scope"), t).alias("pattern_type"))


@query("title_collisions", """WITH p AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS title, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'p' || p_size END AS person FROM part),
w AS (SELECT *, count(*) OVER (PARTITION BY title) AS n, row_number() OVER (PARTITION BY title ORDER BY id) AS k FROM p)
SELECT id, CASE WHEN n = 1 THEN title WHEN k <= 2 AND person <> '' THEN title || ' (' || person || ')' ELSE title || ' #' || k END AS title FROM w""")
def title_collisions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("title"), F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("p"), F.col("p_size").cast("string"))).alias("person")
    )
    return patterns.numbered_titles(p, ["id"]).select("id", "title")


@query("recency", "SELECT o_orderkey AS id, round(1 / (1 + greatest(0, (epoch_us(TIMESTAMP '1998-06-01') - epoch_us(o_orderdate)) / 864e8) / 30), 8) AS recency FROM orders")
def recency(spark, sf_dir):
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(scoring.recency(F.col("o_orderdate").cast("timestamp"), at), 8).alias("recency"))


@query("staleness", """WITH d AS (SELECT o_orderkey AS id, greatest(0, (epoch_us(TIMESTAMP '1998-06-01') - epoch_us(o_orderdate)) / 864e8) AS days FROM orders)
SELECT id, CASE WHEN days < 7 THEN NULL WHEN floor(days / 7) < 4 THEN CAST(floor(days / 7) AS BIGINT) || 'v' ELSE CAST(floor(days / 30) AS BIGINT) || 'm' END AS label FROM d""")
def staleness(spark, sf_dir):
    at = F.lit("1998-06-01 00:00:00").cast("timestamp")
    days = scoring.days_since(F.col("o_orderdate").cast("timestamp"), at)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), scoring.staleness(days).alias("label"))
