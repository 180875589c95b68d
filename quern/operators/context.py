"""Ranked search over linked knowledge, bounded traversal, and rule listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import fixed, scoring
from quern.functions import text as T
from quern.functions import vectors as V

ENTITY = ["id", "entity_type", "kind", "label", "path", "text", "status", "source_of_truth", "trust_level", "updated_at", "snippet", "matched_rules"]
RELATION = ["from", "to", "relation", "note"]


def rule_links(relations: DataFrame) -> DataFrame:
    """(id, rules): rules that constrain a file, and rules that a file implements."""
    constrains = relations.where("relation = 'CONSTRAINS'").select(F.col("to").alias("id"), F.col("from").alias("rule"))
    implements = relations.where("relation = 'IMPLEMENTS'").select(F.col("from").alias("id"), F.col("to").alias("rule"))
    return constrains.union(implements).groupBy("id").agg(F.array_sort(F.collect_set("rule")).alias("rules"))


def degrees(relations: DataFrame) -> DataFrame:
    """(id, degree): how many stored relations touch an entity; part-of links don't count."""
    ends = relations.select(F.explode(F.array("from", "to")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def part_of(chunks: DataFrame) -> DataFrame:
    """Relations of chunks to their files, which only traversal sees."""
    return chunks.where(F.coalesce("file_id", F.lit("")) != "").select(F.col("id").alias("from"), F.col("file_id").alias("to"), F.lit("PART_OF").alias("relation"), F.lit("Chunk belongs to file").alias("note"))


def entities(documents: DataFrame, rules: DataFrame, adrs: DataFrame, chunks: DataFrame, relations: DataFrame) -> DataFrame:
    """All kinds as one relation (ENTITY). A document of kind ADR that an ADR stands for is left out."""
    links = rule_links(relations)
    none = F.array().cast("array<string>")
    lines = lambda *c: F.concat_ws("\n", *[F.coalesce(x, F.lit("")) for x in c])
    path = lambda c: F.lower(T.trim(F.col(c)))
    stood_for = adrs.select(path("path").alias("_path")).where("_path <> ''").distinct()
    files = documents.withColumn("_path", F.when(F.col("kind") == "ADR", path("path"))).join(stood_for, "_path", "left_anti").join(links, "id", "left")
    out = files.select(
        "id", F.lit("File").alias("entity_type"), "kind", F.col("path").alias("label"), "path", lines(F.col("path"), F.col("excerpt"), F.col("content")).alias("text"),
        "status", "source_of_truth", "trust_level", "updated_at", F.col("excerpt").alias("snippet"), F.coalesce("rules", none).alias("matched_rules"),
    )
    named = T.first_text(F.col("title"), F.col("id"))
    out = out.unionByName(rules.select(
        "id", F.lit("Rule").alias("entity_type"), F.lit("RULE").alias("kind"), named.alias("label"), F.lit("").alias("path"), lines(F.col("id"), F.col("title"), F.col("body")).alias("text"),
        "status", "source_of_truth", "trust_level", "updated_at", F.substring("body", 1, 500).alias("snippet"), F.array("id").alias("matched_rules"),
    ))
    out = out.unionByName(adrs.select(
        "id", F.lit("ADR").alias("entity_type"), F.lit("ADR").alias("kind"), named.alias("label"), "path", lines(F.col("path"), F.col("title"), F.col("body")).alias("text"),
        "status", "source_of_truth", "trust_level", F.col("decision_date").alias("updated_at"), F.substring("body", 1, 500).alias("snippet"), none.alias("matched_rules"),
    ))
    code = documents.where("kind = 'CODE'").select(F.col("id").alias("file_id"), F.col("path").alias("_file"))
    parts = chunks.join(code, "file_id", "left").join(links.withColumnRenamed("id", "file_id"), "file_id", "left").withColumn("_file", F.coalesce("_file", F.lit("")))
    return out.unionByName(parts.select(
        "id", F.lit("Chunk").alias("entity_type"), T.first_text(F.col("kind"), F.lit("chunk")).alias("kind"), T.first_text(F.col("name"), F.col("id")).alias("label"), F.col("_file").alias("path"),
        lines(F.col("_file"), F.col("name"), F.col("signature"), F.col("body")).alias("text"),
        "status", "source_of_truth", "trust_level", "updated_at", F.substring("body", 1, 500).alias("snippet"), F.coalesce("rules", none).alias("matched_rules"),
    ))


def search(found: DataFrame, relations: DataFrame, query: str, now: Column, top_k: int = 5, include_deprecated: bool = False, vectors: DataFrame | None = None, query_vector: list[float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """The top_k entities (ENTITY columns of found) with their scores, ties by id. One plan; nothing is collected.

    vectors is (id, vector); without it, or a query vector, the score is lexical.
    """
    if not 1 <= top_k <= 20:
        raise ValueError("top_k is 1 to 20")
    phrase = T.query_tokens(query) and query.lower().strip()
    if not include_deprecated:
        found = found.where(F.lower("status") != "deprecated")
    found = found.withColumn("text", T.nfkc(F.col("text")))
    found = found.withColumn("lexical", T.lexical_score(T.query_tokens(query), phrase or "", F.col("text")))
    if vectors is not None and query_vector:
        found = found.join(vectors.select("id", "vector"), "id", "left")
        asked = F.array(*[F.lit(float(x)) for x in query_vector])
        found = found.withColumn("embedding_score", F.coalesce(scoring.clamp(V.cosine(asked, F.col("vector"))), F.lit(0.0)))
    else:
        found = found.withColumn("embedding_score", F.lit(0.0))
    found = found.where((F.col("lexical") >= fixed.LEXICAL_FLOOR) | (F.col("embedding_score") >= fixed.VECTOR_FLOOR)).join(degrees(relations), "id", "left")
    found = found.withColumn("semantic", scoring.semantic(F.col("lexical"), F.col("embedding_score"))).withColumn("degree", F.coalesce("degree", F.lit(0)))
    score = scoring.search_score(F.col("semantic"), F.col("degree"), F.col("trust_level"), scoring.recency(F.col("updated_at"), now), F.col("source_of_truth"), weights)
    out = found.select(
        "id", "entity_type", "kind", F.col("label").alias("title"), "path", F.round(score, 4).alias("score"), F.round("semantic", 4).alias("semantic_score"), F.round("embedding_score", 4).alias("embedding_score"),
        F.round("lexical", 4).alias("lexical_score"), F.round(F.least(F.lit(1.0), F.col("degree") / 4), 4).alias("graph_score"), "source_of_truth", "status", "updated_at", "matched_rules", F.col("snippet").alias("excerpt"),
    )
    return out.orderBy(F.desc("score"), "id").limit(top_k)


def related(relations: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """(id, hops, via_relation, direction) of what start (id) reaches, in either direction, within depth (1 to 3).

    The relation is that of the first edge in order: fewest hops, outgoing
    first, then by the near end, relation and note. Each hop is two equi-joins
    on the frontier, and what was seen before is left out.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth is 1 to 3")
    both = relations.select(F.col("from").alias("near"), F.col("to").alias("id"), "relation", F.lit("outgoing").alias("direction"), F.lit(0).alias("way"), "note")
    both = both.union(relations.select(F.col("to").alias("near"), F.col("from").alias("id"), "relation", F.lit("incoming").alias("direction"), F.lit(1).alias("way"), "note"))
    seen, frontier, out = start.select("id"), start.select(F.col("id").alias("near")), None
    for hop in range(1, depth + 1):
        reached = both.join(frontier, "near", "left_semi").join(seen, "id", "left_anti")
        first = reached.groupBy("id").agg(F.min(F.struct("near", "way", "relation", "note", "direction")).alias("e"))
        step = first.select("id", F.lit(hop).alias("hops"), F.col("e.relation").alias("via_relation"), F.col("e.direction").alias("direction"))
        out = step if out is None else out.union(step)
        seen, frontier = seen.union(step.select("id")), step.select(F.col("id").alias("near"))
    return out


def traversed(relations: DataFrame, start: DataFrame, reached: DataFrame, depth: int) -> DataFrame:
    """Distinct relations of all expanded entities: the start and what is nearer than depth."""
    expanded = start.select("id").union(reached.where(F.col("hops") < depth).select("id")).distinct()
    out = relations.join(expanded.withColumnRenamed("id", "from"), "from", "left_semi").select(*RELATION)
    return out.union(relations.join(expanded.withColumnRenamed("id", "to"), "to", "left_semi").select(*RELATION)).distinct()


def rules(found: DataFrame, scope: str | None = None, include_inactive: bool = False) -> DataFrame:
    """Active rules (all, if asked) of the scope or global, by priority; ties by id."""
    if not include_inactive:
        found = found.where("status = 'active'")
    if scope:
        found = found.where((F.col("scope") == scope) | (F.col("scope") == "global"))
    return found.select("id", "title", F.col("body").alias("description"), "priority", "scope", "status").orderBy(F.desc("priority"), "id")


def loaded_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations both of whose ends are nodes (id); dangling ones vanish."""
    ends = nodes.select("id").distinct()
    return relations.join(ends.withColumnRenamed("id", "from"), "from", "left_semi").join(ends.withColumnRenamed("id", "to"), "to", "left_semi").select(*RELATION)


def graph_counts(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """(name, n) for every node label and relation kind."""
    return nodes.groupBy(F.col("label").alias("name")).agg(F.count(F.lit(1)).alias("n")).union(relations.groupBy(F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")))


def to_embed(items: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """items (id, text) with signature, and the index's vector where id, signature and model agree; else null."""
    signed = items.withColumn("signature", F.sha2(F.substring(T.squeeze(T.trim(F.col("text"))), 1, 7000), 256))
    known = index.where(F.col("model") == model).groupBy("id", "signature").agg(F.first("vector").alias("vector"))
    return signed.join(known, ["id", "signature"], "left")
