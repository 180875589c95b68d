"""An inverted index for ranked search: texts are normalised and parted into tokens once, a query reads its own tokens' postings.

Entities are numbered as their texts are written, in place. Postings lie in
folders by a hash of their token, sorted: a row has the places that a token has
in a block of numbers, so a token moves once for many entities. What the score
needs besides the text, degree, trust and age, is a narrow table by number. So a
query knows each candidate's score up to the bonus for its phrase, which is at
most a fixed number. Only candidates whose score with the bonus reaches the
top_k-th score without it have their text looked at. No Python runs on rows at
query time, and the result is that of context.search, which reads every text.

The tables are kept with a log (see sources.log): an index that is built anew
takes the place of the old one in one commit, and every query reads the last.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import fixed, scoring
from quern.functions import text as T
from quern.functions import vectors as V
from quern.operators import context
from quern.sources.log import TableLog

#: Bytes of text that a folder of postings stands for, folders at least, tasks that write one folder.
FOLDER_BYTES, FOLDERS, SPREAD = 256 << 20, 16, 4
#: Candidates and finalists up to which their facts and texts are read by their numbers, in so many ranges; more are joined.
NAMED, RANGES = 1000, 32
#: Bits of a number that are its place in its block (a short), tokens that are put in order together.
PLACE, TOGETHER = 15, 4_000_000

FACTS = ["degree", "trust_level", "source_of_truth", "updated_at", "live"]
SHOWN = ["entity_type", "kind", "label", "path", "status", "snippet", "matched_rules"]


def _folder(c: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(n)).cast("int")


def _named(numbers: list[int]) -> Column:
    """The rows of these numbers. A file has a range of numbers, in order, so the ranges leave out files and pages."""
    own = sorted(set(numbers))
    step = -(-len(own) // RANGES) or 1
    ranges = [F.col("number").between(own[k], own[min(k + step, len(own)) - 1]) for k in range(0, len(own), step)]
    return reduce(lambda x, y: x | y, ranges, F.lit(False)) & F.col("number").isin(own)


def _by_token(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    tokens = pa.chunked_array([c.flatten() for c in rows["tokens"].chunks], pa.string()).combine_chunks().dictionary_encode()
    numbers = np.repeat(rows["number"].to_numpy(), pc.list_value_length(rows["tokens"]).to_numpy())
    codes = tokens.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    codes, numbers = codes[order], numbers[order]
    blocks = numbers >> PLACE
    first = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])][: len(codes)])
    places = pa.array((numbers & ((1 << PLACE) - 1)).astype(np.int16))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(codes)].astype(np.int32)), places)
    return pa.RecordBatch.from_arrays([tokens.dictionary.take(pa.array(codes[first])), pa.array(blocks[first]), lists], ["token", "block", "places"])


def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, block, places) of (number, tokens): a row for each token and block of the rows that are read together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b["tokens"].flatten())
        if n >= TOGETHER:
            yield _by_token(held)
            held, n = [], 0
    if held:
        yield _by_token(held)


class SearchIndex:
    """The index below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, TableLog(spark, folder)

    def _tables(self, entities: DataFrame, relations: DataFrame, vectors: DataFrame | None, folders: int | None) -> dict:
        """The tables in the order in which they are written; all but the texts are made from what is written of those before.

        Two writers may give the same numbers, so a number counts within its batch.
        """
        live = F.coalesce(F.lower("status") != "deprecated", F.lit(False))
        batch = F.lit(uuid.uuid4().int >> 65).alias("batch")
        texts = entities.select(batch, F.monotonically_increasing_id().alias("number"), "id", T.nfkc(F.coalesce("text", F.lit(""))).alias("text"), *SHOWN, *[c for c in FACTS if c not in ("degree", "live")], live.alias("live"))

        def settings(done: dict[str, DataFrame]) -> DataFrame:
            size = 0 if folders else done["texts"].agg(F.sum(F.octet_length("text"))).first()[0] or 0
            return self.spark.range(1).select(F.lit(folders or max(FOLDERS, -(-size // FOLDER_BYTES))).alias("folders"))

        def postings(done: dict[str, DataFrame]) -> DataFrame:
            n = folders or done["settings"].first()["folders"]
            words = done["texts"].select("number", F.array_distinct(T.tokens(F.col("text"))).alias("tokens"))
            lists = words.mapInArrow(inverted, "token string, block long, places array<short>").withColumn("folder", _folder(F.col("token"), n))
            # A token that stands in every text is written by several tasks.
            dealt = lists.withColumn("_part", F.pmod(F.xxhash64("block"), F.lit(SPREAD))).repartition("folder", "_part").drop("_part").sortWithinPartitions("folder", "token", "block")
            return dealt.select("folder", "token", batch, "block", "places")

        def facts(done: dict[str, DataFrame]) -> DataFrame:
            rows = done["texts"].join(context.degrees(relations), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
            return rows.select("batch", "number", *FACTS).repartitionByRange("number").sortWithinPartitions("number")

        def near(done: dict[str, DataFrame]) -> DataFrame:
            none = self.spark.createDataFrame([], f"id {dict(entities.dtypes)['id']}, vector array<double>")
            own = none if vectors is None else vectors.select("id", F.col("vector").cast("array<double>").alias("vector"))
            return own.join(done["texts"].select("id", "batch", "number"), "id").select("batch", "number", "vector")

        return {"texts": texts, "settings": settings, "postings": postings, "facts": facts, "vectors": near}

    def build(self, entities: DataFrame, relations: DataFrame, vectors: DataFrame | None = None, folders: int | None = None) -> int:
        """The index of entities (see context.entities), with vectors (id, vector), in place of the one there was; returns its version."""
        return self.log.replace(self._tables(entities, relations, vectors, folders), by={"postings": "folder"})

    def add(self, entities: DataFrame, relations: DataFrame, vectors: DataFrame | None = None) -> int:
        """Entities whose ids the index lacks, beside those it has, whose degrees stay until it is built anew."""
        folders = self.log.read("settings").first()["folders"]
        fresh = entities.join(self.log.read("texts").select("id"), "id", "left_anti")
        tables = self._tables(fresh, relations, vectors, folders)
        del tables["settings"]
        return self.log.append(tables, by={"postings": "folder"})

    def _candidates(self, tokens: list[str], version: int, folders: int, include_deprecated: bool, query_vector: list[float] | None) -> DataFrame:
        """(batch, number, matched, embedding_score, facts) of entities with one of the tokens or a vector near the query's."""
        key, facts = ["batch", "number"], self.log.read("facts", version)
        own = self.log.read("postings", version).where(F.col("folder").isin([_folder(F.lit(t), folders) for t in tokens]) & F.col("token").isin(tokens)) if tokens else self.log.read("postings", version).where("false")
        out = own.select("batch", "block", F.explode("places").alias("place")).select("batch", (F.shiftleft("block", PLACE) + F.col("place")).alias("number")).groupBy(*key).agg(F.count(F.lit(1)).alias("matched"))
        if query_vector:
            asked = F.array(*[F.lit(float(x)) for x in query_vector])
            near = self.log.read("vectors", version).select(*key, scoring.clamp(V.cosine(asked, F.col("vector"))).alias("_e"))
            out = out.join(near, key, "full").select(*key, F.coalesce("matched", F.lit(0).cast("long")).alias("matched"), F.coalesce("_e", F.lit(0.0)).alias("embedding_score"))
        else:
            out = out.withColumn("embedding_score", F.lit(0.0))
            if (own.agg(F.sum(F.size("places"))).first()[0] or 0) <= NAMED:
                facts = facts.where(_named([r["number"] for r in out.select("number").collect()]))
        out = out.join(facts, key)
        return out if include_deprecated else out.where("live")

    def search(self, query: str, now: Column, top_k: int = 5, include_deprecated: bool = False, query_vector: list[float] | None = None, weights: dict[str, float] | None = None) -> DataFrame:
        """The top_k entities, with the columns, scores and order of context.search."""
        if not 1 <= top_k <= 20:
            raise ValueError("top_k is 1 to 20")
        version = self.log.version()
        folders = self.log.read("settings", version).first()["folders"]
        tokens = T.query_tokens(query)
        phrase = query.lower().strip() if tokens else ""
        found = self._candidates(tokens, version, folders, include_deprecated, query_vector)
        share = F.col("matched") / F.lit(float(max(1, len(tokens))))
        lexical = lambda bonus: F.when(share > 0, F.least(F.lit(1.0), share * 0.85 + bonus)).otherwise(0.0)
        passes = lambda low: (low >= fixed.LEXICAL_FLOOR) | (F.col("embedding_score") >= fixed.VECTOR_FLOOR)
        score = lambda low: F.round(scoring.search_score(scoring.semantic(low, F.col("embedding_score")), F.col("degree"), F.col("trust_level"), scoring.recency(F.col("updated_at"), now), F.col("source_of_truth"), weights), 4)
        without, with_it = lexical(F.lit(0.0)), lexical(F.lit(0.15 if phrase else 0.0))
        # A score is null where its entity lacks a fact; such entities come last and are never cut off.
        found = found.where(passes(with_it)).withColumn("_least", F.when(passes(without), F.least(score(without), score(with_it)))).withColumn("_most", F.greatest(score(without), score(with_it)))
        best = found.orderBy(F.desc_nulls_last("_least")).limit(top_k).select("_least").collect()
        least = best[-1]["_least"] if len(best) == top_k else None
        finalists = found if least is None else found.where((F.col("_most") >= least) | F.col("_most").isNull())
        texts = self.log.read("texts", version).select("batch", "number", "id", "text", *SHOWN)
        few = finalists.limit(NAMED + 1).collect()
        if len(few) <= NAMED:
            finalists = self.spark.createDataFrame(few, found.schema)
            texts = texts.where(_named([r["number"] for r in few]))
        rows = finalists.drop("_least", "_most").join(texts, ["batch", "number"])
        bonus = F.when(F.lower("text").contains(phrase), 0.15).otherwise(0.0) if phrase else F.lit(0.0)
        rows = rows.withColumn("lexical", lexical(bonus)).where(passes(F.col("lexical"))).withColumn("semantic", scoring.semantic(F.col("lexical"), F.col("embedding_score")))
        return rows.select(
            "id", "entity_type", "kind", F.col("label").alias("title"), "path", score(F.col("lexical")).alias("score"), F.round("semantic", 4).alias("semantic_score"), F.round("embedding_score", 4).alias("embedding_score"),
            F.round("lexical", 4).alias("lexical_score"), F.round(F.least(F.lit(1.0), F.col("degree") / 4), 4).alias("graph_score"), "source_of_truth", "status", "updated_at", "matched_rules", F.col("snippet").alias("excerpt"),
        ).orderBy(F.desc("score"), "id").limit(top_k)
