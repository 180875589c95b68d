"""From documents to training sequences, in four stages.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents.

- quality_rules drops what the base rules or the trees fitted on `labels` reject.
- ngram_jaccard keeps one document of each group linked by word 5-grams: the one
  with the least doc_id. Rows without a doc_id stay; rows repeated with one
  doc_id stay or go together.
- suffix_array removes each 50-byte string that also starts in a document with a
  smaller doc_id. A document of which nothing is left keeps an empty text, and
  n_chars is that of the text left.
- packing cuts what is left into sequences of 2048 ids: a row per piece, with its
  ids.
"""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import ngram_join, packing, quality, suffix_dedup
from quern.llm.common import written
from quern.llm.queries import BYTE_50K, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.passed(docs, quality.train(docs, table(spark, sf_dir, "labels")))


#: How values that JSON has no form for are written, so that they are read back as they were.
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}


def _named(name: str):
    """The column of that name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = ngram_join.join(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct().alias("kept_ids")
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept_ids._id")), "left_semi")


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    carried = docs.select(*[_named(c).alias(f"c{k}") for k, c in enumerate(others)]).schema
    left = suffix_dedup.dedup(docs, texts="text", carry=F.to_json(F.struct(*[_named(c).alias(f"c{k}") for k, c in enumerate(others)]), EXACT) if others else None)
    kept = left.withColumn("_more", F.from_json("carried", carried, EXACT)) if others else left
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    made |= {c: F.col("_more")[f"c{k}"] for k, c in enumerate(others)}
    return kept.select(*[made[c].alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabularies.path(BYTE_50K))


STAGES = [("quality_rules", quality_rules), ("ngram_jaccard", ngram_jaccard), ("suffix_array", suffix_array), ("packing", pack)]

#: The trees' verdict, the library's ids and the windows of the packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
