"""The registered queries of this package, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers as vocabularies
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, collocations, html_text, ngram_join, oracles, packing, personal, prefix_trie, quality, sharding, sstable, substring, suffix_dedup, vector_graph

MULTI_50K, BYTE_50K = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"
SHARDS = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op2_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept", "kept_text", "carried")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabularies.path(MULTI_50K), vocabularies.PATTERN)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabularies.path(BYTE_50K), ids=False).drop("ids")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = sstable.write(table(spark, sf_dir, "documents"), vocabularies.path(BYTE_50K))
    return sstable.read(shards, ids=False).drop("ids")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * SHARDS)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(table(spark, sf_dir, "documents"), texts=False).drop("kept")


def op10_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.link(table(spark, sf_dir, "embeddings"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(personal.find(table(spark, sf_dir, "documents")))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    rows, ids = prefix_trie.grafted(table(spark, sf_dir, "conversations"), conv - conv % 20, F.crc32(conv.cast("string").cast("binary")) % 4, 3)
    return prefix_trie.trie(rows, ids).drop("role", "text")


def queries() -> dict:
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_suffix_array": op2_suffix_array,
        "op3_html_text": op3_html_text,
        "op4_byte_bpe": op4_byte_bpe,
        "op5_packing": op5_packing,
        "op6_quality_rules": op6_quality_rules,
        "op7_sstable": op7_sstable,
        "op8_sharding": op8_sharding,
        "op9_substring": op9_substring,
        "op10_vector_graph": op10_vector_graph,
        "op11_personal_data": op11_personal_data,
        "op12_collocations": op12_collocations,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict:
    return oracles.oracle_sql()
