"""Writers: append, tables with a log of commits, indexes with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.log import TableLog


def append(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = df.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def _text(spark: SparkSession, path: str, text: str) -> str:
    """Write a small file that says what was done; a later run writes it again."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(place, True)
    try:
        stream.write(text.encode())
    finally:
        stream.close()
    return text


def replace(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables below folder with these rows alone, all in one commit (see log.TableLog). A run that fails before it leaves what was there."""
    TableLog(next(iter(tables.values())).sparkSession, folder).replace(tables)


def current(spark: SparkSession, folder: str, table: str) -> DataFrame | None:
    """A table as the last commit left it; None if there is none."""
    return TableLog(spark, folder).read(table)


def added(new: dict[str, DataFrame], folder: str) -> None:
    """Rows of new beside what the tables hold: all of them in one commit, or none. Only the new rows are written."""
    TableLog(next(iter(new.values())).sparkSession, folder).append(new)


def loaded_graph(vertices: dict[str, DataFrame], edges: dict[str, DataFrame], folder: str, now: str) -> dict:
    """Replace the graph's tables below folder; returns, and writes as manifest.json, when it was made and the rows of each table."""
    spark = next(iter(vertices.values())).sparkSession
    replace({**vertices, **edges}, folder)
    out = {"generated_at": now, "counts": {k: current(spark, folder, k).count() for k in [*vertices, *edges]}}
    _text(spark, f"{folder}/manifest.json", json.dumps(out, indent=2))
    return out


def embedding_index(df: DataFrame, path: str, model: str, now: str, digits: int = 6, failures: int = 50) -> dict:
    """Write (id, signature, vector) as JSON in the order of ids, rounded, and a manifest of counts beside it, which is returned.

    df also has status: embedded, reused or failed, and error. Failed records are
    not written; the manifest names the first `failures` of them.
    """
    out = df.where("status <> 'failed'").withColumn("vector", F.transform("vector", lambda x: F.round(x, digits))).withColumn("model", F.lit(model)).withColumn("dimensions", F.size("vector"))
    out.drop("status", "error").orderBy("id").write.mode("overwrite").json(path)
    c = df.agg(F.count(F.lit(1)).alias("entities"), *[F.count_if(F.col("status") == k).alias(k) for k in ("embedded", "reused", "failed")], F.max(F.size("vector")).alias("dimensions")).first()
    named = df.where("status = 'failed'").orderBy("id").limit(failures).select(F.concat_ws(": ", "id", F.coalesce("error", F.lit("embedding generation failed"))).alias("x")).collect()
    counts = {"entities": c["entities"], "output": c["entities"] - c["failed"], "embedded": c["embedded"], "reused": c["reused"], "failed": c["failed"]}
    manifest = {"generated_at": now, "model": model, "dimensions": c["dimensions"] or 0, "counts": counts, "failures": [r["x"] for r in named]}
    _text(df.sparkSession, f"{path}.manifest.json", json.dumps(manifest, indent=2))
    return manifest


def result_json(df: DataFrame, path: str) -> None:
    """Rows of an evaluation as JSON lines."""
    df.write.mode("overwrite").json(path)


def sealed(column: str, key: bytes):
    """A column of AES-GCM text, as base64."""
    return F.base64(F.aes_encrypt(F.col(column), F.lit(key), F.lit("GCM")))


def unsealed(column: str, key: bytes):
    """The text that was sealed; what cannot be opened, as text stored before there was a key, stays as it is."""
    opened = F.try_aes_decrypt(F.try_to_binary(F.col(column), F.lit("base64")), F.lit(key), F.lit("GCM"))
    return F.coalesce(opened.cast("string"), F.col(column))
