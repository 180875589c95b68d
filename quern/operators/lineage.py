"""Where a plan's lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, for checkpoints.

    Where none is set, as in tests, one process may use a folder of its own; a
    cluster's executors could not read each other's, so there it is an error.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(top or "file://" + tempfile.mkdtemp(prefix="quern-checkpoint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, computed once, by a reliable checkpoint in the shared folder.

    What several later steps read is computed once, and survives a lost
    executor.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the same folder, read again: for loops, whose plans would else carry what was inferred about every round before."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
