"""Model calls over batches of records. The model is a function the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.agglomerate import numbered

#: Records that one call takes, by task.
SIZES = {"normalise": 40, "tag": 25, "detect": 50, "suggest": 8}


def assembled(df: DataFrame, size: int, order: tuple[str, ...] = ("id",), by: str | None = None) -> DataFrame:
    """df with batch (from 0 in each `by`) and place: `size` rows to a batch by order, however df is dealt.

    Rows are numbered in two steps (see agglomerate.numbered), so no task sees
    them all, and a run that is repeated makes the same batches.
    """
    whole = df.withColumn("_one", F.lit("")) if by is None else df
    out = numbered(whole, by or "_one", list(order), "_k")
    return out.withColumn("batch", F.floor(F.col("_k") / size).cast("long")).withColumn("place", (F.col("_k") % size).cast("int")).drop("_k", "_one")


def asked(placed: DataFrame, call: Callable[[list[str]], str], column: str = "text") -> DataFrame:
    """(batch, reply, status) for the batches of placed (batch, place, column): one call a batch, `failed` and no reply if it raises."""

    def run(t: pa.Table) -> pa.Table:
        try:
            reply, status = call(t.sort_by("place")[column].to_pylist()), "ok"
        except Exception:
            reply, status = None, "failed"
        return pa.table({"batch": pa.array([t["batch"][0].as_py()], pa.int64()), "reply": pa.array([reply], pa.string()), "status": pa.array([status])})

    return placed.select("batch", "place", column).groupBy("batch").applyInArrow(run, "batch long, reply string, status string")


def mapped(df: DataFrame, call: Callable[[list[str]], list[str]], size: int, column: str = "text") -> DataFrame:
    """df (id, column) with reply and status: 'ok', or 'failed' for all records of a batch whose call raised.

    Batches are `size` records by id. A failed one keeps its text as the reply
    and fails alone.
    """
    kinds = dict(df.dtypes)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        texts = part[column].tolist()
        try:
            reply = call(texts)
            if len(reply) != len(texts):
                raise ValueError("as many replies as records are needed")
            status = "ok"
        except Exception:
            reply, status = texts, "failed"
        return pd.DataFrame({"id": part["id"], column: part[column], "reply": reply, "status": status})

    return assembled(df.select("id", column), size).groupBy("batch").applyInPandas(run, f"id {kinds['id']}, `{column}` string, reply string, status string")


def embedded(df: DataFrame, embed: Callable[[list[str]], list[list[float]]], known: DataFrame, size: int = 64, dimensions: int | None = None, normal: bool = False) -> DataFrame:
    """(id, vector) for df (id, text): what known (id, vector) has, the rest from embed, one vector a text.

    With `dimensions`, a known vector of another length is made anew, and a new
    one of another length is an error; with `normal`, new ones get unit length.
    """
    kind = dict(df.dtypes)["id"]
    if dimensions is not None:
        known = known.where(F.size("vector") == dimensions)

    def made(texts: list[str]) -> list[list[float]]:
        x = np.array(embed(texts), float).reshape(len(texts), -1)
        if dimensions is not None and x.shape[1] != dimensions:
            raise ValueError(f"vectors of {x.shape[1]} numbers, not {dimensions}")
        length = np.sqrt((x * x).sum(1, keepdims=True))
        return list(np.divide(x, length, out=np.zeros_like(x), where=length > 0) if normal else x)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for lo in range(0, len(f), size):
                part = f.iloc[lo : lo + size]
                yield pd.DataFrame({"id": part["id"], "vector": made(part["text"].tolist())})

    fresh = df.join(known, "id", "left_anti").select("id", "text").mapInPandas(run, f"id {kind}, vector array<double>")
    return df.select("id").join(known.select("id", "vector"), "id").unionByName(fresh)
