"""Arithmetic of array columns, in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda m, x: m + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if the lengths differ, either is empty, or either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda m, x: m + x)


def jaccard(a: Column, b: Column) -> Column:
    """Of lower-cased distinct strings; 0 if both are empty."""
    a, b = (F.array_distinct(F.transform(x, F.lower)) for x in (a, b))
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def unpacked(blob: Column) -> Column:
    """The numbers of a column of packed float32 vectors, a batch at a time."""

    @F.pandas_udf("array<float>")
    def run(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return run(blob)


def pack(vector: list[float]) -> bytes:
    return np.asarray(vector, "<f4").tobytes()


def unpack(blob: bytes) -> list[float]:
    return np.frombuffer(blob, "<f4").tolist()
