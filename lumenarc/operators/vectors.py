"""Exact nearest vectors by cosine."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType


@F.pandas_udf(ArrayType(FloatType()))
def decoded(blobs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Little-endian 32-bit floats; null where the length is no positive multiple of four."""
    for s in blobs:
        yield s.map(lambda b: np.frombuffer(b, "<f4") if b and len(b) % 4 == 0 else None)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_top(vectors: DataFrame, query: list[float], k: int | None = 1000, model: str | int | None = None) -> DataFrame:
    """(id, cosine) of the k nearest of vectors (id, embedding, model) of the query's length, ties by id.

    An empty or zero query finds nothing; a zero vector has cosine 0.
    """
    length = math.sqrt(sum(x * x for x in query))
    if not query or not length:
        return vectors.select("id", F.lit(0.0).alias("cosine")).limit(0)
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    rows = vectors.where(F.size("embedding") == len(query))
    if model is not None:
        rows = rows.where(F.col("model") == model)
    out = rows.select("id", F.coalesce(F.try_divide(dot(F.col("embedding"), unit), norm(F.col("embedding"))), F.lit(0.0)).alias("cosine"))
    return out if k is None else out.orderBy(F.col("cosine").desc(), "id").limit(k)


def likeness(cosine: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (1 + cosine) / 2))
