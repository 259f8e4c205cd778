"""A deterministic stand-in for a vision provider: analyses and unit vectors from hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIMENSION = 384
#: The words of a record.
EMOTIONS = ["confusion", "surprise", "joy", "anger", "sadness", "awkwardness"]
SUBJECTS = ["cartoon character", "person", "animal", "text overlay"]


def embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A unit vector from the extendable hash of a text; equal texts have equal vectors. Spark has no such hash."""

    @F.pandas_udf(ArrayType(FloatType()))
    def vector(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            raw = [np.frombuffer(hashlib.shake_256((t or "").encode()).digest(4 * dimension), ">u4") for t in s]
            spread = [r.astype(np.float64) / 0xFFFFFFFF * 2 - 1 for r in raw]
            yield pd.Series([(c / n if (n := np.linalg.norm(c)) else np.eye(1, dimension)[0]).astype(np.float32) for c in spread], dtype=object)

    return vector(text)


def picked(digest: Column, vocabulary: list[str], n: int = 3, skip: int = 0) -> Column:
    """The first n distinct words that the bytes of a hexadecimal digest name, from byte `skip` on."""
    names = F.array(*[F.lit(w) for w in vocabulary])
    bytes_ = F.transform(F.sequence(F.lit(skip), F.lit(31)), lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("int") % len(vocabulary))
    return F.transform(F.slice(F.array_distinct(bytes_), 1, n), lambda i: F.get(names, i))


def analyzed(content: str | Column, mime: str | Column, tags: list[str], emotions: list[str] = EMOTIONS, subjects: list[str] = SUBJECTS) -> Column:
    """The record of an image: words chosen by the hash of its type and content."""
    content, mime = (F.col(c) if isinstance(c, str) else c for c in (content, mime))
    digest = F.sha2(F.concat(F.encode(mime, "UTF-8"), content), 256)
    short, chosen = F.substring(digest, 1, 8), picked(digest, tags, 4)
    return F.struct(
        F.concat(F.lit("Mock image mime="), mime, F.lit(" size="), F.octet_length(content), F.lit(" analysis hash="), short).alias("description"), chosen.alias("tags"),
        picked(digest, emotions, 2, 4).alias("emotions"), picked(digest, subjects, 1, 8).alias("subjects"), F.lit("reaction meme").alias("meme_context"),
        F.array(F.concat(F.get(chosen, F.lit(0)), F.lit(" reaction")), F.concat(F.lit("mock meme "), short)).alias("suggested_search_phrases"),
    )
