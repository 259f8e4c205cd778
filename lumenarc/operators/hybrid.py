"""Fusion of keyword, tag, metadata and vector scores into one ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.operators import keyword, vectors

CANDIDATES = 1000


@dataclass(frozen=True)
class Weights:
    keyword: float = 0.25
    semantic: float = 0.50
    tag: float = 0.20
    metadata: float = 0.05

    def __post_init__(self):
        values = (self.keyword, self.semantic, self.tag, self.metadata)
        if any(not 0 <= v <= 1 for v in values) or abs(sum(values) - 1) > 1e-6:
            raise ValueError("weights lie from 0 to 1 and sum to 1")

    def without_semantic(self) -> dict[str, float]:
        rest = self.keyword + self.tag + self.metadata
        if rest <= 0:
            return dict.fromkeys(("keyword", "tag", "metadata"), 1 / 3)
        return {"keyword": self.keyword / rest, "tag": self.tag / rest, "metadata": self.metadata / rest}


def normalized(scores: DataFrame) -> DataFrame:
    """Scores over their largest, after the cut to candidates; all 1 if none is above 0."""
    top = scores.agg(F.max("score").alias("top"))
    return scores.crossJoin(F.broadcast(top)).select("id", F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(1.0).alias("score"))


def _spared(ranked: DataFrame, query: str, rows: DataFrame, tag_text: Column) -> DataFrame:
    """Where ranked (id, score) is empty, rows whose tags hold every term."""
    none = ranked.agg((F.count("*") == 0).alias("none"))
    return keyword.containing(rows, query, tag_text).crossJoin(F.broadcast(none)).where("none").select("id", "score")


def tag_scores(index: DataFrame | keyword.Index, query: str, rows: DataFrame | None = None, tag_text: Column | None = None, limit: int | None = CANDIDATES) -> DataFrame:
    """Scores by tags; where the index has no hit at all, rows whose tags hold every term."""
    ranked = normalized(keyword.bm25(index, query, ("tags",), limit))
    return ranked if rows is None else ranked.unionByName(_spared(ranked, query, rows, tag_text))


def text_scores(index: DataFrame | keyword.Index, query: str, limit: int = CANDIDATES, tag_rows: DataFrame | None = None, tag_text: Column | None = None) -> DataFrame:
    """(name, id, score) by all columns, by tags and by metadata, each over its best; the index is read once."""
    hits = keyword.best(index, query, {"keyword": None, "tag": ("tags",), "metadata": ("filename", "source_text")}, limit)
    share = F.when(F.col("top") > 0, F.col("score") / F.col("top")).otherwise(1.0)
    out = hits.select("name", "id", share.alias("score"))
    if tag_rows is None:
        return out
    spare = _spared(out.where("name = 'tag'"), query, tag_rows, tag_text)
    return out.unionByName(spare.select(F.lit("tag").alias("name"), "id", "score"))


def fused(scores: DataFrame, weights: dict[str, float], allowed: DataFrame | None = None) -> DataFrame:
    """scores (name, id, score) and the weight of each name; ids with their weighted sum above 0, best first, ties by id."""
    merged = scores.groupBy("id").agg(*[F.coalesce(F.max(F.when(F.col("name") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in weights])
    if allowed is not None:
        merged = merged.join(allowed.select("id"), "id", "left_semi")
    score = F.lit(0.0)
    for name, weight in weights.items():
        score = score + F.col(name) * weight
    return merged.withColumn("score", score).where("score > 0").orderBy(F.col("score").desc(), "id")


def search(
    index: DataFrame | keyword.Index | None, query: str, vectors_table: DataFrame | None = None, query_vector: list[float] | None = None, allowed: DataFrame | None = None,
    media: DataFrame | None = None, weights: Weights | None = None, limit: int = CANDIDATES, model: str | int | None = None, tag_rows: DataFrame | None = None, tag_text: Column | None = None,
) -> tuple[str, DataFrame]:
    """Mode and hits. A blank query lists media, newest first, without scores or an index; without vectors the other weights share all."""
    weights = weights or Weights()
    if not query.strip():
        listed = media if allowed is None else media.join(allowed.select("id"), "id", "left_semi")
        return "filters_only", listed.orderBy(F.col("created_at").desc(), F.col("id").desc()).select("id", F.lit(None).cast("double").alias("score"))
    texts = text_scores(index, query, limit, tag_rows, tag_text)
    if vectors_table is not None and query_vector:
        near = vectors.cosine_top(vectors_table, query_vector, limit, model).select(F.lit("semantic").alias("name"), "id", vectors.likeness(F.col("cosine")).alias("score"))
        shares = {"keyword": weights.keyword, "semantic": weights.semantic, "tag": weights.tag, "metadata": weights.metadata}
        return "hybrid", fused(texts.unionByName(near), shares, allowed)
    return "keyword_only", fused(texts, weights.without_semantic(), allowed)


def result_page(hits: DataFrame, page: int, size: int, order: list[Column]) -> DataFrame:
    """A page of hits with total, the number of all hits; one job, in which both share what the hits are shuffled for.

    An observed count would be wrong where a sort reads the hits twice or a lost executor's tasks run again.
    """
    if page < 1 or not 1 <= size <= 500:
        raise ValueError("pages from 1, sizes from 1 to 500")
    total = hits.agg(F.count("*").alias("total"))  # one row
    return hits.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))


def neighbours(ranked: DataFrame, order: list[Column]) -> DataFrame:
    """Each hit of a result page with the ids before and after it."""
    from pyspark.sql import Window

    w = Window.orderBy(*order)
    return ranked.withColumn("previous_id", F.lag("id").over(w)).withColumn("next_id", F.lead("id").over(w))
