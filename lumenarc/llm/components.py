"""Connected components of links, by large-star and small-star steps on DataFrames.

Each step is one grouped minimum and one join; nodes with very many links are pre-aggregated before the shuffle, and
the large step, which starts from a stored table, meets them by broadcast. Steps are written to the shared folder, so no plan grows and lost executors cost one step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import staged, with_counts


def _least(directed: DataFrame) -> DataFrame:
    """directed (u, v): u with the least of itself and its neighbours v, and in c its number of rows."""
    return directed.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")).select("u", F.least("u", "m").alias("m"), "c")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return with_counts(both, _least(both), ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """edges with u > v: every smaller neighbour and u itself link to the least neighbour."""
    joined = edges.join(_least(edges), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Size and checksum, to see whether a step changed anything."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def labels(links: DataFrame) -> DataFrame:
    """links (u, v) of any ordered type: node and label, the least node of its component, of every node but the labels."""
    edges = staged(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        edges = staged(_small_star(_large_star(edges)), "links")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
