"""A corpus pipeline: quality rules, near-duplicates, secrets, the source mix and packing, one operator each.

All stages but the last return the columns of their input, extra ones of any type and name included, and read texts
whole, however long. An empty table passes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenarc.llm import forest, mixing, packing, quality, secrets
from lumenarc.llm.common import passing


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail.

    Null and empty texts have no words and go; of equal lines the first stays; repeated rows pass or go alike.
    """
    return quality.cleaned(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of smallest id.

    Repeated rows are one group; of rows alike in id and text the one of least digest stays. Rows without an id, and texts
    without words (null ones too), belong to no group and stay.
    """
    return forest.one_of_each(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked.

    Null texts stay null and empty ones empty; every row stays, repeated ones too; of overlapping spans all is masked.
    """
    return secrets.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks.

    A null source is one source, the last; null and empty texts have size 0 and are taken with their hash, as any row.
    Repeated rows share their hash, so they are taken alike; ties at a threshold go in together.
    """
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences.

    Null and empty texts are one token; long texts are cut; repeated rows have pieces of their own; pieces of one length
    stand in the order of id and content. Only the columns of a piece are returned.
    """
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mix", source_mix), ("best_fit_packing", best_fit_packing)]
#: SQL expresses neither the field's decoding nor the tokenizer; tests hold run() against its stages and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    drop_before = None
    for name, stage in STAGES[:-1]:
        docs, drop = passing(stage(spark, docs, sf_dir), name)
        if drop_before:  # its successor is written, and nothing reads it any more
            drop_before()
        drop_before = drop
    return STAGES[-1][1](spark, docs, sf_dir)
