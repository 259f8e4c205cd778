"""Shared folder, staged tables and text columns for the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lumenarc.sources.shared import shared_dir

#: A word is a run of characters other than space and the ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


#: Spark's setting that drops a query's shuffle files once it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and outlives lost executors.

    Nothing needs the shuffle files of the write any more once the table is there, so they go when it ends.
    """
    return passing(df, tag)[0]


def passing(df: DataFrame, tag: str) -> tuple[DataFrame, Callable[[], None]]:
    """A staged table and a function that empties it, for a table that only other staged tables are made from."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    empty = spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(path), lambda: empty.write.mode("overwrite").parquet(path)


def with_counts(rows: DataFrame, counts: DataFrame, on: list[str]) -> DataFrame:
    """rows, a stored table, joined with counts, which holds a row for a key and in c the number of rows it has in rows.

    Keys of more than a quarter of a task's share of the rows meet their counts by broadcast, so no task gets a whole hot
    key; there are fewer than four such keys for each task. The other keys are shuffled.
    """
    share = rows.count() // (4 * partitions(rows.sparkSession)) + 1
    hot = F.broadcast(counts.where(F.col("c") > share))
    cold = rows.join(hot.select(*on), on, "left_anti").join(counts.where(F.col("c") <= share), on)
    return rows.join(hot, on).unionByName(cold)


def whole_row(docs: DataFrame) -> Column:
    """All columns of docs, of any type and name, as one struct."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])


def map_batches(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """run over the batches of docs, in and out by place, so that columns may have any name."""
    places = [f"c{i}" for i in range(len(docs.columns))]
    schema = StructType([StructField(c, f.dataType, f.nullable) for c, f in zip(places, docs.schema, strict=True)])
    return docs.toDF(*places).mapInArrow(run, schema).toDF(*docs.columns)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def utf8(col: Column) -> Column:
    return F.encode(col, "UTF-8")
