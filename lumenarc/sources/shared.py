"""The folder that driver and executors share, for tables that outlive a query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where none is set, a local master gets a temporary one and a cluster an error."""
    path = spark.conf.get(SETTING, None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {SETTING} to a folder that all executors reach")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(SETTING, path)
    return path.rstrip("/")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: made once, whatever reads it, and the plan starts anew."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, where their files are fewer than these."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
