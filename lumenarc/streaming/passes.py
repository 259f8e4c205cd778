"""Passes over a queue and over watched series: work that can stop anywhere and go on without loss or repetition.

Every step writes a folder of its own under its number and replaces what an interrupted run of it wrote, so running a
step again gives the same tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.operators import workqueue
from lumenarc.operators.workqueue import Policy
from lumenarc.streaming import control

Process = Callable[[DataFrame], DataFrame]


def drained(items: DataFrame, process: Process, folder: str, now: Column, policy: Policy | None = None) -> bool:
    """Works off all claimable items of a stream: process maps items to results (id, outcome, retryable, error).

    A micro-batch is a claim: its items are settled and written with the run's counts. After a crash the batch that was
    under way is done again from its offsets, others are not.
    """

    def work(batch: DataFrame, k: int) -> None:
        claimed = workqueue.claimable(batch, now)
        results = process(claimed)
        path = f"{folder}/results/batch={k}"
        results.write.mode("overwrite").parquet(path)  # process runs once, whatever reads its results
        results = batch.sparkSession.read.schema(results.schema).parquet(path)
        settled = workqueue.settled(batch, results, now, policy)
        settled.write.mode("overwrite").parquet(f"{folder}/items/batch={k}")
        done = batch.sparkSession.read.schema(settled.schema).parquet(f"{folder}/items/batch={k}").join(results.select("id", "error"), "id")
        status = F.col("processing_status")
        said = F.max(F.when(status != "READY", F.struct("id", F.concat(F.lit("media_id="), F.col("id").cast("string"), F.lit(": "), F.coalesce("error", F.lit(""))).alias("said"))))["said"]
        counts = done.agg(F.count("*").alias("total"), F.count_if(status == "READY").alias("ready"), F.count_if(status == "FAILED").alias("failed"), F.count_if(~status.isin("READY", "FAILED")).alias("deferred"), said.alias("last_error"))
        counts.write.mode("overwrite").parquet(f"{folder}/runs/batch={k}")

    with control.single(items.sparkSession, folder) as asked:
        query = items.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(control.stopping(work, asked)).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if not asked():
                raise
            return False
    return True


def drain_summary(spark: SparkSession, folder: str) -> DataFrame:
    """One row for a whole drain: total, ready, failed, deferred and the last error."""
    runs = spark.read.parquet(f"{folder}/runs")
    return runs.agg(*[F.sum(c).alias(c) for c in ("total", "ready", "failed", "deferred")], F.max(F.when(F.col("last_error").isNotNull(), F.struct("batch", "last_error")))["last_error"].alias("last_error"))


@dataclass
class Pass:
    """What a watch pass did: why it was skipped or abandoned, if so, and how many parts of the series it scanned."""

    skipped: str | None = None
    abandoned: str | None = None
    parts: int = 0


def foreign_crawls(jobs: DataFrame) -> str | None:
    """Running crawls that no watch pass owns, as a text, or None. jobs: id, job_type, status, params (JSON)."""
    own = F.coalesce(F.get_json_object("params", "$.owner") == "watch", F.lit(False))
    first = jobs.where((F.col("job_type") == "crawl") & (F.col("status") == "running") & ~own).agg(F.count("*").alias("n"), F.min("id").alias("id")).first()
    return f"{first['n']} crawls live, first job_id={first['id']}" if first["n"] else None


def watch_pass(watched: DataFrame, jobs: Callable[[], DataFrame], scan: Process, folder: str, supported: Column, size: int = 100) -> Pass:
    """Scans every enabled series of watched (id, url, enabled) once, in order of id, about size of them at a time.

    The pass is skipped while a crawl runs that it doesn't own, and ends before the next part when one appears. Parts that
    an earlier, interrupted run of the folder finished are not scanned again. Unsupported series, and what scan reports as
    error, are failures of their own. Results are in the folder: scans (scan's columns) and failures (id, error).
    """
    if reason := foreign_crawls(jobs()):
        return Pass(skipped=reason)
    spark, enabled = watched.sparkSession, watched.where("enabled")
    n, last = enabled.agg(F.count("*"), F.max("id")).first()
    if not n:
        return Pass()
    parts = max(1, math.ceil(n / size))
    inner = enabled.approxQuantile("id", [k / parts for k in range(1, parts)], 0.0) if parts > 1 else []
    bounds = sorted({*map(int, inner), last})
    for k, upper in enumerate(bounds):
        if reason := foreign_crawls(jobs()):
            return Pass(abandoned=reason, parts=k)
        done = f"{folder}/done/part={k}"
        try:
            spark.read.schema("upper long").parquet(done).first()
            continue
        except AnalysisException:
            pass
        own = enabled.where((F.col("id") <= upper) & (F.col("id") > bounds[k - 1] if k else F.lit(True)))
        scan(own.where(supported)).write.mode("overwrite").parquet(f"{folder}/scans/part={k}")
        failed = spark.read.parquet(f"{folder}/scans/part={k}").where("error IS NOT NULL").select("id", "error")
        failed.unionByName(own.where(~supported).select("id", F.concat(F.lit("unsupported site: "), "url").alias("error"))).write.mode("overwrite").parquet(f"{folder}/failures/part={k}")
        spark.createDataFrame([(upper,)], "upper long").write.mode("overwrite").parquet(done)
    return Pass(parts=len(bounds))
