"""The retrying work queue as set-wise transitions of an item table.

Items: id, processing_status, attempts, next_retry_at, failed_at, error_retryable, revives, has_analysis. Each function
returns the whole table after one kind of event, so a transition is one map over the items and one join with results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions.text import retry_delay

CLAIMABLE = ("DOWNLOADED", "ANALYZING", "ANALYZED", "EMBEDDING")


@dataclass(frozen=True)
class Policy:
    max_attempts: int = 6
    retry_base: float = 15.0
    retry_cap: float = 600.0
    revive_after: int = 1800
    max_revives: int = 3


def _later(now: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_seconds(now) + seconds.cast("long"))


def claimable(items: DataFrame, now: Column) -> DataFrame:
    return items.where(F.col("processing_status").isin(*CLAIMABLE) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now)))


def claim(items: DataFrame, now: Column, n: int) -> DataFrame:
    """The next batch, lowest ids first."""
    return claimable(items, now).orderBy("id").limit(n)


def _resumed() -> Column:
    return F.when(F.col("has_analysis"), "ANALYZED").otherwise("DOWNLOADED")


def settled(items: DataFrame, results: DataFrame, now: Column, policy: Policy | None = None) -> DataFrame:
    """Items after results (id, outcome, retryable): 'ready', or 'error' which defers, fails for now, or fails for good."""
    p = policy or Policy()
    out = items.join(results.select("id", F.col("outcome").alias("_outcome"), F.coalesce("retryable", F.lit(False)).alias("_retryable")), "id", "left")
    ready, error = F.col("_outcome") == "ready", F.col("_outcome") == "error"
    deferred = error & F.col("_retryable") & (F.col("attempts") + 1 < p.max_attempts)
    failed = error & ~deferred
    revive = failed & F.col("_retryable") & (F.col("revives") < p.max_revives)
    return out.select(
        "id",
        F.when(ready, "READY").when(deferred, _resumed()).when(failed, "FAILED").otherwise(F.col("processing_status")).alias("processing_status"),
        F.when(deferred, F.col("attempts") + 1).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.when(deferred, _later(now, retry_delay("attempts", p.retry_base, p.retry_cap))).when(revive, _later(now, F.lit(max(0, p.revive_after)))).when(failed, F.lit(None)).otherwise(F.col("next_retry_at")).alias("next_retry_at"),
        F.when(failed, now).otherwise(F.col("failed_at")).alias("failed_at"),
        F.when(failed, F.col("_retryable")).otherwise(F.col("error_retryable")).alias("error_retryable"),
        "revives", "has_analysis",
    )


def revivable(now: Column, policy: Policy | None = None) -> Column:
    p = policy or Policy()
    return (F.col("processing_status") == "FAILED") & F.col("error_retryable") & (F.col("next_retry_at") <= now) & (F.col("revives") < p.max_revives)


def revived(items: DataFrame, now: Column, policy: Policy | None = None) -> DataFrame:
    """Items after due failures got a new budget; each revival counts."""
    due = F.coalesce(revivable(now, policy), F.lit(False))
    nothing = F.lit(None).cast("timestamp")
    return items.select(
        "id", F.when(due, _resumed()).otherwise(F.col("processing_status")).alias("processing_status"), F.when(due, 0).otherwise(F.col("attempts")).cast("int").alias("attempts"),
        F.when(due, nothing).otherwise(F.col("next_retry_at")).alias("next_retry_at"), F.when(due, nothing).otherwise(F.col("failed_at")).alias("failed_at"),
        F.when(due, False).otherwise(F.col("error_retryable")).alias("error_retryable"), (F.col("revives") + due.cast("int")).alias("revives"), "has_analysis",
    )


def reset(items: DataFrame, media_id: int) -> DataFrame:
    """One item by hand: a clean slate."""
    own, nothing = F.col("id") == media_id, F.lit(None).cast("timestamp")
    new = {"processing_status": _resumed(), "attempts": F.lit(0), "next_retry_at": nothing, "failed_at": nothing, "error_retryable": F.lit(False), "revives": F.lit(0)}
    return items.select(*[F.when(own, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns])


def summary(items: DataFrame, now: Column) -> DataFrame:
    """Counts for a status page and the next retry in the future."""
    status = F.col("processing_status")
    waiting = F.col("next_retry_at") > now
    return items.agg(F.count_if(status == "READY").alias("ready"), F.count_if(status == "FAILED").alias("failed"), F.count_if(status.isin(*CLAIMABLE) & waiting).alias("deferred"), F.count_if(status.isin(*CLAIMABLE) & F.coalesce(~waiting, F.lit(True))).alias("claimable"), F.min(F.when(waiting, F.col("next_retry_at"))).alias("next_retry_at"))


def recovered(jobs: DataFrame, now: Column, reason: str = "interrupted by restart") -> DataFrame:
    """Jobs left running by a dead process, failed; an error already noted stays."""
    lost = F.col("status") == "running"
    new = {"status": F.lit("failed"), "completed_at": now, "error": F.coalesce("error", F.lit(reason))}
    return jobs.select(*[F.when(lost, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def stale(jobs: DataFrame, now: Column, grace: int = 5) -> DataFrame:
    """Running jobs whose start lies more than `grace` seconds back or is unknown."""
    return jobs.where((F.col("status") == "running") & (F.col("started_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("started_at") > grace)))


def requeued(items: DataFrame, statuses: tuple[str, ...] = ("failed",)) -> DataFrame:
    """Backfill items of these statuses pending again, their errors gone."""
    again = F.col("status").isin(*statuses)
    return items.withColumns({"error": F.when(~again, F.col("error")), "status": F.when(again, "pending").otherwise(F.col("status"))})


def item_counts(items: DataFrame) -> DataFrame:
    """Per run: items in all, done, failed, pending and running."""
    return items.groupBy("backfill_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("done", "failed", "pending", "running")])


def rotation_target(targets: DataFrame, runs: DataFrame) -> DataFrame:
    """The target (position, url) that ran least recently; one that never ran comes first, ties by position."""
    newest = runs.groupBy(F.col("site_url").alias("url")).agg(F.max("id").alias("newest"))
    return targets.join(newest, "url", "left").orderBy(F.coalesce("newest", F.lit(0)), "position").select("url").limit(1)
