"""Jobs, backfill items and watched series: lists, what to run next, progress and restarts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.functions.text import json_object

#: Fixed: the share of a crawl's progress that its pages make up; downloads make up the rest.
PAGES_SHARE = 0.6


def listed(jobs: DataFrame, status: str | None = None, limit: int = 50) -> DataFrame:
    """Jobs of a status (or all), newest first, 1 to 500 of them."""
    if not 1 <= limit <= 500:
        raise ValueError("limit from 1 to 500")
    return (jobs if status is None else jobs.where(F.col("status") == status)).orderBy(F.col("id").desc()).limit(limit)


def record(jobs: DataFrame) -> DataFrame:
    """Jobs for readers: params as a map (null if they are no object), progress as a number."""
    return jobs.withColumns({"params": json_object("params"), "progress": F.coalesce(F.col("progress").cast("double"), F.lit(0.0))})


def newest(jobs: DataFrame) -> DataFrame:
    """The newest job of each type with its status."""
    return jobs.groupBy("job_type").agg(F.max("id").alias("id"), F.max_by("status", "id").alias("status"))


def items_page(items: DataFrame, backfill_id: int, status: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of a run's items, oldest first."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit from 1 to 500, offset from 0")
    own = items.where(F.col("backfill_id") == backfill_id)
    return (own if status is None else own.where(F.col("status") == status)).orderBy("id").offset(offset).limit(limit)


def next_pending(items: DataFrame) -> DataFrame:
    """The oldest pending item of each run."""
    return items.where("status = 'pending'").groupBy("backfill_id").agg(F.min("id").alias("id"))


def without_thumbnail(media: DataFrame, limit: int | None = None) -> DataFrame:
    missing = media.where("thumbnail_path IS NULL")
    return missing if limit is None else missing.orderBy("id").limit(limit)


def due_series(watched: DataFrame, jobs: DataFrame, now: Column, interval: int = 3600) -> DataFrame:
    """Enabled series never scanned or not within the interval, by id; none while a crawl runs."""
    waited = F.col("last_scanned_at").isNull() | (F.unix_seconds(now) - F.unix_seconds("last_scanned_at") >= interval)
    live = jobs.agg(F.count_if((F.col("job_type") == "crawl") & (F.col("status") == "running")).alias("_live"))  # one row
    return watched.where(F.col("enabled") & waited).join(F.broadcast(live), F.col("_live") == 0).drop("_live").orderBy("id")


def resumable(jobs: DataFrame) -> DataFrame:
    """Crawls that a restart can start again, with url, scope, urls and force_rescan.

    Params must be an object with a url, and those that a backfill owns are its own to resume.
    """
    whole = F.try_parse_json("params").isNotNull() & F.startswith(F.trim("params"), F.lit("{"))
    spec = F.when(whole, F.from_json("params", "url string, owner string, scope string, urls array<string>, force_rescan boolean"))
    rows = jobs.where("job_type = 'crawl'").withColumn("_spec", spec)
    rows = rows.where((F.coalesce("_spec.url", F.lit("")) != "") & ~F.col("_spec.owner").eqNullSafe("backfill"))
    urls = F.filter(F.coalesce("_spec.urls", F.array().cast("array<string>")), lambda u: u != "")
    return rows.select("id", "_spec.url", F.coalesce("_spec.scope", F.lit("current_page")).alias("scope"), urls.alias("urls"), F.coalesce("_spec.force_rescan", F.lit(False)).alias("force_rescan"))


def crawl_progress(handled: str, pages: str, settled: str | None = None, media: str | None = None) -> Column:
    """Overall progress of a crawl: pages first, then downloads; nothing to do counts as done."""
    part = lambda done, total: F.when(F.col(total) > 0, F.col(done) / F.col(total)).otherwise(1.0)
    if settled is None or media is None:
        return PAGES_SHARE * part(handled, pages)
    return F.lit(PAGES_SHARE) + (1 - PAGES_SHARE) * part(settled, media)


def within_cap(refs: DataFrame, job: str, place: str, limit: int) -> DataFrame:
    """The first `limit` media of each crawl, by place; negative limits are none."""
    nth = F.row_number().over(Window.partitionBy(job).orderBy(place))
    return refs.withColumn("_nth", nth).where(F.col("_nth") <= max(0, limit)).drop("_nth")


def outcome_counts(results: DataFrame, run: str, place: str) -> DataFrame:
    """Per run of the queue: ready, failed and deferred, and the last error as media_id=...: error; ties by that text."""
    outcome = F.col("outcome")
    said = F.concat(F.lit("media_id="), F.col("media_id").cast("string"), F.lit(": "), F.coalesce("error", F.lit("")))
    counts = [F.count_if(outcome == o).alias(o) for o in ("ready", "failed", "deferred")]
    return results.groupBy(run).agg(*counts, F.max(F.when(outcome != "ready", F.struct(F.col(place), said.alias("said"))))["said"].alias("last_error"))


def reopened(items: DataFrame, now: Column) -> DataFrame:
    """Failed items that were deferred once are due for revival at once, as they failed for a passing cause."""
    old = (F.col("processing_status") == "FAILED") & F.col("next_retry_at").isNotNull()
    new = {"failed_at": now, "error_retryable": F.lit(True), "next_retry_at": now}
    return items.withColumns({c: F.when(old, v).otherwise(F.col(c)) for c, v in new.items()})


def site_choices(sources: DataFrame, supported: list[str], chosen: str | None = None) -> DataFrame:
    """Sites seen, supported and chosen, each once, in order."""
    names = sources.sparkSession.createDataFrame([(s,) for s in [*supported, chosen] if s], "site string")
    return sources.select("site").where("site <> ''").distinct().unionByName(names).distinct().orderBy("site")
