"""Upserts by key as snapshots: each returns the new table; write it beside the old one and switch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scanned(history: DataFrame, scans: DataFrame) -> DataFrame:
    """Crawl history (url, site, pages_scanned, media_found, last_scanned_at) plus scans (url, site, media_found, at)."""
    new = scans.select("url", "site", F.lit(1).cast("long").alias("pages_scanned"), F.col("media_found").cast("long").alias("media_found"), F.col("at").alias("last_scanned_at"), F.lit(1).alias("fresh"))
    both = history.select("url", "site", F.col("pages_scanned").cast("long"), F.col("media_found").cast("long"), "last_scanned_at", F.lit(0).alias("fresh")).unionByName(new)
    return both.groupBy("url").agg(F.max_by("site", F.struct("fresh", "last_scanned_at", "site")).alias("site"), F.sum("pages_scanned").alias("pages_scanned"), F.sum("media_found").alias("media_found"), F.max("last_scanned_at").alias("last_scanned_at"))


def watched(table: DataFrame, scans: DataFrame) -> DataFrame:
    """Watch list (url, site, title, enabled, last_scanned_at) after scans; what the user set stays."""
    new = scans.groupBy("url").agg(F.max_by("site", "at").alias("_site"), F.max("at").alias("_at"))
    return table.join(new, "url", "full").select("url", F.coalesce("_site", "site").alias("site"), "title", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("_at", "last_scanned_at").alias("last_scanned_at"))


def inserted_if_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table and those rows whose key it lacks, one row a key."""
    fresh = rows.select(*table.columns).dropDuplicates(key).join(table.select(*key), key, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def latest(rows: DataFrame, key: list[str], version: str | Column) -> DataFrame:
    """The row of highest version of each key, by a grouped maximum rather than a sort."""
    rest = [c for c in rows.columns if c not in key]
    v = F.col(version) if isinstance(version, str) else version
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), v).alias("r")).select(*key, "r.*").select(*rows.columns)


def to_scan(pages: DataFrame, history: DataFrame, cap: int | None = None, force: bool = False) -> DataFrame:
    """pages (position, url): each once at its first place, at most `cap` of them, then without those scanned before."""
    first = pages.groupBy("url").agg(F.min("position").alias("position"))
    if cap is not None:
        first = first.orderBy("position").limit(cap)
    return first if force else first.join(history.select("url"), "url", "left_anti")


def with_provenance(media: DataFrame, pages: DataFrame) -> DataFrame:
    """Media references with page address, chapter and number of their page where their own are empty."""
    p = pages.select(F.col("url").alias("_url"), F.col("chapter").alias("_chapter"), F.col("page_number").alias("_number"))
    out = media.join(p, media["page"] == p["_url"], "left")
    return out.withColumns({"page_url": F.coalesce(F.nullif(F.col("page_url"), F.lit("")), "_url"), "chapter": F.coalesce(F.nullif(F.col("chapter"), F.lit("")), "_chapter"), "page_number": F.coalesce("page_number", "_number")}).drop("_url", "_chapter", "_number")
