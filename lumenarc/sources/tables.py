"""Schemas of the archive's tables, JSON feeds and raw bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEDIA = (
    "id long, title string, file_path string, thumbnail_path string, preview_path string, original_filename string, mime_type string, extension string, file_size long, width int, height int, duration double, sha256 string, "
    "dup_status string, dup_flagged_at timestamp, dup_of_media_id long, processing_status string, is_favorite boolean, user_description string, user_tags array<string>, created_at timestamp, attempts int, next_retry_at timestamp, failed_at timestamp, error_retryable boolean, revives int"
)
SOURCE = "id long, media_id long, site string, page_url string, chapter string, page_number int, comment_id string, media_url string, author_name string, collected_at timestamp"
ANALYSIS = "media_id long, description string, tags array<string>, emotions array<string>, subjects array<string>, meme_context string, suggested_search_phrases array<string>, ai_provider string, model string, processed_at timestamp"
EMBEDDINGS = "media_id long, embedding array<float>, embedding_model string, created_at timestamp"
JOBS = "id long, job_type string, status string, progress double, message string, error string, params string, created_at timestamp, started_at timestamp, completed_at timestamp"
HISTORY = "id long, url string, site string, pages_scanned long, media_found long, last_scanned_at timestamp"
WATCHED = "id long, url string, site string, title string, enabled boolean, last_scanned_at timestamp, created_at timestamp"
BACKFILL_JOBS = "id long, site_url string, adapter_site string, status string, total int, done int, failed int, current_url string, current_title string, message string, error string, started_at timestamp, completed_at timestamp"
BACKFILL_ITEMS = "id long, backfill_id long, url string, title string, status string, error string, finished_at timestamp"


def media_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Files as rows with their content hash."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"), "content")


def feed_items(replies: DataFrame, schema: str, items: str = "data") -> DataFrame:
    """Items of JSON replies (page, body), in order; a reply that is no such JSON gives none."""
    parsed = F.from_json("body", f"struct<{items}: array<struct<{schema}>>>")
    return replies.select("page", F.posexplode(parsed[items]).alias("position", "item")).select("page", "position", "item.*")
