"""Ingest of downloads: new media with their sources, and duplicate flags of those groups alone that new rows touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lumenarc.functions import text as T
from lumenarc.operators import catalog, duplicates

#: Columns of media that ingest fills; other tables hold what is found out later.
MEDIA = "id, original_filename, mime_type, extension, file_size, sha256, file_path, dup_status, dup_flagged_at, dup_of_media_id, processing_status, is_favorite, created_at".split(", ")
SOURCE = "media_id, site, page_url, chapter, page_number, comment_id, author_name, media_url, collected_at".split(", ")


def ingested(downloads: DataFrame, high_water: int, now: Column) -> tuple[DataFrame, DataFrame]:
    """New rows of media and of sources, one of each for every download that succeeded, with ids after high_water.

    downloads: url, ok, content_type, size, sha256, original_filename, page_url, chapter, page_number, comment_id,
    author_name. A copy of known content is a medium, too; delta_flags() flags it. The site is the page's host, or else the
    address's own. Failed downloads give no rows.
    """
    good = catalog.with_ids(downloads.where("ok AND sha256 IS NOT NULL"), high_water, ["url", "sha256"])
    dotted = T.extension_for("content_type", "url")
    kept = T.normalize_content_type("content_type")
    full = good.withColumns({
        "extension": F.ltrim(dotted, F.lit(".")), "mime_type": F.coalesce(kept, F.when(dotted == ".bin", "application/octet-stream").otherwise(T.mime_of(F.lit(None).cast("string"), dotted))), "file_size": F.col("size").cast("long"),
        "file_path": catalog.file_name(F.col("id"), dotted), "dup_status": F.lit("nondup"), "dup_flagged_at": F.lit(None).cast("timestamp"), "dup_of_media_id": F.lit(None).cast("long"), "processing_status": F.lit("DOWNLOADED"), "is_favorite": F.lit(False),
        "created_at": now, "media_id": F.col("id"), "site": T.host(F.coalesce(F.nullif("page_url", F.lit("")), "url")), "media_url": F.col("url"), "collected_at": now,
    })
    return full.select(*MEDIA), full.select(*SOURCE)


def delta_flags(media: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Rows of media that new rows change, and the new rows, all with their flags; only groups of new hashes are read.

    After any order of batches the table is what flagging it as a whole would make of it.
    """
    touched = new.select("sha256").where("sha256 IS NOT NULL").distinct()
    flags = F.struct("dup_status", "dup_flagged_at", "dup_of_media_id")
    old = media.join(touched, "sha256", "left_semi").select(*media.columns, flags.alias("_was"), F.lit(False).alias("_new"))
    both = old.unionByName(new.select(*media.columns, flags.alias("_was"), F.lit(True).alias("_new")))
    return duplicates.flagged(both, now).where(F.col("_new") | ~flags.eqNullSafe(F.col("_was"))).select(*media.columns)


def merged(media: DataFrame, changes: DataFrame) -> DataFrame:
    """media with changes in place of the rows of the same ids."""
    return media.join(changes.select("id"), "id", "left_anti").select(*media.columns).unionByName(changes.select(*media.columns))


def dup_pass(media: DataFrame, now: Column) -> tuple[DataFrame, Observation]:
    """One pass of the duplicate job: media with fresh flags and `purged`, whether retention removes the row.

    The observation has the job's counts (scanned, flagged, purged) once the rows were read; no second job counts them. They
    are for a progress line: where an executor is lost, rows may be counted twice.
    """
    flagged = duplicates.flagged(media, now)
    gone = duplicates.purgeable(flagged, now).select("id", F.lit(True).alias("purged"))
    out = flagged.join(gone, "id", "left").withColumn("purged", F.coalesce("purged", F.lit(False)))
    counts = Observation()
    return out.observe(counts, F.count_if(F.col("dup_status") != "unflagged").alias("scanned"), F.count_if(F.col("dup_status") == "dup").alias("flagged"), F.count_if("purged").alias("purged")), counts
