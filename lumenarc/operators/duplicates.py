"""Exact duplicates by content hash: flags, copies, retention and purge, as window passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION = "INTERVAL 7 DAYS"


def content_hash(content: str | Column) -> Column:
    return F.sha2(content if isinstance(content, Column) else F.col(content), 256)


def flagged(media: DataFrame, now: Column) -> DataFrame:
    """Every group keeps its earliest member; the others are flagged, once.

    The earliest counts all members, also unflagged ones, which stay as they are. A null hash has no copies. The
    earliest is a grouped minimum, found before the shuffle as far as it goes, so a large group is never sorted.
    """
    first = media.where("sha256 is not null").groupBy("sha256").agg(F.min(F.struct("created_at", "id"))["id"].alias("_first"))
    out = media.join(first, "sha256", "left").select(*media.columns, "_first")
    kept, stays = F.coalesce(F.col("_first"), F.col("id")) == F.col("id"), F.col("dup_status") == "unflagged"
    was = F.col("dup_status") == "dup"
    return (
        out.withColumn("dup_flagged_at", F.when(stays, F.col("dup_flagged_at")).when(~kept, F.when(was, F.coalesce("dup_flagged_at", now)).otherwise(now)))
        .withColumn("dup_of_media_id", F.when(stays, F.col("dup_of_media_id")).when(~kept, F.col("_first")))
        .withColumn("dup_status", F.when(stays, F.col("dup_status")).otherwise(F.when(kept, "nondup").otherwise("dup")))
        .drop("_first")
    )


def copies(media: DataFrame, media_id: int) -> DataFrame:
    """The other members of a medium's group; is_retained marks the earliest."""
    own = media.where(F.col("id") == media_id).select("sha256")
    members = media.join(own, "sha256", "left_semi")
    first = members.agg(F.min(F.struct("created_at", "id"))["id"].alias("first"))
    return members.where(F.col("id") != media_id).crossJoin(F.broadcast(first)).select("id", "created_at", (F.col("id") == F.col("first")).alias("is_retained"))


def unflagged(media: DataFrame, ids: DataFrame) -> DataFrame:
    """Flags of ids taken back for good; only a flagged medium changes, and it keeps when and of what."""
    out = media.join(ids.select("id", F.lit(True).alias("_asked")), "id", "left")
    return out.withColumn("dup_status", F.when((F.col("dup_status") == "dup") & F.col("_asked"), "unflagged").otherwise(F.col("dup_status"))).drop("_asked")


def purgeable(media: DataFrame, now: Column) -> DataFrame:
    """Flagged media at or past retention, but never the last copy of a hash: of a group wholly expired the earliest stays."""
    expired = (F.col("dup_status") == "dup") & (F.col("dup_flagged_at") <= now - F.expr(RETENTION))
    marked = media.withColumn("_old", F.coalesce(expired, F.lit(False)))
    group = marked.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("_all"), F.count_if("_old").alias("_olds"), F.min(F.when(F.col("_old"), F.struct("created_at", "id"))).alias("_earliest")).where("_olds > 0")
    out = marked.where("_old").join(group, "sha256")
    return out.where((F.col("_all") > F.col("_olds")) | (F.col("id") != F.col("_earliest.id"))).drop("_old", "_all", "_olds", "_earliest")


def without(table: DataFrame, removed: DataFrame, key: str = "media_id") -> DataFrame:
    """A table, or a child table by its key, without removed media."""
    return table.join(removed.select(F.col("id").alias(key)), key, "left_anti")


def first_of(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in rows.columns if c not in (*key, *order)])).alias("r"))
    return best.select(*key, "r.*").select(*rows.columns)


def unseen(rows: DataFrame, seen: DataFrame, key: str, place: str = "position", force: bool = False) -> DataFrame:
    """Rows whose key was not seen before, each key once, at its first place; force keeps those seen, too."""
    fresh = rows if force else rows.join(seen.select(key).distinct(), key, "left_anti")
    return first_of(fresh.select(*rows.columns), [key], [place])
