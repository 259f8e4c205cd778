"""The catalog of media: predicates, facets, order, pages and records."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.functions.text import EXTENSIONS, json_list
from lumenarc.sources.shared import kept

STATUSES = ("DOWNLOADED", "ANALYZING", "ANALYZED", "EMBEDDING", "READY", "FAILED")
DUP_STATUSES = ("nondup", "dup", "unflagged")
GROUPS = {"READY": "ready", "FAILED": "failed"}
#: Bits of monotonically_increasing_id() that number the rows of a partition.
PLACE_BITS = 33


@dataclass(frozen=True)
class Filters:
    """What a caller asks for; None asks for nothing. emotion is for search only."""

    type: str | None = None
    site: str | None = None
    format: str | None = None
    chapter: str | None = None
    date_from: date | None = None
    date_to: date | None = None
    processing_status: str | None = None
    dup_status: str | None = None
    is_favorite: bool | None = None
    emotion: str | None = None

    def __post_init__(self):
        for value, known in ((self.type, EXTENSIONS), (self.processing_status, STATUSES), (self.dup_status, DUP_STATUSES)):
            if value is not None and value not in known:
                raise ValueError(f"unknown value {value!r}")


def _column_predicates(f: Filters) -> dict[str, Column]:
    out: dict[str, Column] = {}
    if f.type is not None:
        out["type"] = F.col("extension").isin(*EXTENSIONS[f.type])
    if f.format is not None:
        out["format"] = F.lower("extension") == f.format.lstrip(".").lower()
    if f.date_from is not None:
        out["date_from"] = F.col("created_at") >= F.lit(f.date_from).cast("timestamp")
    if f.date_to is not None:
        out["date_to"] = F.col("created_at") < F.date_add(F.lit(f.date_to), 1).cast("timestamp")
    for name in ("processing_status", "dup_status", "is_favorite"):
        if getattr(f, name) is not None:
            out[name] = F.col(name) == getattr(f, name)
    return out


def filtered(media: DataFrame, f: Filters, sources: DataFrame | None = None, analysis: DataFrame | None = None) -> DataFrame:
    """Media that meet every predicate. Site and chapter may be met by different sources of a medium."""
    for p in _column_predicates(f).values():
        media = media.where(p)
    for name in ("site", "chapter"):
        if (value := getattr(f, name)) is not None:
            media = media.join(sources.where(F.col(name) == value).select(F.col("media_id").alias("id")), "id", "left_semi")
    if f.emotion is not None:
        fits = F.exists(json_list("emotions"), lambda x: F.lower(x) == f.emotion.lower())
        media = media.join(analysis.where(fits).select(F.col("media_id").alias("id")), "id", "left_semi")
    return media


def newest_first(media: DataFrame) -> DataFrame:
    return media.orderBy(F.col("created_at").desc(), F.col("id").desc())


def page(ordered: DataFrame, number: int = 1, size: int = 50) -> DataFrame:
    if number < 1 or not 1 <= size <= 200:
        raise ValueError("page from 1, size from 1 to 200")
    return ordered.offset((number - 1) * size).limit(size)


def facets(media: DataFrame, f: Filters, sources: DataFrame | None = None, analysis: DataFrame | None = None) -> DataFrame:
    """Counts of both facets, each without its own filter, in one pass over media: (facet, value, n), zeros included."""
    rest = filtered(media, replace(f, dup_status=None, processing_status=None), sources, analysis)
    own = lambda name: F.col(name) == getattr(f, name) if getattr(f, name) is not None else F.lit(True)
    group = F.when(F.col("processing_status") == "READY", "ready").when(F.col("processing_status") == "FAILED", "failed").otherwise("processing")
    parts = [("dup_status", v, own("processing_status") & (F.col("dup_status") == v)) for v in DUP_STATUSES]
    parts += [("processing", v, own("dup_status") & (group == v)) for v in ("ready", "processing", "failed")]
    one = rest.agg(*[F.count_if(p).alias(f"c{i}") for i, (_, _, p) in enumerate(parts)])
    rows = [F.struct(F.lit(facet).alias("facet"), F.lit(value).alias("value"), F.col(f"c{i}").alias("n")) for i, (facet, value, _) in enumerate(parts)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def first_sources(sources: DataFrame) -> DataFrame:
    return sources.groupBy("media_id").agg(F.min_by("site", "id").alias("site"))


def source_texts(sources: DataFrame) -> DataFrame:
    """Sites and chapters of each medium as one text, in the order of their ids."""
    text = F.concat(F.coalesce("site", F.lit("")), F.lit(" "), F.coalesce("chapter", F.lit("")))
    rows = F.array_sort(F.collect_list(F.struct("id", text.alias("t"))))
    return sources.groupBy("media_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), " ").alias("source_text"))


def shaped(media: DataFrame) -> DataFrame:
    """Records for readers: no file path, and an expiry only while flagged."""
    expiry = F.when(F.col("dup_status") == "dup", F.col("dup_flagged_at") + F.expr("INTERVAL 7 DAYS"))
    return media.drop("file_path").withColumn("dup_expires_at", expiry)


def details(media: DataFrame, sources: DataFrame, analysis: DataFrame) -> DataFrame:
    """A record with its sources by id and its analysis."""
    nested = sources.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("id", "site", "chapter"))).alias("sources"))
    return media.join(nested.withColumnRenamed("media_id", "id"), "id", "left").join(analysis.withColumnRenamed("media_id", "id"), "id", "left")


def hydrated(hits: DataFrame, media: DataFrame, analysis: DataFrame, sources: DataFrame) -> DataFrame:
    """Hits (id, score) of a page with their records, in the columns that readers may see; hits whose medium is gone are dropped.

    Each table is met by the page's ids alone, so hits are meant to be one page.
    """
    ids = F.broadcast(hits.select("id").distinct())
    own = shaped(media.join(ids, "id", "left_semi")).select("id", "extension", "created_at", "processing_status", "dup_status", "dup_expires_at", "is_favorite")
    said = analysis.join(ids.withColumnRenamed("id", "media_id"), "media_id", "left_semi").select(F.col("media_id").alias("id"), json_list("emotions").alias("emotions"))
    site = first_sources(sources.join(ids.withColumnRenamed("id", "media_id"), "media_id", "left_semi")).withColumnRenamed("media_id", "id")
    return F.broadcast(hits).join(own, "id").join(said, "id", "left").join(site, "id", "left")


def patched(media: DataFrame, changes: DataFrame, allowed: tuple[str, ...] = ("title", "user_description", "user_tags", "is_favorite")) -> DataFrame:
    """media with the columns of changes (id, ...) that are allowed and not null.

    Where changes has given, an array of the names that a change sets, those are set, to null as well, and no others.
    """
    names = [c for c in changes.columns if c in allowed and c in media.columns]
    given = [F.col("given").alias("new_given")] if "given" in changes.columns else []
    new = changes.select(F.col("id"), *given, *[F.col(c).alias(f"new_{c}") for c in names])
    out = media.join(new, "id", "left")
    value = lambda c: F.when(F.array_contains("new_given", c), F.col(f"new_{c}")).otherwise(F.col(c)) if given else F.coalesce(f"new_{c}", c)
    return out.select(*[value(c).alias(c) if c in names else F.col(c) for c in media.columns])


def random_pick(media: DataFrame, scope: str = "everything", seed: int | None = None) -> DataFrame:
    """One row by uniform chance."""
    scopes = {"everything": F.lit(True), "favorites": F.col("is_favorite"), "gifs": F.col("extension") == "gif"}
    return media.where(scopes[scope]).orderBy(F.rand(seed) if seed is not None else F.rand()).limit(1)


def with_ids(rows: DataFrame, high_water: int, order: list[str]) -> DataFrame:
    """New rows with ids after the highest ever given; ranges of rows are numbered in parallel.

    The bounds of the ranges come from a sample that each reading would draw anew, so the dealt rows are written once, and
    both their places and the sizes of the ranges are read from there.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # the number holds the range above and the place in it below
    dealt = kept(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered").withColumns({"_p": F.shiftright("_at", PLACE_BITS), "_k": F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1) + 1})
    sizes = dealt.groupBy("_p").agg(F.max("_k").alias("_n"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(_before("_p")), F.lit(0))).select("_p", "_base")
    return dealt.join(F.broadcast(base), "_p").withColumn("id", F.lit(high_water) + F.col("_base") + F.col("_k")).drop("_p", "_k", "_base", "_at")


def _before(part: str):
    from pyspark.sql import Window

    return Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row a partition


def file_name(media_id: Column, extension: Column) -> Column:
    text = media_id.cast("string")
    return F.concat(F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text), extension)
