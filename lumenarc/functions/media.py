"""Media bytes: their type by magic numbers, their kind, and why they are refused, as expressions in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenarc.functions.analysis import media_problem
from lumenarc.functions.text import mime_of

#: First bytes (hexadecimal) of the formats that are accepted.
MAGIC = {"image/jpeg": ("FFD8FF",), "image/png": ("89504E470D0A1A0A",), "image/gif": ("474946383761", "474946383961"), "video/webm": ("1A45DFA3",)}
RIFF, WEBP, FTYP = "52494646", "57454250", "66747970"
VIDEO_EXTENSIONS = ("mp4", "webm", "mov", "mkv", "avi")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sniffed(content: str | Column) -> Column:
    """The media type that the first twelve bytes tell; null for any other, shorter or null content."""
    head = F.hex(F.substring(_c(content), 1, 12))
    out = F.when((F.length(head) == 24) & (F.substring(head, 9, 8) == FTYP), "video/mp4")
    out = out.when(head.startswith(RIFF) & (F.substring(head, 17, 8) == WEBP), "image/webp")
    for kind, starts in MAGIC.items():
        for start in starts:
            out = out.when(head.startswith(start), kind)
    return out


def is_gif(mime: str | Column, extension: str | Column) -> Column:
    said, by_name = F.nullif(F.lower(_c(mime)), F.lit("")), F.lower(F.ltrim(_c(extension), F.lit(".")))
    return F.coalesce(said == "image/gif", by_name == "gif", F.lit(False))


def is_video(mime: str | Column, extension: str | Column) -> Column:
    """A type that says video, or else a file name that does."""
    by_name = F.lower(F.ltrim(_c(extension), F.lit("."))).isin(*VIDEO_EXTENSIONS)
    return F.coalesce(F.lower(_c(mime)).startswith("video/"), F.lit(False)) | F.coalesce(by_name, F.lit(False))


def kind(mime: str | Column) -> Column:
    m = _c(mime)
    return F.when(m == "image/gif", "gif").when(m.startswith("video/"), "video").when(m.isNotNull(), "image")


def verdicts(rows: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """rows with size, sha256, found, kind and problem of their bytes, all from one reading of them; the bytes are dropped."""
    found = sniffed(content)
    problem = media_problem(declared, found)
    return rows.select(*[c for c in rows.columns if c != content], F.octet_length(content).alias("size"), F.sha2(content, 256).alias("sha256"), found.alias("found"), F.when(problem.isNull(), kind(found)).alias("kind"), problem.alias("problem"))


def media_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path with path, declared (by name; unknown names declare nothing), size, sha256, found, kind and problem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = F.when(name.isin("jpg", "jpeg", "png", "gif", "webp", "mp4", "webm"), mime_of(F.lit(None).cast("string"), name))
    return verdicts(files.select("path", known.alias("declared"), "content"))
