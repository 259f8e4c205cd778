"""Versioned tables: files keep the schema that they were written with, and a chain of upgrades reads them as the newest.

A table is a folder with one folder for each version of its schema. Upgrading writes nothing; new rows go to the newest
version's folder, and a reader fills what older files lack.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenarc.sources import tables

#: Newest schema of each table, and what each version after the first added: column and default (SQL).
CHAINS: dict[str, tuple[str, list[dict[str, str]]]] = {
    "media": (tables.MEDIA, [{"title": "NULL"}, {"attempts": "0", "next_retry_at": "NULL"}, {"failed_at": "NULL", "error_retryable": "false", "revives": "0"}]),
    "source": (tables.SOURCE, []), "analysis": (tables.ANALYSIS, []), "embeddings": (tables.EMBEDDINGS, []), "jobs": (tables.JOBS, []), "history": (tables.HISTORY, []),
    "watched": (tables.WATCHED, []), "backfill_jobs": (tables.BACKFILL_JOBS, []), "backfill_items": (tables.BACKFILL_ITEMS, []),
}


def newest(table: str) -> int:
    return len(CHAINS[table][1]) + 1


def schema(table: str, version: int | None = None) -> StructType:
    """Columns of a version of a table, the newest by default."""
    ddl, steps = CHAINS[table]
    if version is not None and not 1 <= version <= newest(table):
        raise ValueError(f"{table} has versions 1 to {newest(table)}, not {version}")
    later = {c for step in steps[(version or newest(table)) - 1 :] for c in step}
    return StructType([f for f in StructType.fromDDL(ddl) if f.name not in later])


def upgraded(rows: DataFrame, table: str, version: int) -> DataFrame:
    """Rows of a version with the columns of the newest; columns that the version should have but lacks are null."""
    out = rows
    for step in CHAINS[table][1][version - 1 :]:
        out = out.withColumns({c: F.expr(default) for c, default in step.items()})
    return out.select(*[(F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(table)])


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """All rows of a table, whatever version they were written with."""
    out = spark.createDataFrame([], schema(table))
    for version in range(1, newest(table) + 1):
        try:
            rows = spark.read.schema(schema(table, version)).parquet(f"{folder}/version={version}")
        except AnalysisException:  # no such files
            continue
        out = out.unionByName(upgraded(rows, table, version))
    return out


def append(rows: DataFrame, folder: str, table: str, version: int | None = None) -> None:
    """Adds rows in the columns of a version, the newest by default; other columns of rows are not kept."""
    version = version or newest(table)
    rows.select(*[F.col(f.name).cast(f.dataType) for f in schema(table, version)]).write.mode("append").parquet(f"{folder}/version={version}")
