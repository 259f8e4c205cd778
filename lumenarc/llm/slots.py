"""Sharding by fixed virtual slots (native).

Records are hashed into thousands of slots, bytes are summed by slot, and a small versioned table maps slots to
shards. Rebalancing edits that table: version 0 deals slots round, each later version keeps what fits a shard's
fair share and moves only the overflow slots. Every version is a folder of its own, so a later run reads the map back,
puts the new loads in and writes the next one. Nothing here collects more than one row per slot.

Nulls: a null text has no bytes and checksum 0, a null key hashes as the word 'null'. Empty tables give an empty
result. Repeated rows hash alike, so they share a slot, where they stand in any order; rows with equal texts but other
keys spread over all slots. Long texts count whole. Extra columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import shared_dir, staged, text_or_empty, utf8

N_SLOTS = 4096
N_SHARDS = 40
#: Share of a fair load that a shard keeps in its present slots before its smaller slots may move.
KEEP = 0.9
ROW_BYTES = 16


def slotted(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and vslot of each row; md5 of key and checksum, so other engines can repeat it."""
    text = utf8(text_or_empty())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text_or_empty()) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string"))
    return rows.withColumn("vslot", F.pmod(F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long"), F.lit(n_slots)).cast("int"))


def slot_bytes(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows"))


def first_map(loads: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Version 0: slots dealt round."""
    return loads.select("vslot", "bytes", "n_rows", F.pmod("vslot", F.lit(n_shards)).cast("int").alias("shard"), F.lit(0).alias("version"))


def rebalanced(slot_map: DataFrame, n_shards: int = N_SHARDS, keep: float = KEEP) -> DataFrame:
    """The next version of a slot map: overflow slots move, largest first, each to the shard with least bytes.

    A shard keeps its slots, largest first, while they fit keep times the mean load. The moves are one fold over
    the overflow slots (at most one entry per slot) within a single row.
    """
    spark = slot_map.sparkSession
    by_size = Window.partitionBy("shard").orderBy(F.col("bytes").desc(), "vslot")
    fair = slot_map.agg((F.sum("bytes") * F.lit(keep) / F.lit(n_shards)).alias("fair"))
    ranked = slot_map.withColumn("filled", F.sum("bytes").over(by_size.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(fair))
    kept, moving = ranked.where("filled <= fair"), ranked.where("filled > fair")
    loads = (
        spark.range(n_shards).select(F.col("id").cast("int").alias("shard"))
        .join(kept.groupBy("shard").agg(F.sum("bytes").alias("bytes")), "shard", "left")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("shard", F.coalesce("bytes", F.lit(0)).alias("bytes")))), lambda x: x["bytes"]).alias("loads"))
    )
    pool = moving.agg(F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("pool"))
    fold = """aggregate(pool, named_struct('loads', loads, 'owners', cast(array() as array<int>)), (a, x) -> named_struct(
        'loads', transform(a.loads, (v, i) -> if(i + 1 = array_position(a.loads, array_min(a.loads)), v - x.minus, v)),
        'owners', array_append(a.owners, cast(array_position(a.loads, array_min(a.loads)) - 1 as int))), a -> a.owners)"""
    moved = loads.crossJoin(pool).select("pool", F.expr(fold).alias("owners")).select(F.explode(F.arrays_zip("pool", "owners")).alias("m"))
    moved = moved.select(F.col("m.pool.vslot").alias("vslot"), F.col("m.owners").alias("shard"))
    version = F.col("version") + 1
    return kept.select("vslot", "bytes", "n_rows", "shard", version.alias("version")).unionByName(
        moving.drop("shard").join(moved, "vslot").select("vslot", "bytes", "n_rows", "shard", version.alias("version"))
    )


def write_map(slot_map: DataFrame, folder: str, version: int) -> DataFrame:
    """Stores a version of the map and then names it; a version that is there already is never overwritten."""
    spark, path = slot_map.sparkSession, f"{folder}/version-{version:06d}"
    slot_map.select("vslot", "bytes", "n_rows", "shard", F.lit(version).alias("version")).coalesce(1).write.parquet(path)
    spark.range(1).select(F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return spark.read.parquet(path)


def latest(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/versions").agg(F.max("version")).first()[0]


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    version = latest(spark, folder) if version is None else version
    return spark.read.parquet(f"{folder}/version-{version:06d}")


def reweighed(slot_map: DataFrame, loads: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """The map with new loads (vslot, bytes, n_rows): slots stay where they are, new ones are dealt round, missing ones weigh nothing."""
    old = slot_map.select("vslot", "shard", "version")
    version = slot_map.agg(F.max("version").alias("v"))
    both = old.join(loads.select("vslot", "bytes", "n_rows"), "vslot", "full").crossJoin(F.broadcast(version))  # version is one row
    return both.select(
        "vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.coalesce("shard", F.pmod("vslot", F.lit(n_shards)).cast("int")).alias("shard"), F.coalesce("version", "v").alias("version"),
    )


def rebalance(spark: SparkSession, folder: str, loads: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """Reads the latest map, puts the loads in, moves overflow slots and stores the result as the next version."""
    last = latest(spark, folder)
    before = read_map(spark, folder, last)
    return write_map(rebalanced(reweighed(before, loads, n_shards), n_shards), folder, last + 1)


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """Every row with its shard and its gapless place there; law `bytes`: shard sizes are near equal.

    A row's place is its slot's first place in the shard plus its rank in the slot, so no task sorts a whole shard. The
    map's versions 0 (dealt round) and 1 (rebalanced) are stored in the folder, a new one by default.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = staged(slotted(docs, n_slots), "slots")
    loads = slot_bytes(rows)
    write_map(first_map(loads, n_shards), folder, 0)
    slot_map = rebalance(spark, folder, read_map(spark, folder, 0), n_shards)
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    firsts = slot_map.select("vslot", "shard", F.coalesce(F.sum("n_rows").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.join(firsts, "vslot")
        .withColumn("slot", (F.col("base") + rank).cast("long"))
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    )
