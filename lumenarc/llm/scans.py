"""Running totals and digests over sorted rows, where one group may hold a large share of all rows.

Rows are dealt by ranges of their whole sort key, so a large group lies in many neighbouring tasks. Each task works on
its own rows, and one small row for each task carries the group that it shares with the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from lumenarc.llm.common import partitions, staged

#: Values in one piece of a joined list.
PIECE = 4096


def _within(batches: Iterator[pa.RecordBatch], group: str, values: list[str]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with the running sums of values by group, and at, the row's number in this task."""
    last, base, seen = None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        g = b.column(group).to_numpy(zero_copy_only=False)
        total = np.cumsum([b.column(v).to_numpy(zero_copy_only=False) for v in values], axis=1, dtype=np.int64)
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(starts, len(g)))
        total -= np.repeat(np.where(starts > 0, total[:, starts - 1], 0), sizes, axis=1)
        if last is not None and g[0] == last:
            total[:, : sizes[0]] += base
        last, base = g[-1], total[:, -1:].copy()
        at = np.arange(seen, seen + len(g))
        seen += len(g)
        yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, total), pa.array(at)], [*b.schema.names, *[f"{v}_run" for v in values], "at"])


def running(rows: DataFrame, group: str, order: list[str], values: list[str], tag: str) -> DataFrame:
    """rows with <value>_run, the sum of a long value over its group's rows up to this one.

    group is a long that is never null; group and order say where a row stands, ascending, nulls first. No sum may pass
    a long. The sums within tasks are stored, then a row for each task brings what the tasks before it summed.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(partitions(spark), group, *order).sortWithinPartitions(group, *order).withColumn("part", F.spark_partition_id())
    schema = StructType([*rows.schema, StructField("part", IntegerType()), *[StructField(f"{v}_run", LongType()) for v in values], StructField("at", LongType())])
    local = staged(placed.mapInArrow(lambda bs: _within(bs, group, values), schema), tag)
    runs = [f"{v}_run" for v in values]
    ends = local.groupBy("part").agg(F.min(group).alias("first"), F.max(group).alias("last"), *[F.max_by(r, "at").alias(r) for r in runs]).orderBy("part").collect()
    carries, before, owner = [], [0] * len(values), None  # a row for each task, no more
    for e in ends:
        if e["first"] == owner:
            carries.append((e["part"], owner, *before))
        inner = e["first"] == e["last"] == owner
        before = [e[r] + (b if inner else 0) for r, b in zip(runs, before, strict=True)]
        owner = e["last"]
    carried = spark.createDataFrame(carries, f"part int, {group} long, {', '.join(f'{v}_carry long' for v in values)}")
    met = local.join(F.broadcast(carried), ["part", group], "left")
    return met.select(*rows.columns, *[(F.col(f"{v}_run") + F.coalesce(f"{v}_carry", F.lit(0))).alias(f"{v}_run") for v in values])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted k, v: the values of a key joined by commas, up to PIECE of a batch in one row."""
    for b in batches:
        k, v = b.column("k").to_pylist(), b.column("v").to_pylist()
        edges, i = [], 0
        for j in range(1, len(k) + 1):
            if j == len(k) or k[j] != k[i] or j - i == PIECE:
                edges.append((i, j))
                i = j
        yield pa.RecordBatch.from_arrays(
            [b.column("k").take(pa.array([i for i, _ in edges], pa.int64())), b.column("v").take(pa.array([i for i, _ in edges], pa.int64())), pa.array([",".join(map(str, v[i:j])) for i, j in edges], pa.string()), pa.array([j - i for i, j in edges], pa.int64())],
            ["k", "v", "joined", "n"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces: a digest and a count for each key, in constant memory."""
    key = digest = None
    n = 0
    for b in batches:
        done = []
        for k, joined, m in zip(b.column("k").to_pylist(), b.column("joined").to_pylist(), b.column("n").to_pylist(), strict=True):
            if digest is None or k != key:
                if digest is not None:
                    done.append((key, digest.hexdigest(), n))
                key, digest, n = k, hashlib.sha256(joined.encode()), m
            else:
                digest.update(b"," + joined.encode())
                n += m
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (b.schema.field("k").type, pa.string(), pa.int64()), strict=True)], ["k", "sha256", "n"])
        kind = b.schema.field("k").type
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([digest.hexdigest()]), pa.array([n])], ["k", "sha256", "n"])


def joined_sha256(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, sha256 and n: the digest of a key's values, ascending and joined by commas, and their number.

    Pairs are distinct and not null. Values are joined in pieces where their range lies; one task reads the pieces of a
    key one after the other, as the digest has to, and never holds more than one batch of them.
    """
    n = partitions(rows.sparkSession)
    pairs = rows.select(F.col(key).alias("k"), F.col(value).alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    pieces = pairs.repartitionByRange(n, "k", "v").sortWithinPartitions("k", "v").mapInArrow(_pieces, f"k {kinds['k']}, v {kinds['v']}, joined string, n bigint")
    return pieces.repartition(n, "k").sortWithinPartitions("k", "v").mapInArrow(_digests, f"k {kinds['k']}, sha256 string, n bigint").withColumnRenamed("k", key)
