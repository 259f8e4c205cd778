"""Vector code compression: integer codebooks by part, nearest entries found through a VA-file.

A vector's components become integers and are cut into parts; each part is replaced by the index of the nearest entry
of its codebook. The entries' coordinates are quantised to a few bits, their cells. For a query part, one table per
coordinate holds the least and the greatest squared distance to each cell; sums over coordinates bound the distance to
every entry from below and above. Only entries whose lower bound is not above the least upper bound are compared by
their integers, so the answer is exact.

The integers are stored once; each round reads them and sends one row of sums per part and entry and task. The
driver holds the codebooks only: N_ENTRIES times the width, whatever the number of vectors.

Nulls: a vector that is null or holds a null or non-finite component is dropped; a null vec_id is coded, but starts no
entry; null labels are one label. Shorter vectors, empty ones included, count as padded with zeros to the longest kept
one, rounded up to whole parts. Integers beyond limit(width) count as that limit, so that sums of squares fit in a
long. Repeated rows and equal ids are each coded; the first entries take them by id, then by vector. Fewer rows than
entries make fewer entries. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lumenarc.llm.common import staged, with_counts

SCALE = 256
N_PARTS = 16
N_ENTRIES = 64
ROUNDS = 2
#: Bits of a cell's number; there are as many entries in each cell of a coordinate, give or take one.
BITS = 4
#: Query parts compared at a time.
BLOCK = 2048


def limit(width: int) -> int:
    """The greatest integer whose squared differences, summed over width components, fit in a long."""
    return 2 ** ((62 - int(np.ceil(np.log2(max(width, 1))))) // 2 - 1)


class Cells:
    """The VA-file of one part: entries (n, d), the cell of each coordinate of each entry, and every cell's bounds."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        n, self.d = entries.shape
        cells = min(1 << bits, n)
        rank = np.argsort(np.argsort(entries, axis=0, kind="stable"), axis=0, kind="stable")
        self.entries, self.cell = entries, (rank * cells // n).T
        self.low = np.array([[entries[c == j, k].min() for j in range(cells)] for k, c in enumerate(self.cell)])
        self.high = np.array([[entries[c == j, k].max() for j in range(cells)] for k, c in enumerate(self.cell)])

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest squared distance of every part from every entry's cells, (n, m) each."""
        lower = np.zeros((len(self.entries), len(parts)), np.int64)
        upper = np.zeros_like(lower)
        for k in range(self.d):
            below, above = self.low[k][:, None] - parts[:, k], parts[:, k] - self.high[k][:, None]
            gap, far = np.maximum(np.maximum(below, above), 0), np.maximum(-below, -above)
            lower += (gap * gap)[self.cell[k]]
            upper += (far * far)[self.cell[k]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (the lower one of a tie) and its squared distance, for each of parts (m, d)."""
        index, least = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        for i in range(0, len(parts), BLOCK):
            x = parts[i : i + BLOCK]
            lower, upper = self.bounds(x)
            row, entry = np.nonzero((lower <= upper.min(axis=0)).T)  # by row, then by entry
            apart = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
            first = np.searchsorted(row, np.arange(len(x)))
            best = np.minimum.reduceat(apart, first)
            hit = np.flatnonzero(apart == best[row])
            at = np.unique(row[hit], return_index=True)[1]
            index[i : i + BLOCK], least[i : i + BLOCK] = entry[hit[at]], best
        return index, least


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, v: those rows whose components are all finite, as q of integers, floored."""
    for b in batches:
        v = b.column("v")
        sizes = pc.fill_null(pc.list_value_length(v), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        owner = np.repeat(np.arange(len(v)), sizes)
        keep = v.is_valid().to_numpy(zero_copy_only=False).copy()
        keep[owner[~np.isfinite(x)]] = False
        with np.errstate(over="ignore"):
            whole = np.clip(np.floor(x[keep[owner]] * SCALE), -limit(1), limit(1)).astype(np.int64)
        q = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes[keep])]), whole).cast(pa.list_(pa.int64()))
        rest = b.select(["vec_id", "label"]).filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*rest.columns, q], ["vec_id", "label", "q"])


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label and q, the integer components, of every row that is kept; stored."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    kind = rows.schema["label"].dataType.simpleString()
    return staged(rows.mapInArrow(_integers, f"vec_id long, label {kind}, q array<bigint>"), "integers")


def _matrix(col: pa.ListArray, width: int) -> np.ndarray:
    sizes = pc.list_value_length(col).to_numpy(zero_copy_only=False)
    x = np.clip(col.flatten().to_numpy(zero_copy_only=False), -limit(width), limit(width))
    if (sizes == width).all():
        return x.reshape(-1, width)
    out = np.zeros((len(col), width), np.int64)
    row = np.repeat(np.arange(len(col)), sizes)
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x
    return out


def first_books(rows: DataFrame, n_parts: int = N_PARTS, n_entries: int = N_ENTRIES) -> np.ndarray | None:
    """The parts of the rows of least vec_id as (part, entry, component), or None without rows."""
    longest = rows.agg(F.max(F.size("q"))).first()[0]
    if longest is None:
        return None
    width = max(-(-longest // n_parts), 1) * n_parts
    seeds = [r.q for r in rows.where("vec_id IS NOT NULL").orderBy("vec_id", "q").limit(n_entries).select("q").collect()]
    seeds = seeds or [r.q for r in rows.orderBy("q").limit(n_entries).select("q").collect()]
    table = _matrix(pa.array(seeds, pa.list_(pa.int64())), width)
    return table.reshape(len(table), n_parts, -1).transpose(1, 0, 2).copy()


def _assigned(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Each batch with its parts (row, part, component), indexes and squared distances (row, part)."""
    files = [Cells(b) for b in books]
    for b in batches:
        if b.num_rows:
            parts = _matrix(b.column("q"), books.shape[0] * books.shape[2]).reshape(b.num_rows, books.shape[0], -1)
            found = [f.nearest(parts[:, p]) for p, f in enumerate(files)]
            yield b, parts, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def refined(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry that is used becomes the floored mean of its parts."""
    n_parts, n_entries, d = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(n_parts * n_entries, np.int64), np.zeros((n_parts * n_entries, d), np.int64)
        for _, parts, index, _ in _assigned(batches, books):
            at = (index + np.arange(n_parts) * n_entries).ravel()
            n += np.bincount(at, minlength=len(n))
            np.add.at(total, at, parts.reshape(-1, d))
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["at", "n", "total"])

    by_entry = rows.mapInArrow(sums, "at bigint, n bigint, total array<bigint>").groupBy("at")
    out = books.reshape(-1, d).copy()
    for r in by_entry.agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[k].cast("decimal(38,0)")).alias(f"t{k}") for k in range(d)]).collect():
        out[r["at"]] = [int(r[f"t{k}"]) // r["n"] for k in range(d)]
    return out.reshape(books.shape)


def fitted(rows: DataFrame, n_parts: int = N_PARTS, n_entries: int = N_ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks (part, entry, component) after the given rounds over all of rows, which integers() made."""
    books = first_books(rows, n_parts, n_entries)
    for _ in range(rounds if books is not None else 0):
        books = refined(rows, books)
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (binary: a byte for each part) and error, the summed squared distances, of every row."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, index, apart in _assigned(batches, books):
            code = pa.array(list(map(bytes, index.astype(np.uint8))), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), code, pa.array(apart.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(codes, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code binary, error bigint")


def decoded(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """codes with q, the integers that their code stands for."""

    def components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = np.array([list(c) for c in b.column("code").to_pylist()], np.int64).reshape(b.num_rows, len(books))
            q = books[np.arange(len(books)), index].reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(q.tolist(), pa.list_(pa.int64()))], [*b.schema.names, "q"])

    return codes.mapInArrow(components, StructType([*codes.schema, StructField("q", ArrayType(LongType()))]))


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code (hexadecimal), error, label_error (over all rows of the label) and codebooks_sha256 of every kept row.

    A label with very many rows meets its sum by broadcast.
    """
    rows = integers(vectors)
    books = fitted(rows)
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")).alias("key")
    if books is None:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    codes = staged(encoded(rows, books).select("vec_id", key, F.lower(F.hex("code")).alias("code"), "error"), "codes")
    sums = codes.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("c"))
    return with_counts(codes, sums, ["key"]).select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
