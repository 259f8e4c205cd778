"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Pieces have integer lengths from 1 to the capacity, so the whole instance is a histogram of at most `capacity`
counts, whatever the number of documents. The reduction and the best fit both work on that histogram, many alike
sequences at a time: the plan is a short list of slot rows (length, how many, first sequence, place). Spark then
ranks the pieces of each length, in salted buckets so that one very common length needs no single task, and each
piece looks its rank up in the plan. Only the histogram reaches the driver.

Nulls: a null text is empty, which is one piece of one token, the closing id. Repeated rows are packed once each.
Very long texts are cut into capacity-token pieces, the first of which may be shorter. Pieces of equal length are
ordered by a hash of what they are, so ties may change places, and no more. Empty tables give no rows. Extra columns
are not read.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenarc.llm.common import staged

CAPACITY = 2048
CLOSING_ID = 0
BUCKETS = 256
#: Name of a public vocabulary; ids of byte_bpe_50k.json, which its .tiktoken form gives five times as fast.
VOCABULARY = "byte_bpe_50k"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Special tokens of the vocabulary and their ids, which the tokenizer gives wherever a text holds their names; fixed values.
SPECIAL = {"<|endoftext|>": 50256}
_encoders: dict = {}


def encoder(name: str = VOCABULARY):
    """The vocabulary as a tiktoken encoding, read once per worker."""
    if name not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[name] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return _encoders[name]


def token_ids(text: str | None, name: str = VOCABULARY) -> np.ndarray:
    """Ids of a text and the closing id, as little-endian unsigned 32-bit numbers."""
    ids = encoder(name).encode_to_numpy(text or "", allowed_special="all")
    return np.append(ids, CLOSING_ID).astype("<u4")


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; the first takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Token pieces of every document: place in the document, length and checksum of the ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = token_ids(text.as_py(), vocabulary)
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], t.type) for t in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


class _Sizes:
    """Counts by size, with the sizes that are left kept in order."""

    def __init__(self, counts: dict[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            self.order.remove(size)

    def smallest(self, k: int, without: int) -> list[int]:
        """The k smallest items, besides one of size `without`."""
        out: list[int] = []
        for s in self.order:
            out += [s] * min(k - len(out), self.count[s] - (s == without))
            if len(out) == k:
                break
        return out

    def largest_within(self, room: int, without: int) -> int:
        """The largest item of at most room, besides one of size `without`; 0 if none."""
        for s in reversed(self.order[: bisect_left(self.order, room + 1)]):
            if self.count[s] - (s == without) > 0:
                return s
        return 0

    def best_pair(self, room: int, without: int) -> int:
        """The largest sum of two items of at most room, besides one of size `without`."""
        there = [s for s in self.order[: bisect_left(self.order, room)] if self.count[s] - (s == without) > 0]
        best, i, j = 0, 0, len(there) - 1
        while i <= j:
            a, b = there[i], there[j]
            if a + b > room or i == j and self.count[a] - (a == without) < 2:
                j -= 1
            else:
                best = max(best, a + b)
                i += 1
        return best


def reduced(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, list[tuple[int, int]]]], dict[int, int]]:
    """Sets fixed by dominance, as (how many alike, [(size, copies)]), and the counts that are left.

    For the largest item: alone if nothing fits beside it; with a partner that fills the room exactly; with the
    largest partner if no two others fit, or if no two that fit together are larger than it and no three fit.
    """
    left, fixed = _Sizes(counts), []
    for size in sorted(counts, reverse=True):
        while left.count.get(size):
            room = capacity - size
            few = left.smallest(3, size)
            partner = left.largest_within(room, size)
            if partner:
                alone_fits = len(few) < 2 or few[0] + few[1] > room
                pair_is_less = (len(few) < 3 or sum(few) > room) and partner >= left.best_pair(room, size)
                if not (partner == room or alone_fits or pair_is_less):
                    break
                n = left.count[size] // 2 if partner == size else min(left.count[size], left.count[partner])
                if partner != size and not partner == room:
                    n = 1 if left.count[partner] == 1 else max(1, min(n, left.count[partner] - 1))
                fixed.append((n, [(size, 2)] if partner == size else [(size, 1), (partner, 1)]))
                left.take(size, 2 * n if partner == size else n)
                if partner != size:
                    left.take(partner, n)
            else:
                n = left.count[size] if not few or few[0] > room else 1
                fixed.append((n, [(size, 1)]))
                left.take(size, n)
    return fixed, left.count


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Best fit of sizes in falling order; alike sequences are filled together."""
    rooms: list[tuple[int, int]] = []  # (room, key into bins)
    bins: dict[int, tuple[int, list[tuple[int, int]]]] = {}
    done: list[tuple[int, list[tuple[int, int]]]] = []
    key = 0

    def put(n: int, room: int, content: list[tuple[int, int]]) -> None:
        nonlocal key
        if room:
            key += 1
            bins[key] = (n, content)
            insort(rooms, (room, key))
        else:
            done.append((n, content))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, (size, 0))
            if at < len(rooms):
                room, k = rooms.pop(at)
                many, content = bins.pop(k)
            else:
                room, many, content = capacity, n, []
            each = room // size
            full = min(many, n // each)
            if full:
                put(full, room - each * size, [*content, (size, each)])
                n -= full * each
            rest = many - full
            if rest and n and n < each:
                put(1, room - n * size, [*content, (size, n)])
                n, rest = 0, rest - 1
            if rest and content:
                put(rest, room, content)
    return done + [bins[k] for _, k in rooms]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Slot rows (size, first rank, pieces, copies in a sequence, first sequence, place), by size and rank."""
    fixed, rest = reduced(counts, capacity)
    ranks, base, rows = dict.fromkeys(counts, 0), 0, []
    for many, content in fixed + best_fit(rest, capacity):
        place = 0
        for size, copies in content:
            rows.append((size, ranks[size], many * copies, copies, base, place))
            ranks[size] += many * copies
            place += size * copies
        base += many
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def assigned(ranked: DataFrame, plan: np.ndarray) -> DataFrame:
    """ranked (PIECES, rank): adds sequence_id and offset by looking each rank up in the plan."""
    lengths, firsts = np.unique(plan[:, 0], return_index=True)
    ends = np.append(firsts[1:], len(plan))
    wide = plan[:, 1].max(initial=0) + 1
    keys = np.searchsorted(lengths, plan[:, 0]) * wide + plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            which = np.searchsorted(lengths, length)
            at = np.searchsorted(keys, which * wide + np.minimum(rank, wide - 1), "right") - 1
            assert ((at >= firsts[which]) & (at < ends[which])).all()
            row, past = plan[at], rank - plan[at, 1]
            out = [*batch.columns[:5], pa.array(row[:, 4] + past // row[:, 3]), pa.array(row[:, 5] + past % row[:, 3] * length)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    rows = staged(pieces(docs, capacity, vocabulary), "pieces")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(BUCKETS)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = rows.withColumn("rank", rank).join(base, ["length", "bucket"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
    return assigned(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank"), packing_plan(counts, capacity))
