"""Benchmark decontamination by a prefix-filtered set join.

A window is ten consecutive words of a benchmark item, or the whole of a shorter item. Its set is its shingles of five
words (a shorter window is one shingle). A document contains a window only if it has all of its shingles, so a prefix of
one suffices: the shingle that is rarest over all documents. Documents are read once to count the shingles of the
items, windows with a shingle that no document has are dropped, and documents are read again for places of
prefix shingles. These meet the windows by the shingle; the place in the window and the words left on both sides bound
it, and the words themselves are compared, so hashes only propose and never decide.

Both scans test shingles against a bitmap whose size follows the number of items' shingles up to 2^MAX_BITS bits; a
larger benchmark lets more places through to the join, with the same rows. The windows are broadcast if their size was
found to be below BROADCAST_BYTES. Windows are told apart by content and items that share all their windows go by
one digest, so copies of items or passages in many documents never meet pair by pair.

Nulls: a null text has no words; a null item_id is listed as 'null'. Empty texts, and items without words, have no
windows. Long texts are read whole; rows of one item_id are one item. Repeated documents each have a row. Words alike, ties of rarity included, give
the same rows whichever shingle is taken. Empty tables give an empty result or documents without hits. Extra columns
are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenarc.llm.common import staged, text_or_empty
from lumenarc.llm.kernels import LOWER, Chunk, chunks, span_hash, window_hash
from lumenarc.llm.scans import joined_sha256

WINDOW = 10
SHINGLE = 5
#: Bits of a bitmap for each shingle in it, and the most bits of its size.
BITS_EACH = 32
MAX_BITS = 28
BROADCAST_BYTES = 32 << 20
#: A word, after A to Z are lower-cased: digits, letters and everything beyond ASCII.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OTHER = np.ones(256, dtype=bool)
OTHER[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def lower_words(text: str | Column = "text") -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.regexp_extract_all(F.translate(text_or_empty(text), upper, upper.lower()), F.lit(WORDS), F.lit(0))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """item_id (a string), wid and words of each distinct window of each item; stored."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), lower_words().alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(WINDOW))
    at = items.select("item_id", "w", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("i"))
    return staged(at.select("item_id", F.slice("w", F.col("i"), F.col("width")).alias("words")).select("item_id", F.md5(F.array_join("words", " ")).alias("wid"), "words").distinct(), "item-windows")


class _Words:
    """The lower-cased words of a chunk of texts and the hashes of their shingles."""

    def __init__(self, chunk: Chunk):
        self.low = LOWER[chunk.buf]
        other = OTHER[self.low]
        edge = np.flatnonzero(other[1:] != other[:-1]) + 1
        if len(other) and not other[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]  # each text ends in a line feed
        self.owner = np.searchsorted(chunk.off, self.starts, "right") - 1
        self.hashes = span_hash(self.low, self.starts, self.ends)
        self.counts = chunk.counts(self.owner)
        self.firsts = np.cumsum(self.counts) - self.counts

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of every run of k words of one text."""
        token, at = window_hash(self.hashes, self.owner, k)
        return token.view(np.int64), at

    def text(self, i: int, j: int) -> list[str]:
        return [self.low[self.starts[x] : self.ends[x]].tobytes().decode() for x in range(i, j)]


class Bitmap:
    """Which hashes may be in a set; made by Spark, of a size that is bounded."""

    def __init__(self, tokens: DataFrame, n: int):
        bits = int(np.clip(np.ceil(np.log2(max(n, 1) * BITS_EACH)), 16, MAX_BITS))
        self.mask, self.bytes = np.int64((1 << bits) - 1), np.zeros(1 << (bits - 3), np.uint8)
        place = F.col("token").bitwiseAND(F.lit(int(self.mask))) + 1
        for bucket, part in tokens.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("p")).collect():
            piece = np.frombuffer(part, np.uint8)
            self.bytes[(bucket - 1) * len(piece) : bucket * len(piece)] = piece[: len(self.bytes)]

    def maybe(self, tokens: np.ndarray) -> np.ndarray:
        place = tokens & self.mask
        return (self.bytes[place >> 3] >> (place & 7).astype(np.uint8)) & 1 != 0


def _window_shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        wid = b.column("wid")
        for chunk in chunks(b.column("text")):
            words = _Words(chunk)
            for k in range(1, SHINGLE + 1):
                token, at = words.shingles(k)
                own = words.owner[at]
                keep = np.minimum(words.counts[own], SHINGLE) == k
                own, at, token = own[keep], at[keep], token[keep]
                yield pa.RecordBatch.from_arrays([wid.take(pa.array(chunk.first + own)), pa.array(np.full(len(at), k, np.int32)), pa.array((at - words.firsts[own]).astype(np.int32)), pa.array(token)], ["wid", "k", "offset", "token"])


def shingle_counts(docs: DataFrame, bitmap: Bitmap, kinds: list[int]) -> DataFrame:
    """token and n, how often documents have it, of shingles that the bitmap lets through."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [np.zeros(0, np.int64)]
            for chunk in chunks(b.column("text")):
                words = _Words(chunk)
                seen += [token[bitmap.maybe(token)] for token, _ in map(words.shingles, kinds)]
            token, n = np.unique(np.concatenate(seen), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])

    return docs.select("text").mapInArrow(counted, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """token, k, offset, wid and words of each window that documents may hold: its rarest shingle; stored."""
    windows = staged(members.groupBy("wid").agg(F.first("words").alias("words")), "windows")
    shingles = staged(windows.select("wid", F.array_join("words", " ").alias("text")).mapInArrow(_window_shingles, "wid string, k int, offset int, token bigint"), "shingles")
    kinds = [r.k for r in shingles.select("k").distinct().collect()]  # at most SHINGLE of them
    tokens = shingles.select("token").distinct()
    counts = shingle_counts(docs, Bitmap(tokens, tokens.count()), kinds)
    rated = shingles.join(counts, "token", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "k", "offset")).alias("r"))
    return staged(rated.where("r.n > 0").select("wid", "r.token", "r.k", "r.offset").join(windows, "wid"), "prefixes")


def _places(batches: Iterator[pa.RecordBatch], bitmap: Bitmap, kinds: list[int]) -> Iterator[pa.RecordBatch]:
    """uid, doc_id, n_words and found: prefix shingles with the words around them, and all places of each in the text."""
    kind = pa.list_(pa.struct([("token", pa.int64()), ("left", pa.int32()), ("around", pa.list_(pa.string())), ("at", pa.list_(pa.int32()))]))
    for b in batches:
        n_words, found = np.zeros(b.num_rows, np.int64), [None] * b.num_rows
        for chunk in chunks(b.column("text")):
            words = _Words(chunk)
            n_words[chunk.first : chunk.first + len(chunk)] = words.counts
            places: dict[int, dict[tuple, list[int]]] = {}
            for k in kinds:
                token, at = words.shingles(k)
                hit = np.flatnonzero(bitmap.maybe(token))
                room = WINDOW - SHINGLE if k == SHINGLE else 0  # shorter shingles are whole windows
                for t, i in zip(token[hit].tolist(), at[hit].tolist(), strict=True):
                    o = int(words.owner[i])
                    first = int(words.firsts[o])
                    lo, hi = max(first, i - room), min(first + int(words.counts[o]), i + k + room)
                    places.setdefault(o, {}).setdefault((t, i - lo, *words.text(lo, hi)), []).append(i - first)
            for o, of in places.items():
                found[chunk.first + o] = [{"token": t, "left": left, "around": around, "at": at} for (t, left, *around), at in of.items()]
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(n_words), pa.array(found, kind)], ["uid", "doc_id", "n_words", "found"])


def occurrences(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every document as uid, doc_id and n_words; and uid, start, width and wid of each window that it holds.

    windows is what prefixes() made of these documents.
    """
    kinds = [r.k for r in windows.select("k").distinct().collect()]
    n, n_bytes = windows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.array_join("words", " "))), F.lit(0))).first()
    bitmap = Bitmap(windows.select("token"), n)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanned = staged(rows.mapInArrow(lambda bs: _places(bs, bitmap, kinds), "uid bigint, doc_id bigint, n_words bigint, found array<struct<token: bigint, left: int, around: array<string>, at: array<int>>>"), "scanned")
    found = scanned.where(F.size("found") > 0).select("uid", F.inline("found"))
    met = found.join(F.broadcast(windows) if n_bytes + 200 * n <= BROADCAST_BYTES else windows, "token")
    fits = (F.col("left") >= F.col("offset")) & (F.size("around") - F.col("left") >= F.size("words") - F.col("offset"))
    same = F.slice("around", F.col("left") - F.col("offset") + 1, F.size("words")) == F.col("words")
    held = met.where(fits).where(same)
    return scanned.select("uid", "doc_id", "n_words"), held.select("uid", F.explode("at").alias("at"), "offset", F.size("words").alias("width"), "wid").select("uid", (F.col("at") - F.col("offset")).alias("start"), "width", "wid")


def contamination(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their contaminated word spans, and the items of each class.

    Documents: uid, doc_id, n_words, spans (array of start and end, merged, ends exclusive; null without hits) and
    classes (class and its number of items). A class is a set of items, the digest of their ids: those of one window.
    """
    members = item_windows(benchmark)
    classes = staged(joined_sha256(members.select("wid", "item_id"), "wid", "item_id"), "classes")
    every, held = occurrences(docs, prefixes(docs, members))
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end"))))
    merged = F.expr("""aggregate(spans, cast(array() as array<struct<start: int, end: int>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).end >= x.start,
           concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).start as start, greatest(element_at(a, -1).end, x.end) as end))),
           concat(a, array(struct(x.start as start, x.end as end)))))""")
    by_doc = held.join(classes, "wid").groupBy("uid").agg(spans.alias("spans"), F.array_sort(F.collect_set(F.struct(F.col("sha256").alias("class"), "n"))).alias("classes"))
    items = members.join(classes.groupBy(F.col("sha256").alias("class")).agg(F.min("wid").alias("wid")), "wid").select("class", "item_id")
    return every.join(by_doc.select("uid", merged.alias("spans"), "classes"), "uid", "left"), items


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Documents of one class take its digest; several classes are joined once for each distinct set of them.
    """
    hits, items = contamination(docs, benchmark)
    hits = staged(hits.withColumn("set", F.when(F.size("classes") > 1, F.sha2(F.array_join(F.transform("classes", lambda c: c["class"]), ","), 256))), "hits")
    sets = hits.where("set IS NOT NULL").groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes.class").alias("class"))
    several = joined_sha256(sets.join(items, "class").select("set", "item_id").distinct(), "set", "item_id").withColumnRenamed("n", "n_set")
    n_hit = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<start: int, end: int>>")), F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return hits.join(several, "set", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("n_set", F.col("classes")[0]["n"], F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("sha256", F.col("classes")[0]["class"], F.lit(EMPTY_SHA256)).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
