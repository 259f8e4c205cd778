"""SpotSigs fingerprints: chains of content words after common-word anchors.

Every common word (of four languages) is an anchor, and so is each content word without a common word within REACH
words on either side, so that no stretch of a text is bare and an edit changes only the anchors about it. The
signature is the anchor with the two content words that follow it, or what there is of them before the text ends. A
fingerprint is the sorted set of 32-bit signature hashes in base64; likeness is the Jaccard similarity of
two sets, 1 for equal texts without words and 0 for a text without words against one with some.

similar_fingerprints() joins a whole table with itself: sets are partitioned by length, only partitions whose lengths
allow the similarity meet, and only through the rarest signatures of each set.

Nulls: a null text is empty. Repeated rows get equal fingerprints; long texts are read whole; an empty table gives
no rows. Ties of doc_id are ordered by the hash of the text, null ids come last. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm import kernels as K
from lumenarc.llm.common import partitions, text_or_empty, utf8

CHAIN = 2
REACH = 5
#: Common words, by language; fixed values.
COMMON = {
    "en": "a an and are as at be by for from has have he in is it of on or that the they this to was were will with",
    "de": "als auch auf aus das dem den der des die ein eine für im in ist mit nicht sich sie und von zu zum",
    "fr": "au aux ce dans de des du elle en est et il la le les ne ou par pas plus pour que qui se sur un une",
    "es": "al como con de del el en es la las lo los más no para pero por que se su un una y",
}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_RIM = np.isin(np.arange(256), list(b".,;:!?\"'()[]{}<>#*$%&|-_/"))


def _hash_of(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return K.span_hash(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


_ANCHORS = np.unique(_hash_of(sorted({w for words in COMMON.values() for w in words.split()})))


def signature_sets(chunk: K.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, 32-bit signature) pairs of a chunk, sorted and distinct, as two arrays."""
    buf = K.LOWER[chunk.buf]
    ws, we, owner = chunk.words(buf)
    if not len(ws):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    a, b = ws.copy(), we.copy()
    while True:
        left = (b - a > 1) & _RIM[buf[a]]
        right = (b - a - left > 1) & _RIM[buf[b - 1]]
        if not (left | right).any():
            break
        a, b = a + left, b - right
    h = K.span_hash(buf, a, b)
    anchor = np.isin(h, _ANCHORS)
    content = np.flatnonzero(~anchor)
    padded = np.concatenate([content, np.full(CHAIN, -1)])
    near = anchor.copy()
    for j in range(1, REACH + 1):
        same = owner[j:] == owner[:-j]
        near[j:] |= anchor[:-j] & same
        near[:-j] |= anchor[j:] & same
    at = np.flatnonzero(anchor | ~near)
    nxt, key = np.searchsorted(content, at, "right"), h[at]
    with np.errstate(over="ignore"):
        for j in range(CHAIN):
            w = padded[np.minimum(nxt + j, len(padded) - 1)]
            ok = (w >= 0) & (owner[w] == owner[at])
            key = key * np.uint64(0xD6E8FEB86659FD93) + np.where(ok, h[w], np.uint64(0))
    o, s = owner[at], (K.mix(key) >> np.uint64(32)).astype(np.uint32)
    keys = np.unique(o.astype(np.uint64) << np.uint64(32) | s.astype(np.uint64))
    return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _sets(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for chunk in K.chunks(pa.array(texts, pa.large_string())):
        owner, sigs = signature_sets(chunk)
        out += np.split(sigs, np.searchsorted(owner, np.arange(1, len(chunk))))
    return out


def encoded(sigs: np.ndarray) -> str:
    return base64.b64encode(sigs.astype("<u4").tobytes()).decode()


def decoded(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), "<u4")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two signature sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encoded(s) for s in _sets([t.as_py() or "" for t in batch.column(1)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as much of the head of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of (doc_id, text, ahead), dealt and sorted so that each row's next document, by falling id, stands after it.

    Ids are dealt into ranges whose first keys are known; the first row of a range also goes, marked ahead, to the end
    of the range before it (the very first row to the last range). Texts are shuffled once. The driver holds one key
    per range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    falling = F.coalesce(-F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
    key = F.concat(F.lpad(falling.cast("string"), 20, "0"), F.sha2(utf8(text_or_empty()), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), key.alias("key"))
    firsts = rows.select("key").repartitionByRange(n, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").alias("key"))
    bounds = sorted(r["key"] for r in firsts.collect()) or [""]
    m = len(bounds)

    @F.pandas_udf("int")
    def ranged(keys: pd.Series) -> pd.Series:
        """Twice the range of a key, and one more for the first key of a range."""
        at = [bisect_right(bounds, k) - 1 for k in keys]
        return pd.Series([2 * i + (bounds[i] == k) for i, k in zip(at, keys, strict=True)], dtype="int32")

    dealt = rows.withColumn("at", ranged("key")).withColumn("place", F.shiftright("at", 1)).withColumn("first", F.col("at") % 2 == 1).drop("at")
    copies = F.when(F.col("first"), F.array(F.struct(F.col("place").alias("place"), F.lit(0).alias("ahead")), F.struct(((F.col("place") + (m - 1)) % m).cast("int").alias("place"), F.lit(1).alias("ahead"))))
    dealt = dealt.select("doc_id", "text", "key", F.explode(copies.otherwise(F.array(F.struct(F.col("place").alias("place"), F.lit(0).alias("ahead"))))).alias("at"))
    dealt = dealt.select("doc_id", "text", "key", F.col("at.place").alias("place"), F.col("at.ahead").alias("ahead"))
    return dealt.repartitionById(m, "place").sortWithinPartitions("place", "ahead", "key").select("doc_id", "text", "place", "ahead")


def with_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness to it and to the next document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def out(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text, ahead), the last of them only as a neighbour."""
        texts = [t for _, t, _ in rows]
        own = _sets(texts)
        new = [edited(t, after) for t, after in zip(texts, texts[1:], strict=False)]
        cols: list[list] = [[] for _ in schema]
        for i, (e, s) in enumerate(zip(new, _sets(new), strict=True)):
            if not rows[i][2]:
                near = (likeness(own[i], s) if e != texts[i] else 1.0, likeness(own[i], own[i + 1]) if texts[i] != texts[i + 1] else 1.0)
                for c, v in zip(cols, (rows[i][0], len(texts[i]), hashlib.sha256(e.encode()).hexdigest(), encoded(own[i]), encoded(s), *near), strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        total, place = 0, None
        for batch in batches:
            for doc_id, text, p, ahead in zip(*(c for c in batch.columns), strict=True):
                if p.as_py() != place or total > 1 << 20:
                    if len(held) > 1:
                        yield out(held)
                    held, total = held[-1:] if p.as_py() == place else [], 0
                    place = p.as_py()
                held.append((doc_id.as_py(), text.as_py(), ahead.as_py()))
                total += len(held[-1][1])
        if len(held) > 1:
            yield out(held)

    return with_next(docs).mapInArrow(run, SCHEMA)


def similar_fingerprints(prints: DataFrame, percent: int = 80, step: float = 1.25) -> DataFrame:
    """prints (doc_id, fingerprint): pairs of different fingerprints with Jaccard similarity of percent or more.

    Returns (fingerprint_a, fingerprint_b, likeness), each pair once; join back by fingerprint for the documents.
    Lengths fall into partitions by powers of step; a set's prefix holds so many of its rarest signatures that two
    similar sets share one, so no pair is lost, and equal fingerprints count once.
    """
    schema = "fingerprint string, sigs array<long>"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [decoded(f.as_py()).astype(np.int64).tolist() for f in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fingerprint", "sigs"])

    sets = prints.select("fingerprint").where("fingerprint <> ''").distinct().mapInArrow(split, schema)
    sets = sets.withColumn("n", F.size("sigs"))
    each = sets.select("fingerprint", "n", F.explode("sigs").alias("sig"))
    rarity = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")
    ordered = each.join(rarity, "sig").groupBy("fingerprint", "n").agg(F.array_sort(F.collect_list(F.struct("df", "sig"))).alias("known"))
    # signatures of one set only come first in the order and match nothing; they use up the prefix
    reach = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("known"))
    prefix = ordered.where(reach > 0).select("fingerprint", "n", F.explode(F.slice("known", 1, reach.cast("int"))).alias("s"))
    part = lambda n: F.floor(F.log(n) / F.log(F.lit(step))).cast("int")
    a = prefix.select(F.col("fingerprint").alias("fingerprint_a"), F.col("n").alias("n_a"), F.col("s.sig").alias("sig"), part(F.col("n")).alias("part"))
    low = part(F.ceil(F.col("n") * percent / 100))
    b = prefix.select(F.col("fingerprint").alias("fingerprint_b"), F.col("n").alias("n_b"), F.col("s.sig").alias("sig"), F.explode(F.sequence(low, part(F.col("n")))).alias("part"))
    smaller = (F.col("n_a") < F.col("n_b")) | (F.col("n_a") == F.col("n_b")) & (F.col("fingerprint_a") < F.col("fingerprint_b"))
    pairs = a.join(b, ["sig", "part"]).where(smaller & (100 * F.col("n_a") >= percent * F.col("n_b"))).select("fingerprint_a", "fingerprint_b").distinct()
    left, right = sets.select(F.col("fingerprint").alias("fingerprint_a"), F.col("sigs").alias("sa")), sets.select(F.col("fingerprint").alias("fingerprint_b"), F.col("sigs").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    out = pairs.join(left, "fingerprint_a").join(right, "fingerprint_b").withColumn("both", both).withColumn("either", F.size("sa") + F.size("sb") - F.col("both"))
    return out.where(100 * F.col("both") >= percent * F.col("either")).select("fingerprint_a", "fingerprint_b", (F.col("both") / F.col("either")).alias("likeness"))
