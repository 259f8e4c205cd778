"""Suffix-array dedup: remove every byte that a 200-byte string found elsewhere covers.

Each 200-byte window has an anchor, its least 16-byte gram by hash; equal windows have equal anchors at equal places,
so repeats need only be sought among windows of one anchor. The consecutive windows of an anchor form a run (about 93
bytes apart). An anchor found once holds no repeat; runs alike throughout are repeats as a whole, and they are told
by grouped counts, which also fold copies, however many. What is left are the rims of repeats: anchors with unlike
runs. One text of each unlike run goes with its anchor to one task, which builds a suffix array of those texts by
two-stage sorting (suffixes smaller than their successors are sorted directly, the others are induced by scans of the
buckets of first bytes) and marks windows whose common prefix with an adjacent suffix spans a window. Anchors with
more than HOT unlike runs would be too much for one task; each of their windows becomes a row, and rows are counted.

Nulls: a null text is empty and a null id is an id. Rows with equal id and text are two occurrences of the same text.
Texts under 200 bytes are never cut. Long texts are read whole. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm import kernels as K
from lumenarc.llm.common import partitions, passing, staged, text_or_empty, with_counts

WIDTH = 200
GRAM = 16
HOT = 4096
#: Bytes of one suffix array; a group of runs is never split.
ARRAY_BYTES = 1 << 19
#: Bytes of the spans that are sent on at once.
SPAN_BYTES = 1 << 24
SEPARATOR = 0xFF  # in no UTF-8 text
#: A place in a text, beside which the upper half of a gram's hash ranks it; a text of Spark has fewer bytes than 1 << 31.
_PLACE = np.uint64((1 << 32) - 1)
KEY = ["k1", "k2"]


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number ordered as they are."""
    x = np.concatenate([buf, np.zeros(7, np.uint8)]).astype(np.uint64)
    for shift in (1, 2, 4):
        x = (x[: len(x) - shift] << np.uint64(8 * shift)) | x[shift:]
    return x


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive numbers."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def chunk_runs(chunk: K.Chunk) -> tuple[np.ndarray, ...]:
    """Text, anchor hash, content hash, first and last window start and anchor place of each run."""
    buf = chunk.buf
    none = np.zeros(0, np.int64)
    if len(buf) <= WIDTH or not (chunk.size >= WIDTH).any():
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    words = _words(buf)
    with np.errstate(over="ignore"):
        gram = K.mix(words[:-8] + K.mix(words[8:]) * np.uint64(0xA24BAED4963EE407))[: len(buf) - GRAM + 1]
    ranked = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    least = (_sliding_least(ranked, WIDTH - GRAM + 1) & _PLACE).astype(np.int64)
    ends = chunk.off + chunk.size
    usable = np.zeros(len(least) + 1, np.int32)
    long_enough = chunk.size >= WIDTH
    np.add.at(usable, chunk.off[long_enough], 1)
    np.add.at(usable, np.minimum(ends[long_enough] - WIDTH + 1, len(least)), -1)
    usable = np.cumsum(usable[:-1]) > 0
    start = np.flatnonzero(usable & np.concatenate([[True], (least[1:] != least[:-1]) | ~usable[:-1]]))
    stop = np.flatnonzero(usable & np.concatenate([(least[1:] != least[:-1]) | ~usable[1:], [True]]))
    owner = np.searchsorted(chunk.off, start, "right") - 1
    place = least[start]
    content = K.span_hash(buf, start, stop + WIDTH)
    with np.errstate(over="ignore"):
        content = K.mix(content + (place - start).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    base = chunk.off[owner]
    return owner, gram[place], content, start - base, stop - base, place - base


def runs(docs: DataFrame) -> DataFrame:
    """Every run of windows: its text (k1, k2), anchor, content and window starts lo to hi."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("anchor", pa.int64()), ("content", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(2)):
                owner, anchor, content, lo, hi, _ = chunk_runs(chunk)
                take = pa.array(owner + chunk.first)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], schema=schema)

    return keyed(docs).select(*KEY, "text").mapInArrow(run, "k1 long, k2 long, anchor long, content long, lo int, hi int")


def keyed(docs: DataFrame) -> DataFrame:
    """docs as (k1, k2, doc_id, text); rows alike in id and text share a key."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63) + 1)).alias("k1"), F.xxhash64(text_or_empty()).alias("k2"), doc_id.alias("doc_id"), text_or_empty().alias("text"))


def suffix_array(text: np.ndarray, depth: int = WIDTH) -> np.ndarray:
    """Starts of all suffixes in order of their first `depth` bytes at least, by two-stage sorting.

    text ends in a byte that is larger than all others of it. Suffixes smaller than their successors are sorted
    directly; a scan over the buckets of first bytes then induces the others, as each of them precedes one already
    placed. In a bucket, those induced stand before those sorted.
    """
    n = len(text)
    step = np.sign(text[1:].astype(np.int16) - text[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)
    nearest = np.minimum.accumulate(at[::-1])[::-1]  # a run of one byte goes as the byte after it
    smaller = np.zeros(n, bool)
    inside = nearest < n
    smaller[:-1][inside] = step[nearest[inside]] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    prefixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, depth)[direct])
    direct = direct[np.argsort(prefixes.view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[text[-1]].append(np.array([n - 1]))
    out = []
    for byte in range(256):
        wave = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        waves = [wave]
        while len(wave):  # suffixes that start with this byte twice
            before = wave[wave > 0] - 1
            wave = before[(text[before] == byte) & ~smaller[before]]
            waves.append(wave)
        bucket = np.concatenate([*waves, direct[bounds[byte] : bounds[byte + 1]]])
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[text[before] > byte]
        first = text[before]
        order = np.argsort(first, kind="stable")
        for group in np.split(before[order], np.flatnonzero(np.diff(first[order])) + 1) if len(before) else ():
            induced[text[group[0]]].append(group)
    return np.concatenate(out)


def adjacent_prefixes(text: np.ndarray, array: np.ndarray, most: int = WIDTH) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, in whole words of eight bytes and at most `most`."""
    words = np.concatenate([_words(text), np.zeros(most, np.uint64)])
    out = np.zeros(len(array), np.int64)
    alive = np.arange(1, len(array))
    for depth in range(0, most, 8):
        alive = alive[words[array[alive] + depth] == words[array[alive - 1] + depth]]
        out[alive] = depth + 8
    return out


def repeated_windows(spans: list[bytes]) -> list[np.ndarray]:
    """For each text, which of its 200-byte windows start anywhere else in the texts."""
    joined = np.frombuffer(b"".join(s + bytes([SEPARATOR]) for s in spans), np.uint8)
    array = suffix_array(joined)
    long_enough = adjacent_prefixes(joined, array) >= WIDTH
    marked = np.zeros(len(joined), bool)
    marked[array[long_enough]] = True
    marked[array[np.flatnonzero(long_enough) - 1]] = True
    out, at = [], 0
    for s in spans:
        out.append(marked[at : at + max(0, len(s) - WIDTH + 1)])
        at += len(s) + 1
    return out


def _intervals(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


_FOUND = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])


def array_marks(spans: DataFrame) -> DataFrame:
    """spans (anchor, k1, k2, lo, single, span): windows of single runs that repeat, as (k1, k2, lo, hi)."""

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        masks = repeated_windows(table.column("span").to_pylist())
        row, lo, hi = [], [], []
        for i, (single, start, mask) in enumerate(zip(table.column("single").to_pylist(), table.column("lo").to_pylist(), masks, strict=True)):
            if single:
                a, b = _intervals(mask)
                row += [i] * len(a)
                lo += (a + start).tolist()
                hi += (b + start).tolist()
        take = pa.array(row, pa.int64())
        keys = [table.column(k).combine_chunks().take(take) for k in KEY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            at, anchor = 0, batch.column(0).to_numpy()
            turns = np.append(np.flatnonzero(np.diff(anchor)) + 1, len(anchor)) if len(anchor) else ()
            length = np.diff(np.frombuffer(batch.column(5).buffers()[1], np.int32)[batch.column(5).offset :][: len(anchor) + 1]) if len(anchor) else ()
            if held and len(anchor) and held[-1].column(0)[-1].as_py() != anchor[0] and size > ARRAY_BYTES:
                yield whole(held)
                held, size = [], 0
            for turn in turns:
                size += int(length[at:turn].sum())
                held.append(batch.slice(at, turn - at))
                at = turn
                if size > ARRAY_BYTES and turn < len(anchor):
                    yield whole(held)
                    held, size = [], 0
        if held:
            yield whole(held)

    dealt = spans.select("anchor", *KEY, "lo", "single", "span").repartition(partitions(spans.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "k1 long, k2 long, lo int, hi int")


def counted_marks(spans: DataFrame) -> DataFrame:
    """The same for hot anchors: a row for each window, counted by content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                span = np.frombuffer(batch.column(5)[i].as_py(), np.uint8)
                starts = np.arange(len(span) - WIDTH + 1)
                part = batch.slice(i, 1)
                take = pa.array(np.zeros(len(starts), np.int64))
                window = pa.array(K.span_hash(span, starts, starts + WIDTH).view(np.int64))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in (0, 1, 2, 4)), pa.array((starts + part.column(3)[0].as_py()).astype(np.int32)), window], names=["anchor", *KEY, "single", "lo", "window"])

    rows = spans.select("anchor", *KEY, "lo", "single", "span").mapInArrow(run, "anchor long, k1 long, k2 long, single boolean, lo int, window long")
    twice = rows.groupBy("anchor", "window").agg(F.count("*").alias("c")).where("c > 1").select("anchor", "window")
    return rows.where("single").join(twice, ["anchor", "window"], "left_semi").select(*KEY, "lo", F.col("lo").alias("hi"))


def repeats(docs: DataFrame) -> DataFrame:
    """(k1, k2, lo, hi): window starts lo to hi of a text repeat elsewhere."""
    found, drop_runs = passing(runs(docs), "runs")
    anchors = found.groupBy("anchor").agg(F.count("*").alias("c"), (F.min("content") == F.max("content")).alias("alike")).where("c > 1")
    told = lambda c: F.when(~F.col("alike"), F.col(c)).alias(c)  # noqa: E731  of no use once runs are known to be alike
    shared = staged(with_counts(found, anchors, ["anchor"]).select(told("anchor"), told("content"), *KEY, "lo", "hi", "alike"), "shared")
    drop_runs()
    unlike = shared.where("not alike")
    kinds = unlike.groupBy("anchor", "content").agg(F.count("*").alias("c"), F.min(F.struct(*KEY, "lo", "hi")).alias("r"))
    kinds = staged(kinds.select("anchor", "content", "c", "r.*"), "kinds")
    copies = with_counts(unlike, kinds.where("c > 1").select("anchor", "content", "c"), ["anchor", "content"])
    whole = shared.where("alike").select(*KEY, "lo", "hi").unionByName(copies.select(*KEY, "lo", "hi"))
    # texts of unlike runs, cut from their documents
    each = kinds.withColumnRenamed("c", "rows")
    each = with_counts(each, each.groupBy("anchor").agg(F.count("*").alias("c")), ["anchor"])
    each = each.select(*KEY, F.struct("anchor", (F.col("rows") == 1).alias("single"), "lo", "hi", (F.col("c") > HOT).alias("hot")).alias("run"))
    cuts = each.groupBy(*KEY).agg(F.collect_list("run").alias("cuts"))  # at most the runs of one text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            fresh = np.ones(len(k1), bool)  # twins stand next to their likes as the join has sorted them
            fresh[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            fresh[0] = (k1[0], k2[0]) != before
            before = (k1[-1], k2[-1])
            batch = batch.filter(pa.array(fresh))
            wanted = batch.column(3).flatten()
            owner = np.repeat(np.arange(batch.num_rows), batch.column(3).value_lengths().to_numpy())
            lo, hi = wanted.field("lo").to_numpy(), wanted.field("hi").to_numpy()
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            through = np.cumsum(hi.astype(np.int64) - lo + WIDTH)
            for part in np.split(np.arange(len(lo)), np.flatnonzero(np.diff(through // SPAN_BYTES)) + 1):
                of, runs_of = pa.array(owner[part]), wanted.take(pa.array(part))
                span = [raw[i][x : y + WIDTH] for i, x, y in zip(owner[part].tolist(), lo[part].tolist(), hi[part].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [runs_of.field("anchor"), batch.column(0).take(of), batch.column(1).take(of), runs_of.field("lo"), runs_of.field("single"), pa.array(span, pa.binary()), runs_of.field("hot")],
                    names=["anchor", *KEY, "lo", "single", "span", "hot"],
                )

    # a single run is of a row without a twin, so twins only repeat spans that are known to repeat
    texts = keyed(docs).select(*KEY, "text").join(cuts, KEY).select(*KEY, "text", "cuts")
    spans = staged(texts.mapInArrow(cut, "anchor long, k1 long, k2 long, lo int, single boolean, span binary, hot boolean"), "spans")
    marks = array_marks(spans.where("not hot")).unionByName(counted_marks(spans.where("hot")))
    return whole.unionByName(marks)


def _cut_mask(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Bytes of a text that windows with starts lo to hi cover."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, np.minimum(hi + WIDTH, n), -1)
    return np.cumsum(edge[:-1]) > 0


def with_cuts(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, text and the window starts (los, his) that repeat."""
    both = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("hi").cast("long"))
    # a set, as rows alike in id and text find the same windows: at most the runs and rims of one text, however many rows
    found = repeats(docs).groupBy(*KEY).agg(F.collect_set(both).alias("found"))
    los, his = F.transform("found", lambda x: F.shiftright(x, 32).cast("int")), F.transform("found", lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return keyed(docs).join(found.select(*KEY, los.alias("los"), his.alias("his")), KEY, "left")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, lo, hi in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                raw = text.as_py().encode("utf-8")
                if not lo.is_valid:
                    rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest()))
                    continue
                mask = _cut_mask(len(raw), lo.values.to_numpy(), hi.values.to_numpy())
                kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                rows.append((len(raw), len(raw) - len(kept), len(_intervals(mask)[0]), hashlib.sha256(kept).hexdigest()))
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True)] if rows else [pa.array([], f.type) for f in list(schema)[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema=schema)

    return with_cuts(docs).select("doc_id", "text", "los", "his").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
