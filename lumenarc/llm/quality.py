"""Line-first cleaning and document quality.

Rules are evaluated per line, failing lines are removed, and a document is rejected if what is left holds less than
half of its words, or if it breaks the base rules. A line without words is neither judged nor removed. A line with
words fails when
  * it equals an earlier line of its document,
  * it is mostly markup: more than one of the characters #*$%&|<> for every three words,
  * it shouts: more than one '!!' for every two words,
  * it is navigation: fewer than four words and no closing punctuation, or
  * it is boilerplate: at most 30 words and one of the phrases below.

Nulls: a null text has no words, so base_failed; empty texts likewise. Long texts are handled whole. Repeated rows give
repeated results; of equal lines the first stays; shares that meet a limit exactly pass. An empty table gives no rows.
line_first() doesn't read extra columns, cleaned() keeps them, whatever their type and name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenarc.llm import kernels as K
from lumenarc.llm.common import map_batches

SYMBOLS = b"#*$%&|<>"
CLOSING = b".!?:;\"')]"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
MARKUP_PER_WORDS = 3
SHOUTS_PER_WORDS = 2
NAVIGATION_WORDS = 4
BOILERPLATE_WORDS = 30
KEEP_PERCENT = 50
#: Phrases of page furniture, compared in lower-cased ASCII.
BOILERPLATE = ("all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy", "read more", "sign in", "sign up", "skip to content", "subscribe to", "terms of use")

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, n_kept_words long"
_PHRASES = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_IS_CLOSING = np.isin(np.arange(256), list(CLOSING))


def _closing(buf: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the characters that end at these bytes close a sentence; … ” » and 。 count too."""
    a, b, c = buf[last], buf[np.maximum(last - 1, 0)], buf[np.maximum(last - 2, 0)]
    wide = (a == 0xA6) & (b == 0x80) & (c == 0xE2) | (a == 0x9D) & (b == 0x80) & (c == 0xE2) | (a == 0xBB) & (b == 0xC2) | (a == 0x82) & (b == 0x80) & (c == 0xE3)
    return _IS_CLOSING[a] | wide


def judge(chunk: K.Chunk) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Figures of each text; start and end of each line with words, and whether it fails."""
    buf, n = chunk.buf, len(chunk)
    ws, we, owner = chunk.words()
    n_words = chunk.counts(owner)
    head = (buf & 0xC0) != 0x80
    chars = K.crossing_sum(head & ~K.IS_SPACE[buf], chunk.off, chunk.off + chunk.size)
    symbol = _IS_SYMBOL[buf]
    hashes = K.span_hash(buf, ws, we)

    window, at = K.window_hash(hashes, owner, REPEAT_WINDOW)
    with np.errstate(over="ignore"):
        window = K.mix(window + owner[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    repeat = chunk.counts(owner[K.covered(len(ws), at[twice], REPEAT_WINDOW)])

    ends = np.flatnonzero(buf == K.LF)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first = np.searchsorted(ws, starts)
    beyond = np.searchsorted(ws, ends)
    full = beyond > first
    starts, ends, first, beyond = starts[full], ends[full], first[full], beyond[full]
    words = beyond - first
    line_owner = owner[first]
    with np.errstate(over="ignore"):
        key = K.mix(K.span_hash(buf, starts, ends) + line_owner.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    _, earliest = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[earliest] = False

    markup = K.crossing_sum(symbol, starts, ends) * MARKUP_PER_WORDS > words
    bang = np.concatenate([(buf[:-1] == 33) & (buf[1:] == 33), [False]])
    odd = np.zeros(len(buf), bool)  # '!!!' holds one '!!': of each run, every other place counts
    if bang.any():
        place = np.flatnonzero(buf == 33)
        run_start = np.concatenate([[True], np.diff(place) > 1])
        rank = np.arange(len(place)) - np.maximum.accumulate(np.where(run_start, np.arange(len(place)), 0))
        odd[place[rank % 2 == 1]] = True
    shout = K.crossing_sum(odd, starts, ends) * SHOUTS_PER_WORDS > words
    navigation = (words < NAVIGATION_WORDS) & ~_closing(buf, we[beyond - 1] - 1)
    furniture = np.zeros(len(starts), bool)
    if len(starts):
        hits = np.fromiter((m.start() for m in _PHRASES.finditer(K.LOWER[buf].tobytes())), np.int64)
        furniture[np.searchsorted(starts, hits, "right") - 1] = True
    failed = again | markup | shout | navigation | furniture & (words <= BOILERPLATE_WORDS)
    left = np.bincount(line_owner[~failed], weights=words[~failed], minlength=n).astype(np.int64)
    base_failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    figures = {
        "n_words": n_words, "word_chars": chars, "n_symbols": K.crossing_sum(symbol, chunk.off, chunk.off + chunk.size), "n_dup_lines": chunk.counts(line_owner[again]), "n_repeat_words": repeat,
        "base_failed": base_failed, "kept": ~base_failed & (100 * left >= KEEP_PERCENT * n_words), "n_lines_removed": chunk.counts(line_owner[failed]), "n_kept_words": left,
    }
    return figures, starts, ends, failed


def _cleaned(chunk: K.Chunk, starts: np.ndarray, ends: np.ndarray, failed: np.ndarray) -> list[str]:
    """Texts without their failed lines; the line feed after a removed line goes with it."""
    keep = np.ones(len(chunk.buf), bool)
    edge = np.zeros(len(chunk.buf) + 1, np.int32)
    np.add.at(edge, starts[failed], 1)
    np.add.at(edge, ends[failed] + 1, -1)
    keep = np.cumsum(edge)[:-1] == 0
    keep[chunk.off + chunk.size] = False  # the line feeds that chunks() put between texts
    cut = np.concatenate([[0], np.cumsum(keep)])
    data, lo, hi = chunk.buf[keep].tobytes(), cut[chunk.off], cut[chunk.off + chunk.size]
    return [data[a:b].decode("utf-8") for a, b in zip(lo, hi, strict=True)]


def line_first(docs: DataFrame) -> DataFrame:
    """One row of figures and verdicts per document."""
    schema = pa.schema([(c, pa.bool_() if c in ("base_failed", "kept") else pa.int64()) for c in [x.split()[0] for x in SCHEMA.split(", ")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(1)):
                figures, *_ = judge(chunk)
                ids = batch.column(0).slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(figures[c]) for c in schema.names[1:]]], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA)


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents that are kept, without their failed lines, in the columns of docs; n_chars follows the text."""
    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in K.chunks(batch.column(place)):
                figures, starts, ends, failed = judge(chunk)
                part = batch.slice(chunk.first, len(chunk))
                texts = pa.array(_cleaned(chunk, starts, ends, failed), part.schema.field(place).type)
                part = part.set_column(place, part.schema.field(place), texts)
                yield part.filter(pa.array(figures["kept"]))

    out = map_batches(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
