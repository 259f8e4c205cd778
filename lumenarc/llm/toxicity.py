"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on windows of ordinary text and one, a third of the texts at a time,
on windows of toxic text. What is common to both says nothing, so the pieces of the toxic dictionary are held against
toxic and ordinary texts that they were not trained on: it is trimmed to those that stand far more often in toxic ones
than chance allows, and goes before the ordinary one.
Each window of eight words is compressed with either; the bytes that the toxic one saves are its gain. How
many windows pass each of several thresholds is calibrated by a logistic curve on the sample, which turns a text's gains into a score.

Learning takes a bounded sample of the labelled rows (SAMPLE of each class, by hash of the id, of those whose id does
not hash to the held-out quarter) and only its texts and labels; scoring reads nothing but the text.

Nulls: a null text is empty and scores as a text without gains; rows with a null label or id are not learned from, and
of several labels of an id the highest counts. Without labels of both classes every score is 0. Repeated rows give
repeated results; ties cannot arise. Long texts are scored whole; an empty table gives no rows. Extra columns of either
table, also clashing ones, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows learned from, at most: toxic, ordinary.
SAMPLE = (2000, 4000)
WINDOW = 8
LEVEL = 9
#: Bytes of each trained dictionary, of a segment chosen by training, and of the pieces that are held against texts.
DICTIONARY_BYTES, SEGMENT, PIECE = 32768, 40, 8
#: A piece stays that has so many times the odds in toxic texts, in so many of them, and such a likelihood ratio at least.
ODDS, LEAST, RATIO = 12, 3, 20.0
#: Bytes of a piece's surroundings, on either side.
AROUND = 32
GAINS = (1, 2, 3, 4, 5, 6)
THRESHOLD = 0.3
HELD_OUT = (4, 2)
#: What stands between the words of a window.
RIFT = b"    "
RIM = b".,;:!?\"'()#*$%&|"
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: What stands before the segments in a trained dictionary: its last fixed values, three offsets.
_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % HELD_OUT[0] == HELD_OUT[1]


def words(text: str | None) -> list[bytes]:
    return [w.strip(RIM) for w in (text or "").encode("utf-8").lower().split()]


def spaced(w: list[bytes]) -> bytes:
    """Words with a wide rim each, so that a short word and its rims fill a piece, whatever stands beside it."""
    return RIFT + RIFT.join(w) + RIFT


def windows(text: str | None) -> list[bytes]:
    w = words(text)
    return [spaced(w[i : i + WINDOW]) for i in range(0, len(w), WINDOW)]


def dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """The content of a dictionary trained on the samples, the most frequent last; samples too few to train on are repeated."""
    samples = sorted(samples, key=lambda w: (_shuffled(w), w))
    for times in (4**k for k in range(6) if samples):
        try:
            trained = zstandard.train_dictionary(size, samples * times, k=SEGMENT, d=PIECE).as_bytes()
        except zstandard.ZstdError:
            continue
        if _OFFSETS not in trained:
            raise ValueError("a trained dictionary without its fixed offsets")
        return trained.partition(_OFFSETS)[2]
    if samples:
        raise ValueError("no dictionary can be trained on the samples")
    return b""


def _digest(around: bytes) -> int:
    return zlib.crc32(around) << 32 | zlib.adler32(around)


def _shuffled(window: bytes) -> int:
    """An order without regard to content, as training looks for segments part by part."""
    return zlib.crc32(window)


def telling(pieces: set[bytes], toxic: list[str], ordinary: list[str]) -> set[bytes]:
    """Pieces that stand in toxic texts far more often than chance allows.

    A piece counts once a text, and only where its surroundings are new: neither copies of a text, near or exact, nor
    the vocabulary of one long text add up.
    """

    def standing(texts: list[str], pieces: set[bytes], most: dict[bytes, float] | None = None) -> Counter:
        """Texts of each piece; pieces that stand in more than `most` of them are sought no further."""
        seen, n = set(), Counter()
        for text in texts:
            line = spaced(words(text))
            here = {_digest(line[max(0, i - AROUND) : i + PIECE + AROUND]): line[i : i + PIECE] for i in range(len(line) - PIECE + 1) if line[i : i + PIECE] in pieces}
            fresh = {p for around, p in here.items() if around not in seen}
            n.update(fresh)
            seen.update(here)
            if most:
                pieces -= {p for p in fresh if n[p] > most[p]}
        return n

    a = Counter({p: n for p, n in standing(toxic, pieces).items() if n >= LEAST})
    share, out = len(toxic) / max(1, len(toxic) + len(ordinary)), set()
    b = standing(ordinary, set(a), {p: n * (1 - share) / (ODDS * share) for p, n in a.items()})  # beyond that its odds are too small
    for p, n in a.items():
        rest = b[p]
        if n / (n + rest) > ODDS * share / (1 + (ODDS - 1) * share):
            g = 2 * (n * math.log(n / ((n + rest) * share)) + (rest * math.log(rest / ((n + rest) * (1 - share))) if rest else 0))
            if g > RATIO:
                out.add(p)
    return out


def trimmed(trained: bytes, toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """What is left of a trained dictionary where it consists of telling pieces."""
    at = range(len(trained) - PIECE + 1)
    kept = telling({trained[i : i + PIECE] for i in at}, toxic, ordinary)
    out, end = [], -1
    for i in at:
        if trained[i : i + PIECE] in kept:
            out += [trained[i : i + PIECE]] if i >= end else [out.pop() + trained[end : i + PIECE]]
            end = i + PIECE
    return out


class Scorer:
    """Both dictionaries and the curve; small, and sent to the executors as it is."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray | None = None):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights
        self.pad = ordinary[-64:]  # both know it: short windows still compress, and none ends where zstandard no longer looks for matches
        self._compress: list = []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_compress": []}

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on every window."""
        if not self._compress:
            for content in (self.ordinary, self.toxic):
                d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=LEVEL)
                self._compress.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        plain, toxic = self._compress
        padded = [self.pad + w + self.pad for w in windows(text)]
        return np.array([len(plain(x)) - len(toxic(x)) for x in padded], float)

    def features(self, text: str | None) -> np.ndarray:
        g = self.gains(text)
        if not len(g):
            return np.array([1.0] + [0.0] * (2 * len(GAINS) + 2))
        passed = [x for t in GAINS for x in (2 * math.log1p((g >= t).sum()), 10 * (g >= t).mean())]
        return np.array([1.0, *passed, 4 * math.log1p(max(0.0, g.max())), 10 * math.tanh(g.mean())])

    def score(self, text: str | None) -> float:
        return 0.0 if self.weights is None else float(1 / (1 + math.exp(-max(-30.0, min(30.0, self.features(text) @ self.weights)))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge * w
        hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    return w


def fitted(toxic: list[str], ordinary: list[str]) -> Scorer:
    """The scorer of two classes of texts.

    A dictionary is trained on each third of the toxic texts and trimmed by the others; what is left of all three is the
    toxic dictionary. Without texts of both classes there is nothing to learn.
    """
    if not toxic or not ordinary:
        return Scorer(b"", b"")
    base = dictionary(sorted({w for t in ordinary for w in windows(t)})).rjust(64)
    kept: dict[bytes, None] = {}
    for i in range(3):
        trained = dictionary(sorted({w for t in toxic[i::3] for w in windows(t)}))
        kept |= dict.fromkeys(trimmed(trained, *([t for j, t in enumerate(texts) if j % 3 != i] for texts in (toxic, ordinary))))
    out = Scorer(base, b"".join(kept) + base)
    x = np.array([out.features(t) for t in toxic + ordinary])
    out.weights = _logistic(x, np.array([1.0] * len(toxic) + [0.0] * len(ordinary)), 3.0)
    return out


def sample(docs: DataFrame, labels: DataFrame, sizes: tuple[int, int] = SAMPLE) -> tuple[list[str], list[str]]:
    """Texts of the sampled toxic and ordinary rows; at most sum(sizes) rows reach the driver."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = (F.md5(F.col("doc_id").cast("string")), "doc_id")
    picked = known.where("toxic = 1").orderBy(*order).limit(sizes[0]).unionByName(known.where("toxic = 0").orderBy(*order).limit(sizes[1]))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])
    rows = sorted(rows.select("doc_id", "toxic", "text").collect())
    return [r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0]


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and prediction of every document."""
    scorer = fitted(*sample(docs, labels))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([scorer.score(t.as_py()) for t in batch.column(2)], float)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)
