"""NumPy work on the texts of one Arrow batch: words, lines and hashes without a Python loop per word.

Texts are laid end to end in one byte array, each followed by a line feed, so that neither words nor
lines run from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
LF = 10
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = U64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 21)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(have, out=have)
        if n <= 1 << 21:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (constants of the public splitmix64 generator)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class Chunk:
    """Some consecutive texts of a batch. buf: all bytes; off, size: where each text starts and its bytes."""

    def __init__(self, first: int, buf: np.ndarray, off: np.ndarray, size: np.ndarray):
        self.first, self.buf, self.off, self.size = first, buf, off, size

    def __len__(self) -> int:
        return len(self.size)

    def words(self, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every word, in order."""
        space = IS_SPACE[self.buf if buf is None else buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        return starts, ends, np.searchsorted(self.off, starts, "right") - 1

    def counts(self, owner: np.ndarray) -> np.ndarray:
        return np.bincount(owner, minlength=len(self)).astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and len + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def chunks(col: pa.Array, target: int = 1 << 20) -> Iterator[Chunk]:
    """Whole texts in groups of about target bytes."""
    buf, off = text_bytes(col)
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + target, "right")) - 1)
        part, size = buf[off[i] : off[j]], np.diff(off[i : j + 1])
        joined = np.insert(part, off[i + 1 : j + 1] - off[i], LF)
        yield Chunk(i, joined, np.concatenate([[0], np.cumsum(size + 1)[:-1]]).astype(np.int64), size)
        i = j


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    n = len(buf)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum((buf.astype(U64) + U64(1)) * _power("up", _BASE, n), out=total[1:])
        out = (total[ends] - total[starts]) * _power("down", _BASE_INV, n + 1)[starts]
        return mix(out + (ends - starts).astype(U64) * _STEP)


def window_hash(items: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k items with one owner, and the index of its first item."""
    n = len(items) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[: n] == owner[k - 1 :])
    with np.errstate(over="ignore"):
        out = np.zeros(n, dtype=U64)
        for j in range(k):
            out = out * _STEP + items[j : n + j]
    return mix(out[at]), at


def crossing_sum(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values over each span [start, end)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie in a window of this width that begins at one of starts."""
    edge = np.zeros(n + width + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0
