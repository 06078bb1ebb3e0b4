"""Vectorised word, line and n-gram hashing over Arrow string columns.

Texts are handled as UTF-8 bytes in chunks of a few MB, so memory is bounded by the
chunk (or by the longest single text).  A word is a maximal run of bytes other than
``\\x20`` and ``\\x09``-``\\x0D``; as these are all ASCII, the byte view gives the same
words as the code point view.  A null text has no words.

Hashes are 64-bit: a keyed polynomial over the bytes, finished by a mixer.  Equality of
hashes is used as equality of words; for v different words the chance of any clash is
about v*v / 3.7e19.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U = np.uint64
CHUNK_BYTES = 1 << 19
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_R = U(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_powers = [np.ones(1, U), np.ones(1, U)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            t = np.full(size, base, U)
            t[0] = 1
            _powers[k] = np.cumprod(t, dtype=U)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finisher."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets of the texts in them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]]
    return buf, off - off[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


class Words:
    """The words of a run of texts.

    start, end: byte positions; first: n_texts + 1 indexes of each text's first word;
    doc: the text that a word is of.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, space: np.ndarray = _SPACE):
        self.buf, self.off = buf, off
        n = len(buf)
        self.solid = solid = ~space[buf]
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0] = False
            before[1:] = solid[:-1]
            after[-1] = False
            after[:-1] = solid[1:]
            full = off[:-1][np.diff(off) > 0]
            before[full] = False
            after[full[1:] - 1] = False
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; equal bytes give equal hashes anywhere."""
    up, down = _power_tables(len(buf))
    sums = np.zeros(len(buf) + 1, U)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _R)


def run_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """As span_hashes, over runs of 64-bit values."""
    up, down = _power_tables(len(values))
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * _R)


def ngrams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the n-word windows that lie in one text, and their hashes."""
    total = len(h) - n + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    g = h[:total].copy()
    for j in range(1, n):
        g *= _R
        g += h[j : j + total]
    ok = np.ones(len(h), bool)
    for j in range(1, n):
        tail = first[1:] - j
        ok[tail[tail >= first[:-1]]] = False
    at = np.flatnonzero(ok[:total])
    return at, mix(g[at])


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of values over each run first[i]:first[i + 1]."""
    if values.dtype.kind != "f":
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[first[1:]] - total[first[:-1]]
    out = np.zeros(len(first) - 1)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full])
    return out


def pieces(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about limit bytes; a longer text stands alone."""
    if not batch.num_rows:
        return
    _, off = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def release() -> None:
    """Gives memory that Arrow and the C library keep for later back to the system; a worker lives on idle between stages, and executors count it."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def map_texts(df: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text", limit: int = CHUNK_BYTES) -> DataFrame:
    """mapInArrow with run on slices bounded by the bytes in their texts."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, column, limit):
                out = run(piece)
                if out is not None and out.num_rows:
                    yield out
            release()

    return df.mapInArrow(over, schema)
