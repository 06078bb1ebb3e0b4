"""Scoring texts with an n-gram model held in a log-frequency Bloom filter.

Texts are cut into chunks of some MB.  A chunk deals its distinct n-grams, as sorted hashes with how often learnt texts hold
them, over segments of the hash range.  A segment adds the counts up; a count c is quantised to the level
1 + floor(log_base(c)), and the n-gram is entered in the segment's slice of the filter once for each level up to its own.
A lookup probes level after level until one is missing, which gives the quantised count.  A slice has `bits_per_entry` for each
entry, so the filter grows with the corpus and holds every n-gram.

Model: p(w | h) = (c(h w) + mu * p(w | h')) / (c(h) + mu), with h' the history less its first
word, over quantised counts, held at 1 at most; at the bottom p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)).

A corpus of at most `broadcast_bytes` has a filter of some MB, which is broadcast with the exact word counts; texts then are scored
where they lie.  A filter that holds every n-gram of a larger corpus is no broadcast (about a byte for each word of the corpus): there
the chunks' hashes, which come to the segments to be counted, are looked up in the slice at once, and the levels go
back to the chunk.  Nothing but a row for each segment, of two sums, comes to the driver then.  Both ways give the same scores.

Hashes of single words have 64 bits, so the base score is exact; those of longer n-grams have 48, which confuses one in 280,000
at a thousand million n-grams, where the filter takes one in forty for another.

Defined cases: a null text is empty and has its end token alone; an empty table or one
without training rows gives c = N = V = 0, where the base score has p = 1 for each token;
repeated rows are each scored; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import crc_mod, written
from linkloom.llm.tokens import U, Words, lower_ascii, map_texts, mix, ngrams, pieces, release, sums_by, text_buffer

_BEGIN, _END = U(0x51ED270B7F4A1C35), U(0x2545F4914F6CDD1D)
_SHORT = U(16)  # bits that hashes of several words lack


@dataclass(frozen=True)
class Settings:
    order: int = 3
    base: float = 1.4142135623730951
    mu: float = 80.0
    bits_per_entry: int = 8
    probes: int = 4
    broadcast_bytes: int = 16 << 20
    segment_bytes: int = 4 << 20
    segments: int = 16
    chunk_bytes: int = 6 << 20


@dataclass(frozen=True)
class Model:
    """bits: the slices of the filter, the k-th from bit start[k] on; words, counts: the exact counts of single words, sorted by hash."""

    settings: Settings
    bits: np.ndarray
    start: np.ndarray
    words: np.ndarray
    counts: np.ndarray

    @property
    def tokens(self) -> int:
        return int(self.counts.sum())

    def levels(self, h: np.ndarray) -> np.ndarray:
        """The quantised level of each n-gram hash; 0: not in the filter."""
        k = segment_of(h, len(self.start) - 1)
        return probed(self.bits, h, self.start[k], self.start[k + 1] - self.start[k], self.settings)


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    return ((h >> U(32)) * U(segments) >> U(32)).astype(np.int64)


def positions(h: np.ndarray, level: int, start: np.ndarray, size: np.ndarray, probes: int) -> Iterator[np.ndarray]:
    """The filter's bits for the n-grams at a level, in slices of those starts and sizes."""
    a = mix(h + U(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    b = mix(a ^ U(0xA0761D6478BD642F)) | U(1)
    for k in range(probes):
        yield start + ((a + U(k) * b) % size.astype(U)).astype(np.int64)


def probed(bits: np.ndarray, h: np.ndarray, start: np.ndarray, size: np.ndarray, s: Settings) -> np.ndarray:
    """The level of each hash, by membership probes at one level after the other."""
    out = np.zeros(len(h), np.int64)
    at = np.arange(len(h))
    level = 1
    while len(at):
        seen = np.ones(len(at), bool)
        for where in positions(h[at], level, start[at], size[at], s.probes):
            seen &= (bits[where >> 3] >> (where & 7).astype(np.uint8)) & 1 != 0
        at = at[seen]
        out[at] = level
        level += 1
    return out


def middle(level: np.ndarray, s: Settings) -> np.ndarray:
    """The middle of the range of counts that each level stands for."""
    low = np.ceil(s.base ** np.maximum(level - 1, 0) - 1e-9)
    high = np.maximum(np.ceil(s.base ** np.maximum(level, 0) - 1e-9) - 1, low)
    return np.where(level > 0, (low + high) / 2, 0.0)


def levels_of(c: np.ndarray, s: Settings) -> np.ndarray:
    return np.floor(np.log(c) / np.log(s.base) + 1e-9).astype(np.int64) + 1


def tokens_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of begin, words and end of every text in turn, and the texts' n + 1 offsets in them."""
    buf, off = text_buffer(text)
    w = Words(lower_ascii(buf), off)
    n = len(off) - 1
    first = w.first + 2 * np.arange(n + 1)
    out = np.empty(first[-1], U)
    out[np.arange(len(w.start)) + 2 * w.doc + 1] = w.hashes()
    out[first[:-1]] = _BEGIN
    out[first[1:] - 1] = _END
    return out, first


def grams_of(tokens: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each n-gram of a text's tokens; a single begin mark is none."""
    at, h = ngrams(tokens, first, n)
    if n == 1:
        word = tokens[at] != _BEGIN
        return at[word], tokens[at][word]
    return at, mix(h + U(n)) >> _SHORT << _SHORT


def _packed(h: np.ndarray) -> bytes:
    """Ascending distinct hashes: the width of a step, the first hash, and the steps between them byte by byte, the high ones of which compress."""
    if not len(h):
        return b""
    step = np.diff(h)
    width = (int(step.max()).bit_length() + 7) // 8 if len(step) else 0
    return bytes([width]) + h[:1].astype("<u8").tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U)
    width = data[0]
    n = (len(data) - 9) // width if width else 0
    out = np.zeros((n + 1, 8), np.uint8)
    out[0] = np.frombuffer(data, np.uint8, 8, 1)
    if n:
        out[1:, :width] = np.frombuffer(data, np.uint8, offset=9).reshape(width, n).T
    return np.cumsum(out.view("<u8").ravel(), dtype=U)


def _narrow(c: np.ndarray) -> bytes:
    """Counts as one byte each where they fit, else eight; the length tells which."""
    return (c.astype(np.uint8) if not len(c) or c.max() < 256 else c.astype(np.int64)).tobytes()


def _wide(c: bytes, n: int) -> np.ndarray:
    return np.frombuffer(c, np.uint8 if len(c) == n else np.int64).astype(np.int64)


def _shift(n: int) -> np.uint64:
    return _SHORT if n > 1 else U(0)


def chunked(rows: DataFrame, s: Settings) -> DataFrame:
    """chunk and piece: the rows in runs of about chunk_bytes of text, each a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def one() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=options) as writer:
                writer.write_batch(whole)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "piece"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                held.append(piece)
                size += int(text_buffer(piece.column("text"))[1][-1])
                if size >= s.chunk_bytes:
                    yield one()
                    number, held, size = number + 1, [], 0
            release()
        if held:
            yield one()

    return rows.mapInArrow(run, "chunk long, piece binary")


def _piece(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def sent(chunks: DataFrame, s: Settings, segments: int) -> DataFrame:
    """segment, chunk, and for n = 1, 2, ... the distinct hashes of the chunk's n-grams and how often its learnt texts hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("chunk"), batch.column("piece")):
                piece = _piece(data.as_py())
                tokens, first = tokens_of(piece.column("text"))
                learn = np.repeat(piece.column("learn").to_numpy(zero_copy_only=False).astype(bool), np.diff(first))
                cuts, hashes, counts = [], [], []
                for n in range(1, s.order + 1):
                    at, g = grams_of(tokens, first, n)
                    order = np.argsort(g)
                    g, own = g[order], learn[at[order]]
                    lead = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
                    h, c = g[lead], np.add.reduceat(own.astype(np.int64), lead) if len(g) else np.zeros(0, np.int64)
                    cut = np.searchsorted(segment_of(h, segments), np.arange(segments + 1))
                    cuts.append(np.diff(cut))
                    hashes.append([_packed(h[x:y] >> _shift(n)) for x, y in zip(cut[:-1], cut[1:])])
                    counts.append([_narrow(c[x:y]) for x, y in zip(cut[:-1], cut[1:])])
                some = np.flatnonzero(np.sum(cuts, 0))
                kind = pa.list_(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([number.as_py()] * len(some), pa.int64()), pa.array([[p[k] for p in hashes] for k in some], kind), pa.array([[p[k] for p in counts] for k in some], kind)], names=["segment", "chunk", "h", "c"])
            release()

    return chunks.mapInArrow(run, "segment int, chunk long, h array<binary>, c array<binary>")


def _asked(group: pa.Table, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The hashes and counts of n-grams in each row of a segment."""
    h = [_unpacked(x[n - 1]) << _shift(n) for x in group.column("h").to_pylist()]
    return h, [_wide(x[n - 1], len(y)) for x, y in zip(group.column("c").to_pylist(), h)]


def slice_of(group: pa.Table, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment's slice of the filter, and the hashes and exact counts of its words."""
    known, entries = [], 0
    for n in range(1, s.order + 1):
        h, c = (np.concatenate(x) for x in _asked(group, n))
        h, c = h[c > 0], c[c > 0]
        order = np.argsort(h)
        h, c = h[order], c[order]
        if len(h):
            lead = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            h, c = h[lead], np.add.reduceat(c, lead)
        known.append((h, c))
        entries += int(levels_of(c, s).sum())
    bits = np.zeros(max(1, -(-entries * s.bits_per_entry // 8)), np.uint8)
    for h, c in known:
        level = levels_of(c, s)
        k = 1
        while len(h):
            for where in positions(h, k, np.zeros(len(h), np.int64), np.full(len(h), 8 * len(bits)), s.probes):
                np.bitwise_or.at(bits, where >> 3, np.left_shift(np.uint8(1), (where & 7).astype(np.uint8)))
            h, level = h[level > k], level[level > k]
            k += 1
    return bits, *known[0]


def segments_for(rows: DataFrame, s: Settings, text: str = "text") -> tuple[int, int]:
    """The bytes of all texts, and the number of segments for them."""
    size = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return size, max(s.segments, -(-size // s.segment_bytes))


def fit(train: DataFrame, s: Settings = Settings(), segments: int | None = None) -> Model:
    """The model of the texts, for a corpus whose filter may be broadcast."""
    segments = segments or segments_for(train, s)[1]
    rows = train.select(F.lit(True).alias("learn"), "text")

    def total(group: pa.Table) -> pa.Table:
        bits, h, c = slice_of(group, s)
        release()
        return pa.table({"segment": group.column("segment")[:1], **{k: pa.array([x], pa.binary()) for k, x in (("bits", bits.tobytes()), ("h", h.tobytes()), ("c", c.tobytes()))}})

    found = {r.segment: r for r in sent(chunked(rows, s), s, segments).groupBy("segment").applyInArrow(total, "segment int, bits binary, h binary, c binary").toLocalIterator()}
    parts = [np.frombuffer(found[k].bits, np.uint8) if k in found else np.zeros(1, np.uint8) for k in range(segments)]
    h, c = (np.concatenate([np.frombuffer(found[k][x], t) for k in sorted(found)] or [np.zeros(0, t)]) for x, t in (("h", U), ("c", np.int64)))
    order = np.argsort(h)
    return Model(s, np.concatenate(parts), np.cumsum([0, *(8 * len(p) for p in parts)]), h[order], c[order])


def model_log10(tokens: np.ndarray, first: np.ndarray, counts: list[np.ndarray], n_tokens: int, n_words: int, begins: float, s: Settings) -> np.ndarray:
    """log10 p of each text; counts: the quantised counts of the texts' n-grams for n = 1, 2, ...; begins: that of an end, as there are as many begins."""
    p = history = None
    for n, c in enumerate(counts, 1):
        full = np.full(len(tokens), -1.0)
        full[grams_at(tokens, first, n) + n - 1] = c
        if n == 1:
            p = (full + 0.1) / (n_tokens + 0.1 * (n_words + 1))
            history = full
            history[first[:-1]] = begins
        else:
            past = np.zeros(len(tokens))
            past[1:] = history[:-1]
            low = p
            p = np.where(full >= 0, np.minimum(1.0, (np.maximum(full, 0) + s.mu * low) / (np.maximum(past, 0) + s.mu)), low)
            history = full
    word = np.ones(len(tokens), bool)
    word[first[:-1]] = False
    return sums_by(np.log10(np.where(word, np.maximum(p, 1e-300), 1.0)), first)


def grams_at(tokens: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The starts of the n-grams, as grams_of gives them."""
    if n == 1:
        return np.flatnonzero(tokens != _BEGIN)
    at = np.arange(len(tokens))
    return at[at + n <= np.repeat(first[1:], np.diff(first))]


def lookup(keys: np.ndarray, counts: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, counts[at], 0)


_OUT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _columns(tokens: np.ndarray, first: np.ndarray, exact: np.ndarray, quantised: list[np.ndarray], n_tokens: int, n_words: int, begins: float, s: Settings) -> list[pa.Array]:
    """The columns of _OUT, from the exact counts of all words and ends and the quantised ones of all n-grams."""
    at = first - np.arange(len(first))
    logs = np.log10((exact + 0.1) / (n_tokens + 0.1 * (n_words + 1)))
    n = len(first) - 1
    return [pa.array(x) for x in (np.diff(at), sums_by(exact > 0, at), np.full(n, n_tokens), sums_by(logs, at), model_log10(tokens, first, quantised, n_tokens, n_words, begins, s))]


def score(docs: DataFrame, m: Model) -> DataFrame:
    """docs' columns but the text, with n_tokens, n_known, train_tokens, base_score and score, by the broadcast model."""
    carry = [c for c in docs.columns if c != "text"]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        s = m.settings
        tokens, first = tokens_of(batch.column("text"))
        quantised = []
        for n in range(1, s.order + 1):
            unique, back = np.unique(grams_of(tokens, first, n)[1], return_inverse=True)
            quantised.append(middle(m.levels(unique), s)[back])
            if n == 1:
                exact = lookup(m.words, m.counts, unique)[back]
        begins = float(middle(m.levels(np.array([_END])), s)[0])
        out = _columns(tokens, first, exact, quantised, m.tokens, len(m.words), begins, s)
        return pa.RecordBatch.from_arrays([*(batch.column(x) for x in carry), *out], names=[*carry, *(x.split()[0] for x in _OUT.split(", "))])

    return map_texts(docs, run, f"{head}, {_OUT}")


def _tasks(rows: DataFrame, groups: int) -> int:
    """Tasks that grow with the number of groups, as AQE only makes fewer."""
    return max(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def score_by_slices(rows: DataFrame, s: Settings, segments: int) -> DataFrame:
    """As score(), under the model of the rows that learn says, for a corpus of any size; rows: any columns, learn and text."""
    carry = [c for c in rows.columns if c not in ("text", "learn")]
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema)
    chunks = written(chunked(rows, s))

    def meet(group: pa.Table) -> pa.Table:
        bits, words, counts = slice_of(group, s)
        levels, exact = [], []
        for n in range(1, s.order + 1):
            asked, _ = _asked(group, n)
            h = np.concatenate(asked)
            cuts = np.cumsum([len(x) for x in asked])[:-1]
            found = probed(bits, h, np.zeros(len(h), np.int64), np.full(len(h), 8 * len(bits)), s).astype(np.uint8)
            levels.append([x.tobytes() for x in np.split(found, cuts)])
            if n == 1:
                exact = [_narrow(x) for x in np.split(lookup(words, counts, h), cuts)]
        release()
        told = {
            "chunk": (pa.int64(), [*group.column("chunk").to_pylist(), None]), "segment": (pa.int32(), group.column("segment").to_pylist() + [group.column("segment")[0].as_py()]),
            "levels": (pa.list_(pa.binary()), [*map(list, zip(*levels)), None]), "c": (pa.binary(), [*exact, None]),
            "tokens": (pa.int64(), [None] * len(exact) + [int(counts.sum())]), "words": (pa.int64(), [None] * len(exact) + [len(words)]),
        }
        return pa.table({k: pa.array(v, t) for k, (t, v) in told.items()})

    # A row for each chunk and segment, and one with the segment's sums.
    found = written(sent(chunks, s, segments).repartition(_tasks(rows, segments), "segment").groupBy("segment").applyInArrow(meet, "chunk long, segment int, levels array<binary>, c binary, tokens long, words long"))
    n_tokens, n_words = (int(x or 0) for x in found.where("chunk is null").agg(F.sum("tokens"), F.sum("words")).first())

    def judge(of: pa.Table, told: pa.Table) -> pa.Table:
        piece = _piece(of.column("piece")[0].as_py())
        tokens, first = tokens_of(piece.column("text"))
        told = told.sort_by("segment")
        parts = told.column("levels").to_pylist()
        quantised = []
        for n in range(1, s.order + 1):
            level = np.frombuffer(b"".join(x[n - 1] for x in parts), np.uint8).astype(np.int64)
            unique, back = np.unique(grams_of(tokens, first, n)[1], return_inverse=True)
            quantised.append(middle(level, s)[back])
            if n == 1:
                begins = float(middle(level, s)[np.searchsorted(unique, _END)])
                exact = np.concatenate([_wide(c, len(x[0])) for c, x in zip(told.column("c").to_pylist(), parts)])[back]
        out = _columns(tokens, first, exact, quantised, n_tokens, n_words, begins, s)
        release()
        return pa.table([*(piece.column(x) for x in carry), *out], names=[*carry, *(x.split()[0] for x in _OUT.split(", "))])

    replies = found.where("chunk is not null").select("chunk", "segment", "levels", "c")
    n = _tasks(rows, chunks.count())
    return chunks.repartition(n, "chunk").groupBy("chunk").cogroup(replies.repartition(n, "chunk").groupBy("chunk")).applyInArrow(judge, f"{head}, {_OUT}")


def lm_scores(docs: DataFrame, s: Settings = Settings(), folds: int = 10) -> DataFrame:
    """Scores of every document under the model of those whose crc32(doc_id as text) mod folds is not 0."""
    held = (crc_mod(F.col("doc_id"), folds) == 0).alias("held_out")
    rows = docs.select("doc_id", held, "text")
    size, segments = segments_for(rows, s)
    if size <= s.broadcast_bytes:
        return score(rows, fit(rows.where(~F.col("held_out")), s, segments))
    return score_by_slices(rows.select("doc_id", "held_out", "text", (~F.col("held_out")).alias("learn")), s, segments)
