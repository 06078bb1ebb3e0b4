"""SimHash near duplicates by anchor points of a covering code.

A fingerprint has 64 bits, each 1 if it is set in over half of the hashes of the text's shingles, repeats included.  Texts whose
fingerprints differ in two bits or fewer are linked.

Anchors are the words of the Hamming code of length 31, on 31 bits of each half of a fingerprint.  The code is perfect: every
half is within 1 bit of exactly one anchor, its home, so the covering radius is 1.  Of two differing bits one half has at most
one; so each fingerprint goes to every anchor within radius 1 plus threshold 1 of its halves, 16 at most for a half, and a
linked pair meets at the home of either.  (With one code over all 64 bits and a threshold of 2 it would go to some 650.)

Equal fingerprints are one before they are dealt.  At an anchor with few fingerprints all are held against each other; with many,
they meet by midpoints: two fingerprints differ in at most two bits exactly if some word is within one bit of both, so each has 65
words and the work is linear.  Anchors of more than `anchor_members` fingerprints are not held by one task at all: their
fingerprints are dealt by those words, of which none can have more than 65.  Tasks return a spanning forest of the links, never the
pairs; connected components of it are the groups.

Defined cases: a text with fewer words than a shingle is one shingle of all of them; null and empty texts, and those without words,
have fingerprint zero, which links like any other; a null doc_id counts for no component's name (a component of null ids alone has a null
name); repeated rows are in one component; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from linkloom.llm.common import written
from linkloom.llm.components import components
from linkloom.llm.neardup import joined, pairs_within
from linkloom.llm.tokens import U, Words, lower_ascii, map_texts, release, text_buffer

_SEED = 42  # fixed value
_SPACE = 0x20
_WITHIN = 2
_HASHED = 1 << 17
_LENGTH = 31
#: All words within one bit of a fingerprint, as masks.
_MIDS = np.concatenate([np.zeros(1, U), U(1) << np.arange(64, dtype=U)])


@dataclass(frozen=True)
class Covering:
    shingle: int = 3
    direct_members: int = 64
    anchor_members: int = 50_000
    broadcast_anchors: int = 1_000_000


def fingerprints(text: pa.Array, n: int) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers."""
    buf, off = text_buffer(text)
    w = Words(buf, off)
    ones = np.zeros((len(w.count), 64), np.int64)
    total = np.where(w.count > 0, np.maximum(w.count - n + 1, 1), 0)
    # One blank after each word: then a shingle is a run of the bytes, as it would be joined.
    keep = w.solid.copy()
    inside = w.end[w.end < len(buf)]
    keep[inside] = True
    place = np.cumsum(keep) - keep
    plain = lower_ascii(buf)
    plain[inside[~w.solid[inside]]] = _SPACE
    flat = plain[keep].tobytes()
    start, end = place[w.start] if len(w.start) else w.start, place[w.end - 1] + 1 if len(w.end) else w.end
    doc = np.repeat(np.arange(len(total)), total)
    first = np.repeat(w.first[:-1] - (np.cumsum(total) - total), total) + np.arange(len(doc))
    last = np.minimum(first + n, w.first[1:][doc]) - 1
    for k in range(0, len(doc), _HASHED):
        d, a, b = doc[k : k + _HASHED], start[first[k : k + _HASHED]].tolist(), end[last[k : k + _HASHED]].tolist()
        h = np.fromiter((xxh64_intdigest(flat[x:y], _SEED) for x, y in zip(a, b)), U, len(d))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lead = np.flatnonzero(np.diff(d, prepend=-1))
        ones[d[lead]] += np.add.reduceat(bits, lead, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.int64).reshape(-1)


def fingerprinted(docs: DataFrame, c: Covering = Covering()) -> DataFrame:
    """doc_id and fp of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints(batch.column("text"), c.shingle))], names=["doc_id", "fp"])

    return map_texts(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _flips() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the changes that lead to a code word within 2 bits, and how many there are."""
    out, n = np.zeros((_LENGTH + 1, 16), U), np.ones(_LENGTH + 1, np.int64)
    bit = lambda p: 1 << (p - 1)
    for s in range(1, _LENGTH + 1):
        masks = [bit(s), *(bit(i) | bit(i ^ s) for i in range(1, _LENGTH + 1) if i < i ^ s)]
        out[s, : len(masks)], n[s] = masks, len(masks)
    return out, n


_FLIPS, _N_FLIPS = _flips()


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every anchor within 2 bits of a half of each fingerprint, and the fingerprint's place; the anchor's half is its top bit."""
    found = []
    for half in (0, 1):
        word = (fp.view(U) >> U(32 * half)) & U((1 << _LENGTH) - 1)
        syndrome = np.zeros(len(fp), np.int64)
        for j in range(5):
            checked = sum(1 << (p - 1) for p in range(1, _LENGTH + 1) if p >> j & 1)
            syndrome |= (np.bitwise_count(word & U(checked)).astype(np.int64) & 1) << j
        n = _N_FLIPS[syndrome]
        of = np.repeat(np.arange(len(fp)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        found.append(((word[of] ^ _FLIPS[syndrome[of], nth]) | U(half << _LENGTH), of))
    return np.concatenate([x[0] for x in found]).view(np.int64), np.concatenate([x[1] for x in found])


def dealt(prints: DataFrame) -> DataFrame:
    """anchor and fp: each fingerprint at all its anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            anchor, of = anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(fp[of])], names=["anchor", "fp"])

    return prints.select("fp").mapInArrow(run, "anchor long, fp long")


def forest(anchor: np.ndarray, fp: np.ndarray, c: Covering) -> tuple[np.ndarray, np.ndarray]:
    """Edges that hold the linked fingerprints of whole anchors together; anchor is sorted."""
    lead = np.flatnonzero(np.diff(anchor, prepend=anchor[0] ^ 1))
    size = np.diff(np.append(lead, len(anchor)))
    met = np.repeat(size, size)
    names, at = np.unique(fp, return_inverse=True)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    few = np.flatnonzero((met > 1) & (met <= c.direct_members))
    for x, y in pairs_within(anchor[few]):
        x, y = few[x], few[y]
        hit = np.bitwise_count(fp[x].view(U) ^ fp[y].view(U)) <= _WITHIN
        a.append(at[x[hit]])
        b.append(at[y[hit]])
    for s, n in zip(lead[size > c.direct_members], size[size > c.direct_members]):
        x, y = by_midpoints(fp[s : s + n].view(U))
        a.append(at[s + x])
        b.append(at[s + y])
    root = joined(len(names), np.concatenate(a), np.concatenate(b))
    some = np.flatnonzero(root != np.arange(len(names)))
    return names[some], names[root[some]]


def by_midpoints(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all fingerprints within two bits, by the words that are within one bit of both."""
    words = (fp[:, None] ^ _MIDS).reshape(-1)
    order = np.argsort(words, kind="stable")
    words, of = words[order], order // len(_MIDS)
    same = words[1:] == words[:-1]
    return of[:-1][same], of[1:][same]


def links(prints: DataFrame, c: Covering = Covering()) -> DataFrame:
    """a, b: fingerprints (of distinct fp) joined by a spanning forest of the links of each task."""
    members = dealt(prints)
    crowded = written(members.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > c.anchor_members).select("anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(np.stack([batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()]))
            rows = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
            # The last anchor may go on in the next batch.
            to = rows.shape[1] if batch is None else int(np.searchsorted(rows[0], rows[0, -1])) if rows.shape[1] else 0
            held = [rows[:, to:]]
            if to:
                a, b = forest(rows[0, :to], np.ascontiguousarray(rows[1, :to]), c)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        release()

    if crowded.isEmpty():
        return members.repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(run, "a long, b long")
    crowd = F.broadcast(crowded) if crowded.count() <= c.broadcast_anchors else crowded
    rest = members.join(crowd, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor", "fp").mapInArrow(run, "a long, b long")
    return rest.unionAll(_crowded(members.join(crowd, "anchor", "left_semi").select("fp").distinct()))


def _crowded(prints: DataFrame) -> DataFrame:
    """As by_midpoints(), with each word's fingerprints brought together by a shuffle."""
    mids = F.array(*[F.lit(int(m)) for m in _MIDS.view(np.int64)])
    near = written(prints.select("fp", F.explode(mids).alias("mid")).select("fp", F.col("fp").bitwiseXOR(F.col("mid")).alias("word")))
    least = near.groupBy("word").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("word", "b")
    return near.join(least, "word").where("fp != b").select(F.col("fp").alias("a"), "b").distinct()


def simhash_groups(docs: DataFrame, c: Covering = Covering()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links lead to) of each document."""
    rows = written(fingerprinted(docs, c))
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("vertex", F.xxhash64("fp")))
    found = links(prints, c)
    # Vertices are hashed (one to one): neighbours differ in few bits, which would make long chains of minima.
    roots = components(found.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")))
    rooted = written(prints.join(roots, "vertex", "left").select("fp", "least", F.coalesce("root", "vertex").alias("root")))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = written(rooted.join(names, "root").select("fp", "component_id"))
    return rows.join(told, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
