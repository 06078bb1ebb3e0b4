"""Benchmark decontamination by BM25 with block-max WAND.

The test items are indexed; every passage of every training document is a query.  Passages are windows
of passage_words words that overlap by half, at least twice as long as the longest item, so each copy of an item lies
whole in one of them.  Scores are BM25 with the items as the collection, divided by the item's score for itself, so one
threshold fits all items.  All items at or above it are retrieved, in three steps that never lose one:

1. a passage is passed over if the sum of its terms' maxima stays below the threshold;
2. of the rest, items that hold only terms whose maxima add up to less than the threshold can't reach it, so only the other,
   essential, terms' blocks of items are candidates; a block is passed over if its own maxima add up to less;
3. the items of the blocks left are scored from their postings.

A retrieved item counts if its question and its answer both overlap with the passage: enough of either's
word trigrams occur in it; those of an answer are all that hold a word of it.  Where items have no answer of their own, the last sentence is the answer, or the
last third of the words of a single sentence.

This is block-max WAND over sets: its bounds, maxima of terms and of blocks, prune many passages at once, in place of a
pivot that moves through one query's postings.

The index is built by tasks, in blocks of items of about block_words words, as files in the shared folder.  In one pass over the
documents a worker holds one block at a time, so neither the driver nor a task holds more, whatever the benchmark's size.  Passages
are as long as the block's longest item asks.

Defined cases: null and empty texts, of documents or items, match nothing; an item without a term too; repeated rows are
each reported; an item that repeats another is reported beside it; empty tables give no row; further columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written
from linkloom.llm.tokens import CHUNK_BYTES, U, Words, map_texts, ngrams, pieces, text_buffer
from linkloom.llm.toxicity import _BREAK
from linkloom.session import shared_dir
from linkloom.sources.files import open_store


@dataclass(frozen=True)
class Search:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5
    question_overlap: float = 0.5
    answer_overlap: float = 0.5
    passage_words: int = 128
    block_items: int = 16
    block_words: int = 2_000_000
    slice_bytes: int = 32 << 20


def split_item(text: str) -> tuple[str, str]:
    """The question and the answer of an item."""
    text = text.strip()
    at = [m.end() for m in re.finditer(r"[.?!][\"')\]]*\s+", text)]
    if at:
        return text[: at[-1]], text[at[-1] :]
    words = text.split()
    cut = len(words) - max(1, len(words) // 3) if len(words) > 1 else len(words)
    return " ".join(words[:cut]), " ".join(words[cut:])


def _terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    w = Words(*_lowered(pa.array(texts, pa.string())), _BREAK)
    return w.hashes(), w.first


def _lowered(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower case in every script, as a leaked item may stand at another place in its sentence."""
    return text_buffer(pc.utf8_lower(text.cast(pa.large_string())))


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """The distinct n-grams of a run of words."""
    return np.unique(ngrams(h, np.array([0, len(h)]), n)[1])


def item_grams(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """n (3, or the words of a shorter item), the n-grams of the question, and those that hold a word of the answer."""
    question, answer = split_item(text)
    q, a = (_terms([x])[0] for x in (question, answer))
    h = np.concatenate([q, a])
    n = min(3, len(h))
    if not n:
        return 0, h, h
    return n, _grams(h[: max(len(q), n)], n), _grams(h[max(0, min(len(q), len(h) - 1) - n + 1) :], n)


def _ranges(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All positions of the ranges in turn, and the range of each."""
    n = stop - start
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + start[of], of


class Index:
    """Postings of (term, item) by term and item, with block maxima; impacts are shares of the item's own score."""

    def __init__(self, ids: list[int], texts: list[str | None], s: Search, df: dict[int, int] | None = None, n_items: int | None = None, mean: float | None = None):
        self.ids = np.array(ids, np.int64)
        h, first = _terms(texts)
        n = len(ids)
        item = np.repeat(np.arange(n), np.diff(first))
        self.vocabulary, term = np.unique(h, return_inverse=True)
        pair, tf = np.unique(term * max(n, 1) + item, return_counts=True)
        term, item = pair // max(n, 1), pair % max(n, 1)
        length = np.diff(first)
        mean = mean or max(1.0, length.mean() if n else 1.0)
        n_all = n_items or n
        d = np.bincount(term, minlength=len(self.vocabulary)) if df is None else np.array([df[int(v)] for v in self.vocabulary])
        idf = np.log(1 + (n_all - d + 0.5) / (d + 0.5))
        impact = idf[term] * tf * (s.k1 + 1) / (tf + s.k1 * (1 - s.b + s.b * length[item] / mean))
        own = np.bincount(item, impact, n)
        self.impact = impact / np.maximum(own[item], 1e-12) if n else impact
        self.item = item
        self.start = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        # Blocks: runs of block_items items; one entry for each term and block, in order.
        self.n_blocks = -(-n // s.block_items)
        key = term * max(1, self.n_blocks) + item // s.block_items
        self.block_key, lead = np.unique(key, return_index=True)
        self.block_max = np.maximum.reduceat(self.impact, lead) if len(key) else self.impact
        self.block_first = np.append(lead, len(key))
        self.block_start = np.searchsorted(self.block_key, np.arange(len(self.vocabulary) + 1) * max(1, self.n_blocks))
        self.term_max = np.maximum.reduceat(self.impact, self.start[:-1]) if len(key) else self.impact
        self.longest = int(length.max()) if n else 0
        self.overlap = [item_grams(t or "") for t in texts]

    def term_of(self, h: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at, -1)

    def retrieve(self, window: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (window, item, score) with a score of at least threshold; window, term: the distinct terms of each window."""
        threshold -= 1e-9
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(window):
            return none
        best = self.term_max[term]
        enough = np.bincount(window, best) >= threshold
        keep = enough[window]
        window, term, best = window[keep], term[keep], best[keep]
        if not len(window):
            return none
        order = np.lexsort((best, window))
        window, term, best = window[order], term[order], best[order]
        lead = np.searchsorted(window, window)
        sums = np.concatenate([[0.0], np.cumsum(best)])
        essential = sums[1:] - sums[lead] >= threshold
        nb = max(1, self.n_blocks)
        at, of = _ranges(self.block_start[term[essential]], self.block_start[term[essential] + 1])
        wanted = np.unique(window[essential][of] * nb + self.block_key[at] % nb)
        some = np.isin(window, wanted // nb)
        window, term = window[some], term[some]
        at, of = _ranges(self.block_start[term], self.block_start[term + 1])
        key = window[of] * nb + self.block_key[at] % nb
        place = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
        hit = wanted[place] == key
        at, place = at[hit], place[hit]
        full = np.bincount(place, self.block_max[at], len(wanted)) >= threshold
        at, place = at[full[place]], place[full[place]]
        p, of = _ranges(self.block_first[at], self.block_first[at + 1])
        n = max(1, len(self.ids))
        pair, back = np.unique(wanted[place[of]] // nb * n + self.item[p], return_inverse=True)
        score = np.bincount(back, self.impact[p], len(pair)) if len(pair) else np.zeros(0)
        good = score >= threshold
        return pair[good] // n, pair[good] % n, score[good]


def windows_of(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, first and last word of each passage: size words, every half of that; the last ends with the text."""
    half = size // 2
    length = np.diff(first)
    count = np.where(length > 0, np.maximum(1, -(-(length - half) // half)), 0)
    at, doc = _ranges(np.zeros(len(length), np.int64), count)
    start = first[doc] + at * half
    return doc, start, np.minimum(start + size, first[doc + 1])


def search(text: pa.Array, index: Index, s: Search) -> dict[tuple[int, int], tuple[float, float, float]]:
    """For each text and item with a verified passage, the best score and overlaps."""
    w = Words(*_lowered(text), _BREAK)
    h = w.hashes()
    term = index.term_of(h)
    size = max(s.passage_words, 2 * index.longest)
    size += size % 2
    doc, start, stop = windows_of(w.first, size)
    known = np.flatnonzero(term >= 0)
    lo, hi = np.searchsorted(known, start), np.searchsorted(known, stop)
    at, window = _ranges(lo, hi)
    n = max(1, len(index.vocabulary))
    pair = np.unique(window * n + term[known[at]])
    found: dict[tuple[int, int], tuple[float, float, float]] = {}
    for k, item, score in zip(*index.retrieve(pair // n, pair % n, s.threshold)):
        size_of, *parts = index.overlap[item]
        grams = _grams(h[start[k] : stop[k]], size_of)
        q, a = (float(np.isin(part, grams, assume_unique=True).mean()) if len(part) else 1.0 for part in parts)
        if q >= s.question_overlap and a >= s.answer_overlap:
            key = (int(doc[k]), int(item))
            found[key] = max(found.get(key, (0.0, 0.0, 0.0)), (float(score), q, a))
    return found


def build_index(items: DataFrame, s: Search) -> list[str]:
    """Writes the index of all items to the shared folder, a file for each block of about block_words words, and returns the files.

    Items are dealt to blocks by hash; term statistics are those of all items.  A task builds a block and renames its file
    when it is whole, so an attempt that is lost leaves nothing that is read.
    """
    spark = items.sparkSession
    size = F.size(F.split(F.trim("text"), r"\s+"))
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.trim("text") != "")
    words = rows.agg(F.sum(size)).first()[0] or 0
    if not words:
        return []
    n_blocks = -(-words // s.block_words)
    rows = written(rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))))
    folder = f"{shared_dir(spark)}/linkloom-index-{uuid.uuid4().hex}"
    store, top = open_store(folder)
    store.create_dir(top, recursive=True)

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            h, first = _terms(batch.column("text").to_pylist())
            item = np.repeat(np.arange(len(block)), np.diff(first))
            pair = np.unique(np.stack([item.astype(U), h]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(block[pair[0].astype(np.int64)]), pa.array(pair[1].view(np.int64)), pa.array(np.ones(pair.shape[1], np.int64))], names=["block", "term", "df"])
            lead, count = np.unique(block, return_counts=True)  # the rows of no term hold each block's sums
            yield pa.RecordBatch.from_arrays([pa.array(lead), pa.nulls(len(lead), pa.int64()), pa.array(np.bincount(np.searchsorted(lead, block), np.diff(first)).astype(np.int64))], names=["block", "term", "df"])

    told = written(rows.mapInArrow(terms, "block long, term long, df long").groupBy("block", "term").agg(F.sum("df").alias("df")))
    total = told.where("term is null").agg(F.sum("df")).first()[0] or 0
    count = rows.count()
    every = told.where("term is not null").groupBy("term").agg(F.sum("df").alias("all_df"))
    known = told.where("term is not null").select("block", "term").join(every, "term")

    def build(own: pa.Table, known: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"path": pa.array([], pa.string())})
        own = own.sort_by([("item_id", "ascending"), ("text", "ascending")])
        df = dict(zip(known.column("term").to_numpy().view(U).tolist(), known.column("all_df").to_pylist()))
        index = Index(own.column("item_id").to_pylist(), own.column("text").to_pylist(), s, df, count, max(1.0, total / count))
        name = f"{own.column('block')[0].as_py():06d}"
        store, top = open_store(folder)
        attempt = f"{top}/_{name}-{uuid.uuid4().hex}.tmp"
        with store.open_output_stream(attempt, compression=None) as out:
            out.write(pickle.dumps(index, protocol=5))
        store.move(attempt, f"{top}/{name}.index")
        return pa.table({"path": [f"{folder}/{name}.index"]})

    made = rows.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(build, "path string")
    return sorted(r.path for r in written(made).collect())  # a name for each block


@lru_cache(1)
def _load(path: str) -> Index:
    """A block's index; a worker holds one at a time."""
    store, at = open_store(path)
    with store.open_input_stream(at, compression=None) as stream:
        return pickle.loads(stream.read())


def _searching(docs: DataFrame, paths: list[str], s: Search, text: str, run: Callable[[pa.RecordBatch, Iterator[tuple[Index, dict]]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """run over slices of docs with each block's index and what is found by it, in one pass over docs.

    With several blocks slices are large, as a task reads every block for each of them.
    """

    def found(batch: pa.RecordBatch) -> Iterator[tuple[Index, dict]]:
        for path in paths:
            index = _load(path)
            out: dict = {}
            at = 0
            for piece in pieces(batch, text):
                out |= {(at + k, item): v for (k, item), v in search(piece.column(text), index, s).items()}
                at += piece.num_rows
            yield index, out

    return map_texts(docs, lambda batch: run(batch, found(batch)), schema, text, CHUNK_BYTES if len(paths) < 2 else s.slice_bytes)


def contaminated(docs: DataFrame, items: DataFrame, s: Search = Search(), text: str = "text") -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of each document and item with a verified passage."""
    rows = docs.select("doc_id", text)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id long, score double, question_overlap double, answer_overlap double"

    def run(batch: pa.RecordBatch, blocks: Iterator[tuple[Index, dict]]) -> pa.RecordBatch | None:
        at, ids, values = [], [], []
        for index, found in blocks:
            for (k, item), v in sorted(found.items()):
                at.append(k)
                ids.append(int(index.ids[item]))
                values.append(v)
        if not at:
            return None
        parts = [batch.column("doc_id").take(pa.array(at)), pa.array(ids, pa.int64()), *(pa.array([v[i] for v in values]) for i in range(3))]
        return pa.RecordBatch.from_arrays(parts, names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

    return _searching(rows, build_index(items, s), s, text, run, schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, s: Search = Search()) -> DataFrame:
    """The documents without a verified passage of any item, in docs' columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(columns))])

    def run(batch: pa.RecordBatch, blocks: Iterator[tuple[Index, dict]]) -> pa.RecordBatch:
        keep = np.ones(batch.num_rows, bool)
        for _, found in blocks:
            keep[[k for k, _ in found]] = False
        return batch.filter(pa.array(keep))

    return _searching(plain, build_index(items, s), s, f"_{columns.index('text')}", run, plain.schema).toDF(*columns)
