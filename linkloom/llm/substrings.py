"""Removing repeated passages with FM-indexes of the parts of texts that repeat.

A window is `window` consecutive words.  A word is removed if a window covers it whose words also start earlier: at a
smaller doc_id, or at an earlier word of the same.  Windows are judged on the input.

Windows are dealt to shards by content.  In a window the least hash of its `anchor`-word runs, leftmost of equals, is its
anchor; equal windows have equal anchors, at equal places.  A segment is the words under all consecutive windows of a text with one
anchor.  So a repeated window can only be found among segments of one anchor:

* anchors that occur once are let go after a count;
* equal segments are one content, with its earliest place and its times, summed before the shuffle, so copies, however many,
  are streamed once;
* every content goes, with its words, to the shard of its anchor.  The shard builds an FM-index of its contents and streams them
  against it: backward search over a wavelet matrix gives matching statistics, and ranges at or above the threshold are looked up
  for their earliest place.  It reports the intervals that repeat at the content's first place; at its later places all of it does;
* an anchor with more than `max_contents` contents, such as that at the edge of a passage that a third of all texts hold, would
  make a shard too large.  Its windows are contents of their own then; those whose outer words, or whose
  words, occur once are let go, and the others are dealt by all their words, so a shard has no group that grows.

Equality is that of 64-bit word hashes and of 128 bits for contents.

Defined cases: a null text has no words, n_removed 0 and the digest of the empty string; rows with one doc_id are ordered by
the word at which a window starts, so a repeated row is no earlier than its twin and neither loses words to the other;
null ids come last, as one id, which 2^63 - 1 is as well; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written
from linkloom.llm.fmindex import FMIndex
from linkloom.llm.tokens import U, Words, map_texts, mix, ngrams, release, run_hashes, text_buffer

_LAST = (1 << 63) - 1  # the doc_id of those without one


@dataclass(frozen=True)
class Passages:
    window: int = 20
    anchor: int = 6
    outer: int = 3
    max_contents: int = 10_000
    shard_words: int = 150_000
    broadcast_rows: int = 1_500_000


def segments(h: np.ndarray, first: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start word, number of windows, anchor hash and content hash of every segment."""
    n, k = p.window, p.anchor
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
    if len(h) < n:
        return none
    g = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        g *= U(0xD6E8FEB86659FD93)
        g += h[j : j + len(g)]
    g = mix(g)
    at, _ = ngrams(h, first, n)
    if not len(at):
        return none
    total = len(h) - n + 1
    best, place = g[:total].copy(), np.zeros(total, np.int64)
    for j in range(1, n - k + 1):
        other = g[j : j + total]
        less = other < best  # strictly: the leftmost of equals stays
        best[less] = other[less]
        place[less] = j
    anchor = at + place[at]
    lead = np.ones(len(at), bool)
    lead[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    start = np.flatnonzero(lead)
    count = np.diff(np.append(start, len(at)))
    begin = at[start]
    return begin, count, best[begin], run_hashes(h, begin, begin + count - 1 + n)


def _texts(batch: pa.RecordBatch, text: str) -> tuple[Words, np.ndarray]:
    w = Words(*text_buffer(batch.column(text)))
    return w, w.hashes()


def found_segments(rows: DataFrame, p: Passages) -> DataFrame:
    """doc_id, row, start, n (windows), m (anchor), c (content) of the segments.  rows: doc_id, row (a hash of the text), text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        w, h = _texts(batch, "text")
        start, n, m, c = segments(h, w.first, p)
        doc = np.searchsorted(w.first, start, "right") - 1
        at = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(at), batch.column("row").take(at), pa.array((start - w.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(m.view(np.int64)), pa.array(c.view(np.int64))],
            names=["doc_id", "row", "start", "n", "m", "c"],
        )

    return map_texts(rows, run, "doc_id long, row long, start int, n int, m long, c long")


def _with_bound(rows: DataFrame, keys: DataFrame, on: list[str], limit: int) -> DataFrame:
    """rows joined to keys, which are broadcast only if counted to be few."""
    return rows.join(F.broadcast(keys) if keys.count() <= limit else keys, on)


def shard_matches(group: pa.Table, p: Passages) -> pa.Table:
    """Of the contents of a shard, those that repeat: m, c, and the intervals of words covered by windows that start earlier elsewhere than at the content's first place."""
    m, c = group.column("m").to_numpy(), group.column("c").to_numpy()
    _, at = np.unique(np.stack([m, c]), axis=1, return_index=True)  # repeated rows bring a content twice
    group = group.take(pa.array(at))
    m, c, ids, start, times = (group.column(x).to_numpy() for x in ("m", "c", "doc_id", "start", "times"))
    parts = [np.frombuffer(x.as_py(), U) for x in group.column("words")]
    size = np.array([len(x) for x in parts])
    n = p.window
    words, symbol = np.unique(np.concatenate(parts), return_inverse=True)
    begin = np.cumsum(size + 1) - (size + 1)
    text = np.zeros(int(size.sum() + len(size)), np.int64)
    inner = np.arange(len(symbol)) + np.repeat(np.arange(len(size)), size)
    text[inner] = symbol + 1
    index = FMIndex(text, len(words) + 1, n)
    # Windows by the places where they end.
    per = size - n + 1
    segment = np.repeat(np.arange(len(size)), per)
    offset = np.arange(int(per.sum())) - np.repeat(np.cumsum(per) - per, per)
    ends = begin[segment] + offset + n
    length, low, high = index.matching(text, ends, n)
    hit = np.flatnonzero(length >= n)
    # The order of places: doc_id, then the word in it.  Ranges of one length are the same or apart.
    _, doc_rank = np.unique(ids, return_inverse=True)
    whole = np.full(len(text), np.iinfo(np.int64).max)
    whole[inner] = (doc_rank[np.repeat(np.arange(len(size)), size)] << 32) + np.repeat(start, size) + np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size)
    by_suffix = whole[index.suffixes]
    ranges, back = np.unique(low[hit], return_inverse=True)
    stop = np.zeros(len(ranges), np.int64)
    stop[back] = high[hit]
    cuts = np.stack([ranges, stop], 1).reshape(-1)
    earliest = np.minimum.reduceat(np.append(by_suffix, np.iinfo(np.int64).max), cuts)[::2] if len(cuts) else cuts
    own = whole[ends[hit] - n]
    told = hit[earliest[back] < own] if len(hit) else hit
    # Runs of windows that follow each other become one interval.
    lead = np.ones(len(told), bool)
    lead[1:] = (segment[told][1:] != segment[told][:-1]) | (offset[told][1:] != offset[told][:-1] + 1)
    a = told[lead]
    b = told[np.append(np.flatnonzero(lead)[1:] - 1, len(told) - 1)] if len(told) else told
    cuts = np.searchsorted(segment[a], np.arange(len(size) + 1))
    intervals = [[{"start": int(x), "stop": int(y)} for x, y in zip(offset[a[i:j]], offset[b[i:j]] + n)] for i, j in zip(cuts[:-1], cuts[1:])]
    some = np.flatnonzero((np.diff(cuts) > 0) | (times > 1))
    release()
    return pa.table({"m": m[some], "c": c[some], "own": pa.array([intervals[k] for k in some], _INTERVALS)})


_INTERVALS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def _contents(segs: DataFrame) -> DataFrame:
    """m, c, the first place (doc_id, start, row, n) and the times of each content whose anchor occurs twice or more."""
    first = F.min(F.struct("doc_id", "start", "row", "n")).alias("first")
    return segs.groupBy("m", "c").agg(first, F.count(F.lit(1)).alias("times"))


def _searched(parts: DataFrame, p: Passages, *by: str) -> DataFrame:
    """shard_matches over m, c, doc_id, start, times, n_words and words, with shards of about shard_words, dealt by some of these."""
    total = parts.agg(F.sum("n_words")).first()[0] or 0
    shard = F.pmod(F.xxhash64(*by), F.lit(max(1, -(-total // p.shard_words)))).alias("shard")
    return parts.drop("n_words").select("*", shard).groupBy("shard").applyInArrow(lambda g: shard_matches(g, p), "m long, c long, own array<struct<start:int,stop:int>>")


def _stretches(segs: DataFrame, contents: DataFrame, reports: DataFrame, p: Passages) -> DataFrame:
    """doc_id, row, start, stop: the reports at each place of the contents.  segs: doc_id, row, start, n, m, c."""
    told = written(reports.join(contents.select("m", "c", "first"), ["m", "c"]))
    at = _with_bound(segs, told, ["m", "c"], p.broadcast_rows // 8)  # rows of about 100 bytes
    all_of = F.array(F.struct(F.lit(0).alias("start"), (F.col("n") + (p.window - 1)).alias("stop")))
    later = F.struct("doc_id", "start") > F.struct("first.doc_id", "first.start")
    spans = at.select("doc_id", "row", "start", F.explode(F.when(later, all_of).otherwise(F.col("own"))).alias("s"))
    return spans.select("doc_id", "row", (F.col("start") + F.col("s.start")).alias("start"), (F.col("start") + F.col("s.stop")).alias("stop"))


def repeated_stretches(rows: DataFrame, p: Passages) -> DataFrame:
    """doc_id, row, start, stop: stretches of words to remove; they may overlap.  rows: doc_id (long, not null), row (a hash of the text), text."""
    n = p.window
    segs = written(found_segments(rows, p))
    anchors = written(segs.groupBy("m").agg(F.count(F.lit(1)).alias("met")).where("met > 1").drop("met"))
    met = written(_with_bound(segs, anchors, ["m"], p.broadcast_rows))
    contents = written(_contents(met))
    large = written(contents.groupBy("m").agg(F.count(F.lit(1)).alias("contents")).where(F.col("contents") > p.max_contents).select("m", F.lit(True).alias("large")))
    listed = contents.join(F.broadcast(large) if large.count() <= p.broadcast_rows else large, "m", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    # The words of a content, from the text of its first place.
    wanted = written(listed.groupBy(F.col("first.doc_id").alias("w_id"), F.col("first.row").alias("w_row")).agg(F.collect_list(F.struct("first.start", "first.n", "m", "c", "times", "large")).alias("segs")))  # at most a text's own
    ids = wanted.select("w_id").distinct()
    some = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("w_id"), "left_semi") if ids.count() <= p.broadcast_rows else rows

    def content(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, h = _texts(batch, "text")
        out: list[tuple] = []
        for i, (doc, row, segs) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("doc_id", "row", "segs")))):
            for s in segs:
                a = w.first[i] + s["start"]
                words = h[a : a + s["n"] - 1 + n]
                if not s["large"]:
                    out.append((False, s["m"], s["c"], doc, row, s["start"], s["times"], len(words), words.tobytes()))
                    continue
                # The windows at the anchor, by their outer words.
                at, g = ngrams(words, np.array([0, len(words)]), n)
                ends = mix(run_hashes(words, at, at + p.outer) * U(3) + run_hashes(words, at + n - p.outer, at + n))
                m = mix(ends ^ np.array([s["m"]]).view(U)).view(np.int64)
                out += [(True, int(x), int(y), doc, row, s["start"] + int(k), 1, n, words[k : k + n].tobytes()) for k, x, y in zip(at, m, g.view(np.int64))]
        kinds = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], names=["window", "m", "c", "doc_id", "row", "start", "times", "n_words", "words"]) if out else None

    texts = some.join(wanted, (F.col("doc_id") == F.col("w_id")) & (F.col("row") == F.col("w_row")))
    parts = written(map_texts(texts.select("doc_id", "row", "text", "segs"), content, "window boolean, m long, c long, doc_id long, row long, start int, times long, n_words int, words binary"))
    usual = _searched(parts.where("not window").drop("window", "row"), p, "m")
    out = _stretches(met, contents, usual, p)
    if large.isEmpty():
        return out
    copies = listed.where("large and times > 1").select("m", "c", F.array().cast("array<struct<start:int,stop:int>>").alias("own"))
    windows = parts.where("window").withColumn("n", F.lit(1))
    shared = windows.groupBy("m").agg(F.count(F.lit(1)).alias("met")).where("met > 1").drop("met")
    windows = written(windows.join(shared, "m"))
    # A window that occurs once matches nothing; others are dealt each by itself, so that no outer words bring many together.
    apart = written(_contents(windows).where("times > 1"))
    worded = windows.join(apart.select("m", "c", "first", F.col("times").alias("seen")), ["m", "c"]).where((F.col("doc_id") == F.col("first.doc_id")) & (F.col("start") == F.col("first.start")) & (F.col("row") == F.col("first.row")))
    found = _searched(worded.select("m", "c", "doc_id", "start", F.col("seen").alias("times"), "n_words", "words"), p, "m", "c")
    return out.unionAll(_stretches(met, contents, copies, p)).unionAll(_stretches(windows.select("doc_id", "row", "start", "n", "m", "c"), apart, found, p))


def _kept(words: list[bytes], stretches: list[dict] | None) -> tuple[int, bytes]:
    if not stretches:
        return 0, b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for s in stretches:
        cover[s["start"]] += 1
        cover[s["stop"]] -= 1
    gone = np.cumsum(cover)[:-1] > 0
    return int(gone.sum()), b" ".join(w for w, g in zip(words, gone) if not g)


def without_repeats(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by spaces) of each document."""
    keyed = docs.select(F.col("doc_id").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    gone = repeated_stretches(keyed.select("doc_id", "row", "text"), p).groupBy(F.col("doc_id").alias("g_id"), F.col("row").alias("g_row"))
    gone = written(gone.agg(F.collect_set(F.struct("start", "stop")).alias("stretches")))  # at most a text's own
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t, stretches in zip(batch.column("text").to_pylist(), batch.column("stretches").to_pylist()):
            words = (t or "").encode().split()  # bytes split at these six characters only
            out.append((len(words), *_kept(words, stretches)))
        n, removed, kept = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column("own_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = f"doc_id {kind}, n_words long, n_removed long, kept binary"
    ids = gone.select("g_id").distinct()
    columns = ["own_id", "text", "stretches"]
    on = (F.col("doc_id") == F.col("g_id")) & (F.col("row") == F.col("g_row"))
    if ids.count() <= p.broadcast_rows:  # texts without repeats then need no shuffle
        some = F.broadcast(ids)
        touched = keyed.join(some, F.col("doc_id") == F.col("g_id"), "left_semi").join(gone, on, "left")
        rest = keyed.join(some, F.col("doc_id") == F.col("g_id"), "left_anti").withColumn("stretches", F.lit(None).cast(gone.schema["stretches"].dataType))
        return map_texts(touched.select(columns), run, schema).unionAll(map_texts(rest.select(columns), run, schema))
    return map_texts(keyed.join(gone, on, "left").select(columns), run, schema)


def substring_dedup(docs: DataFrame, p: Passages = Passages()) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document."""
    return without_repeats(docs, p).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
