"""Toxicity scores from FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its words, pairs of neighbouring words, and pairs with one word between
them, each hashed to 2^bits slots; a feature counts once a text.  A word here is a run of letters, digits,
apostrophes and bytes above ASCII, with A-Z lowered, so punctuation doesn't part a word from itself.
Training is online, with a learning rate for each coordinate and L1 and L2 penalties; L1 leaves few
weights, so what is broadcast for scoring is small, and at most 2^bits weights.

The classifier is fitted on the driver, on at most max_train_rows labelled rows with at most max_train_bytes of text
(the first row apart), those with the least hash of doc_id and text; everything else covers all rows.

Defined cases: a null or empty text has no feature and gets the score of the bias; a doc_id with
several labels is toxic if one of them says so; null labels are ignored; without labelled rows of
both kinds the score is the share of toxic ones (0.5 if there are none); repeated rows are each scored;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import crc_mod
from linkloom.llm.tokens import U, Words, lower_ascii, map_texts, mix, ngrams, text_buffer

_BREAK = np.ones(256, bool)
_BREAK[list(b"abcdefghijklmnopqrstuvwxyz0123456789'")] = False
_BREAK[128:] = False


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 8
    positive_weight: float = 3.0
    max_train_rows: int = 10000
    max_train_bytes: int = 64 << 20
    threshold: float = 0.7


def features(text: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all features of all texts, and the text of each."""
    buf, off = text_buffer(text)
    w = Words(lower_ascii(buf), off, _BREAK)
    h, doc = w.hashes(), w.doc
    at2, pairs = ngrams(h, w.first, 2)
    at3, _ = ngrams(h, w.first, 3)
    skip = mix(h[at3] * U(0xC2B2AE3D27D4EB4F) + h[at3 + 2] + U(3))
    slots = np.concatenate([mix(h + U(1)), mix(pairs + U(2)), skip]) >> U(64 - bits)
    return slots.astype(np.int64), np.concatenate([doc, doc[at2], doc[at3]])


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, f: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights, and the bias; rows: each text's distinct slots."""
    size = 1 << f.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, which has no L1 penalty
    order = np.random.default_rng(17)

    def weights(at: np.ndarray, l1: float) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((f.beta + np.sqrt(n[at])) / f.alpha + f.l2))

    bias = np.array([size])
    for _ in range(f.epochs):
        for i in order.permutation(len(rows)):
            at = rows[i]
            w, b = weights(at, f.l1), weights(bias, 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b[0], -30, 30)))
            g = (p - labels[i]) * (f.positive_weight if labels[i] else 1.0)
            for k, v in ((at, w), (bias, b)):
                sigma = (np.sqrt(n[k] + g * g) - np.sqrt(n[k])) / f.alpha
                z[k] += g - sigma * v
                n[k] += g * g
    every = np.arange(size)
    w = weights(every, f.l1)
    keep = np.flatnonzero(w)
    return keep, w[keep], float(weights(bias, 0.0)[0])


def training_rows(docs: DataFrame, labels: DataFrame, f: Ftrl) -> DataFrame:
    """doc_id and toxic of the labels to learn from, one for each id, at most max_train_rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), 3) != 1))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(f.max_train_rows)


def bounded(found: DataFrame, f: Ftrl, text: str) -> DataFrame:
    """The rows of found to learn from: an id may have many rows, and a text any length."""
    placed = found.withColumn("_place", F.xxhash64("l_id", text))
    light = placed.select("_place", F.octet_length(text).alias("size")).orderBy("_place").limit(f.max_train_rows).collect()
    sizes = np.cumsum([r["size"] or 0 for r in light])
    n = max(1, int(np.searchsorted(sizes, f.max_train_bytes, "right")))
    rows = placed.where(F.col("_place") <= light[n - 1]["_place"]) if light else placed
    return rows.drop("_place").limit(f.max_train_rows)


def train(docs: DataFrame, labels: DataFrame, f: Ftrl = Ftrl(), text: str = "text") -> tuple[np.ndarray, float]:
    """A weight for each slot, and the bias."""
    chosen = F.broadcast(training_rows(docs, labels, f).withColumnRenamed("doc_id", "l_id"))  # at most max_train_rows rows
    found = docs.select("doc_id", text).join(chosen, F.col("doc_id") == F.col("l_id")).select("l_id", text, "toxic")
    bits = f.bits

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        slots, doc = features(batch.column(text), bits)
        both = np.unique((doc.astype(np.int64) << bits) | slots)
        cuts = np.searchsorted(both >> bits, np.arange(batch.num_rows + 1))
        low = (both & ((1 << bits) - 1)).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column("toxic").cast(pa.int32()), pa.array([low[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])], pa.binary())], names=["toxic", "slots"])

    rows = map_texts(bounded(found, f, text), run, "toxic int, slots binary", text).collect()
    rows.sort(key=lambda r: (bytes(r.slots), r.toxic))  # the order of arrival must not matter
    y = np.array([min(1, max(0, r.toxic)) for r in rows], float)
    if not len(y) or y.min() == y.max():
        p = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return np.zeros(1 << bits, np.float32), float(np.log(p / (1 - p)))
    keep, w, bias = fit_ftrl([np.frombuffer(r.slots, np.int32) for r in rows], y, f)
    dense = np.zeros(1 << bits, np.float32)
    dense[keep] = w
    return dense, bias


def score(docs: DataFrame, dense: np.ndarray, bias: float, f: Ftrl = Ftrl(), text: str = "text") -> DataFrame:
    """docs' columns but the text, with score and n_toxic_features, the features with a positive weight."""
    carry = [c for c in docs.columns if c != text]
    keep = np.flatnonzero(dense)
    shared = docs.sparkSession.sparkContext.broadcast((keep, dense[keep], bias))
    bits = f.bits

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, weight, bias = shared.value
        table = np.zeros(1 << bits, np.float32)
        table[keep] = weight
        slots, doc = features(batch.column(text), bits)
        told = table[slots] != 0
        both = np.unique((doc[told].astype(np.int64) << bits) | slots[told])
        w = table[both & ((1 << bits) - 1)].astype(float)
        of = both >> bits
        total = bias + np.bincount(of, w, batch.num_rows)
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(p), pa.array(np.bincount(of[w > 0], minlength=batch.num_rows).astype(np.int64))], names=[*carry, "score", "n_toxic_features"])

    head = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.select(*carry).schema)
    return map_texts(docs, run, f"{head}, score double, n_toxic_features long", text)


def toxicity(docs: DataFrame, labels: DataFrame, f: Ftrl = Ftrl()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    dense, bias = train(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), f)
    rows = docs.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return score(rows, dense, bias, f).select("doc_id", "held_out", "score", (F.col("score") >= f.threshold).cast("int").alias("predicted"), "n_toxic_features")
