"""Host-level quality rules.

Each document is tested against rules on its own text.  Failures are summed by host, each
host's failure rate is shrunk towards the rate of all hosts by a beta prior fitted to the
hosts themselves (method of moments), and the host's verdict is joined back to its
documents.  A hard failure always rejects a document.  Otherwise its host decides which
limits hold for it: those of ordinary hosts, or, for a host whose shrunk rate is high, the
strict ones, which are half as wide.  A clean document, far from either limit, is kept
whatever its host.

Defined cases: a null or empty text has no words and fails the word count; null hosts form
one host; rows that repeat a doc_id are each judged; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import written
from linkloom.llm.tokens import Words, map_texts, mix, ngrams, span_hashes, sums_by, text_buffer
from linkloom.session import cut

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SHARES = 16


@dataclass(frozen=True)
class Rules:
    """min_words and max_repeat_percent are the hard rules, the other limits soft.

    Symbols are counted against words, duplicate lines against lines, capitals against
    letters of words.  distrust: the shrunk failure rate from which a host's documents are
    held to limits divided by strict.
    """

    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_symbol_percent: int = 30
    max_dup_line_percent: int = 30
    min_mean_chars: int = 2
    max_mean_chars: int = 30
    max_upper_percent: int = 60
    distrust: float = 0.3
    strict: int = 2
    broadcast_hosts: int = 200_000


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.argsort(keys)
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.empty(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def text_metrics(text: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each text."""
    buf, off = text_buffer(text)
    w = Words(buf, off)
    n = len(off) - 1
    chars = w.solid & ((buf & 0xC0) != 0x80)
    at, g = ngrams(w.hashes(), w.first, window)
    doc = w.doc
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(1))
    hit = at[_repeats(g ^ salt[doc[at]])] if len(at) else at
    size = len(w.start) + 1
    covered = np.cumsum(np.bincount(hit, minlength=size) - np.bincount(hit + window, minlength=size))[:-1] > 0
    # Lines: the pieces between \n; those with a word count, and an equal one before makes a duplicate.
    newline = np.flatnonzero(buf == 10)
    start = np.sort(np.concatenate([off[:-1], newline + 1]))
    line_doc = np.searchsorted(off[1:], start, "right")
    if n:  # each text has its lines; a start at the end of a text belongs to that text, where it is an empty line
        keep = line_doc < n
        start, line_doc = start[keep], line_doc[keep]
    end = np.minimum(np.append(start[1:], len(buf)), off[1:][line_doc] if n else 0) if len(start) else start
    stops = np.append(newline, len(buf))
    end = np.minimum(end, stops[np.searchsorted(stops, start)]) if len(start) else end
    with_word = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, line_doc = start[with_word], end[with_word], line_doc[with_word]
    key = span_hashes(buf, start, end) ^ salt[line_doc] if len(start) else np.zeros(0, np.uint64)
    _, leader = np.unique(key, return_index=True)
    dup = np.ones(len(key), bool)
    dup[leader] = False
    lines = np.searchsorted(line_doc, np.arange(n + 1))
    return {
        "n_words": w.count.astype(np.int64),
        "word_chars": sums_by(chars, off),
        "n_symbols": sums_by(_SYMBOL[buf], off),
        "n_lines": np.diff(lines).astype(np.int64),
        "n_dup_lines": sums_by(dup, lines),
        "n_repeat_words": sums_by(covered, w.first),
        "n_upper": sums_by((buf >= 65) & (buf <= 90), off),
    }


_METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")


def measure(docs: DataFrame, rules: Rules = Rules(), carry: tuple[str, ...] = ("doc_id", "source"), text: str = "text") -> DataFrame:
    """The carried columns, the metrics, base_failed, soft_failed and strict_failed of each document."""
    fields = docs.select(*carry).schema
    window = rules.window

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = text_metrics(batch.column(text), window)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(m[k], pa.int64()) for k in _METRICS], names=[*carry, *_METRICS])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{k} long" for k in _METRICS)])
    found = map_texts(docs.select(*dict.fromkeys([*carry, text])), run, schema, text)
    n = F.col("n_words")

    def over(by: int) -> Column:
        return (
            (by * 100 * F.col("n_symbols") > rules.max_symbol_percent * n)
            | (by * 100 * F.col("n_dup_lines") > rules.max_dup_line_percent * F.col("n_lines"))
            | (by * 100 * F.col("n_upper") > rules.max_upper_percent * F.col("word_chars"))
            | (F.col("word_chars") < rules.min_mean_chars * n)
            | (F.col("word_chars") > rules.max_mean_chars * n)
        )

    return found.withColumns(
        {
            "base_failed": (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * n),
            "soft_failed": over(1),
            "strict_failed": over(rules.strict),
        }
    )


def host_verdicts(measured: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """One row per host: its documents, failures, shrunk failure rate and whether it is distrusted.

    The beta prior has the mean m of all documents and the strength k that the spread of the
    hosts' rates implies: with v the variance of the rates, weighted by documents, k = m(1-m)/v - 1,
    held between 10 and 1000 documents.
    """
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("host_docs"),
        F.sum((F.col("base_failed") | F.col("soft_failed")).cast("long")).alias("host_failed"),
    )
    rate = F.col("host_failed") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failed") / F.sum("host_docs")).alias("m"),
        (F.sum(F.col("host_docs") * rate * rate) / F.sum("host_docs")).alias("square"),
    )
    m, v = F.col("m"), F.greatest(F.col("square") - F.col("m") * F.col("m"), F.lit(1e-9))
    prior = prior.select("m", F.least(F.lit(1000.0), F.greatest(F.lit(10.0), m * (1 - m) / v - 1)).alias("k"))
    shrunk = (F.col("host_failed") + F.col("m") * F.col("k")) / (F.col("host_docs") + F.col("k"))
    return hosts.crossJoin(F.broadcast(prior)).select("host", "host_docs", "host_failed", shrunk.alias("host_rate"), (shrunk >= rules.distrust).alias("distrusted"))


def judge(measured: DataFrame, verdicts: DataFrame, rules: Rules = Rules(), host: str = "source") -> DataFrame:
    """measured with host_rate, distrusted and kept.

    Hosts are counted: at most broadcast_hosts are broadcast, so no document moves.  Beyond that both sides are shuffled; as a
    host may hold a third of all documents, the join is salted then: each host's row is repeated for every share and its
    documents are dealt over the shares.
    """
    hosts = cut(verdicts.select("host", "host_rate", "distrusted"))
    if hosts.count() <= rules.broadcast_hosts:
        out = measured.join(F.broadcast(hosts), F.col(host).eqNullSafe(F.col("host")), "left")
    else:
        hosts = hosts.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))))
        d = measured.withColumn("share_of", F.pmod(F.xxhash64(*_METRICS), F.lit(_SHARES)).cast("int"))
        out = d.join(hosts, (F.col(host).eqNullSafe(F.col("host"))) & (F.col("share_of") == F.col("share")), "left").drop("share", "share_of")
    failed = F.when(F.coalesce("distrusted", F.lit(False)), F.col("strict_failed")).otherwise(F.col("soft_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & ~failed).drop("host")


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The verdict on each document, with the metrics it rests on."""
    measured = written(measure(docs, rules))  # light rows; the texts are measured once
    return judge(measured, host_verdicts(measured, rules), rules)


def keep_good(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules and their hosts' verdicts keep, in the columns of docs.

    The texts are measured twice, once for the hosts and once beside the columns that
    pass on, so that no text is shuffled.
    """
    verdicts = host_verdicts(measure(docs, rules), rules)
    columns = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(columns))])  # the rows' own names may clash with the metrics'
    text, host = (f"_{columns.index(c)}" for c in ("text", "source"))
    measured = measure(plain, rules, tuple(plain.columns), text)
    return judge(measured, verdicts, rules, host).where("kept").select(*plain.columns).toDF(*columns)
