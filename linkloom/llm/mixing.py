"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's target is its share, by weight, of the words of all sources; targets stop at
max_repeats times the source's words, and what is cut off is shared out again by weight.
Targets become whole blocks of equal word counts by highest quotients target / (2k + 1), first
over the sources and then, within each source, over its shards (by their words).  Each
shard lays its documents in a seeded order on a line of words; it takes that line as often
as its quota holds it whole, and of the rest the first blocks, which may end inside a document.

There are at most max_shards shards besides one for each source.  Up to max_sources sources, quotas
are found on the driver, from one row for each source and shard, and broadcast.  Beyond that
they stay a table: sums over it give the targets and the bound of the quotients, only the shards of sources
with several come to the driver, and the quotas are joined by a shuffle.  Only light columns are
shuffled, dealt by source and shard, so a source with a third of all documents is split over
a third of the shards.

Defined cases: a null or empty text has 0 words and takes 0; null sources form one source,
ordered last; repeated rows each take part, in an order that their columns settle; an empty table
gives an empty result; sources without words have target 0; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.common import numbered
from linkloom.llm.tokens import Words, map_texts, text_buffer
from linkloom.session import cut


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources in code point order; block_words: None for at most
    a 400th of the smallest target, and 4096 words."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_repeats: int = 3
    block_words: int | None = None
    seed: int = 20240229
    max_shards: int = 4096
    shard_docs: int = 2000
    max_sources: int = 100_000


def capped_targets(sizes: np.ndarray, weights: np.ndarray, max_repeats: int) -> np.ndarray:
    """Targets that share sum(sizes) by weight, none above max_repeats times its size."""
    target = np.zeros(len(sizes))
    total = float(sizes.sum())
    free = sizes > 0
    cap = max_repeats * sizes.astype(float)
    while free.any():
        left = total - target[~free].sum()
        share = left * weights[free] / weights[free].sum()
        over = share > cap[free]
        at = np.flatnonzero(free)
        if not over.any():
            target[at] = share
            break
        target[at[over]] = cap[at[over]]
        free[at[over]] = False
    return target


def sainte_lague(votes: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Whole seats by the highest quotients votes / (2k + 1), none above most; ties go to the first.

    The quotients are not listed: all above a common bound d are taken at once, for the
    largest d that doesn't give too many, and the last few one by one.
    """
    votes = np.asarray(votes, float)
    most = np.asarray(most, np.int64)
    seats = int(min(seats, most.sum()))
    if seats <= 0 or not (votes > 0).any():
        return np.zeros(len(votes), np.int64)

    def given(d: float) -> np.ndarray:  # how many quotients exceed d
        return np.minimum(np.maximum(np.ceil((votes / d - 1) / 2), 0), most).astype(np.int64)

    low, high = 1e-12, float(votes.max()) + 1.0
    for _ in range(200):
        mid = (low * high) ** 0.5
        if given(mid).sum() <= seats:
            high = mid
        else:
            low = mid
        if high / low < 1 + 1e-12:
            break
    got = given(high)
    while (rest := seats - int(got.sum())) > 0:
        quotient = np.where(got < most, votes / (2 * got + 1), -1.0)
        order = np.argsort(-quotient, kind="stable")
        order = order[quotient[order] > 0][: max(1, min(rest, len(votes) // 8))] if rest > len(votes) else order[quotient[order] > 0][:1]
        if not len(order):
            break
        got[order] += 1
    return got


def sized(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' columns, the text only if it is to be kept, with size, the text's number of words."""
    carry = [c for c in docs.columns if keep_text or c != text]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = Words(*text_buffer(batch.column(text))).count.astype(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(n)], names=[*carry, "size"])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return map_texts(docs, run, f"{head}, size long", text)


def _code_points(source: str | None) -> tuple:
    return (source is None, source or "")


def plan(spark, shards: list[tuple], m: Mix) -> DataFrame:
    """(source, shard, source_size, target, quota in words, shard_size) from (source, shard, size) rows."""
    by: dict = {}
    for source, shard, size in shards:
        by.setdefault(source, []).append((shard, size))
    names = sorted(by, key=_code_points)
    sizes = np.array([sum(s for _, s in by[n]) for n in names], np.int64)
    weights = np.array([m.weights[i % len(m.weights)] for i in range(len(names))])
    target = capped_targets(sizes, weights, m.max_repeats)
    least = target[target > 0].min() if (target > 0).any() else 1
    block = m.block_words or int(max(1, min(4096, least // 400)))
    blocks = sainte_lague(target, round(sizes.sum() / block), m.max_repeats * sizes // block)
    rows = []
    for i, n in enumerate(names):
        own = sorted(by[n])
        s = np.array([x[1] for x in own], np.int64)
        quota = sainte_lague(s, int(blocks[i]), m.max_repeats * s // block) * block
        rows += [(n, int(k), int(sizes[i]), float(target[i]), int(q), int(x)) for (k, x), q in zip(own, quota)]
    return _keyed(spark.createDataFrame(rows, "p_source string, p_shard int, source_size long, target double, quota long, shard_size long"))


def _key(source: Column) -> Column:
    """source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _keyed(quotas: DataFrame) -> DataFrame:
    return quotas.withColumn("p_source", _key(F.col("p_source")))


def _level(sources: DataFrame) -> float:
    """capped_targets() over a table: what a weight of 1 gets; the sources whose cap is below their share stop at it."""
    total = sources.agg(F.sum("size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # sources once capped stay so, as the level only rises
        below = (F.col("cap") < level * F.col("weight")) | (F.col("size") == 0)
        r = sources.agg(F.count_if(below), F.sum(F.when(below, F.col("cap")).otherwise(0.0)), F.sum(F.when(~below, F.col("weight")).otherwise(0.0))).first()
        if r[0] == capped or not r[2]:
            return level if r[2] else math.inf
        capped, level = r[0], (total - r[1]) / r[2]


def _seats(sources: DataFrame, seats: int) -> DataFrame:
    """sainte_lague() over a table with place, target and most: got, the seats of each source."""
    votes, most = F.col("target"), F.col("most")
    given = lambda d: F.least(F.greatest(F.ceil((votes / F.lit(d) - 1) / 2), F.lit(0)), most).cast("long")
    r = sources.agg(F.sum("most"), F.max("target")).first()
    seats = min(seats, r[0] or 0)
    if seats <= 0 or not r[1]:
        return sources.withColumn("got", F.lit(0).cast("long"))
    low, high, ways = 1e-12, r[1] + 1.0, 32
    while high / low >= 1 + 1e-12:  # each round tries many bounds at once
        tried = [low * (high / low) ** (k / ways) for k in range(1, ways)]
        sums = sources.agg(*[F.sum(given(d)).alias(f"s{k}") for k, d in enumerate(tried)]).first()
        fit = [d for d, s in zip(tried, sums) if s <= seats]
        over = [d for d, s in zip(tried, sums) if s > seats]
        new = max([low, *over]), min([high, *fit])
        if new == (low, high):
            break
        low, high = new
    got = cut(sources.withColumn("got", given(high)))
    rest = seats - got.agg(F.sum("got")).first()[0]
    if not rest:
        return got
    # The bound's own quotients, of which a source has one: the first ones get a seat more.
    quotient = votes / (2 * F.col("got") + 1)
    more = numbered(got.where((F.col("got") < most) & (quotient > 0)).select(F.col("place").alias("m_place"), quotient.alias("quotient")), "turn", F.desc("quotient"), F.asc("m_place")).where(F.col("turn") < rest)
    return cut(got.join(more.select("m_place"), F.col("place") == F.col("m_place"), "left").withColumn("got", F.col("got") + F.col("m_place").isNotNull().cast("long")).drop("m_place"))


def plan_table(shards: DataFrame, m: Mix) -> DataFrame:
    """As plan(), from a table of (source, shard, size), for any number of sources."""
    spark = shards.sparkSession
    sources = numbered(shards.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_shards")), "place", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in m.weights]), (F.col("place") % len(m.weights) + 1).cast("int"))
    sources = sources.withColumns({"weight": weight, "cap": F.col("size").cast("double") * m.max_repeats})
    sources = cut(sources.withColumn("target", F.least(F.col("cap"), F.col("weight") * _level(sources))))
    least, total = sources.agg(F.min(F.when(F.col("target") > 0, F.col("target"))), F.sum("size")).first()
    block = m.block_words or int(max(1, min(4096, (1 if least is None else least) // 400)))
    got = _seats(sources.withColumn("most", F.expr(f"size * {m.max_repeats} div {block}")), round((total or 0) / block))
    got = got.select(F.col("source").alias("g_source"), F.col("size").alias("source_size"), "target", "got", "n_shards")
    rows = cut(shards.join(got, F.col("source").eqNullSafe(F.col("g_source"))))
    quota: dict = {}
    for r in rows.where("n_shards > 1").select("source", "shard", "size", "got").collect():  # at most max_shards
        quota.setdefault((r.source, r.got), []).append((r.shard, r["size"]))
    found = []
    for (source, blocks), own in quota.items():
        own.sort()
        s = np.array([x[1] for x in own], np.int64)
        found += [(source, int(k), int(q)) for (k, _), q in zip(own, sainte_lague(s, blocks, m.max_repeats * s // block) * block)]
    found = F.broadcast(spark.createDataFrame(found, "q_source string, q_shard int, q long"))
    rows = rows.join(found, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("shard") == F.col("q_shard")), "left")
    quota = F.coalesce("q", F.col("got") * block)
    return _keyed(rows.select(F.col("source").alias("p_source"), F.col("shard").alias("p_shard"), "source_size", "target", quota.alias("quota"), F.col("size").alias("shard_size")))


def _dealt(sizes: DataFrame, shards_of: DataFrame, m: Mix) -> DataFrame:
    """sizes with its shard, and place, by which a shard's documents are ordered."""
    return (
        sizes.join(F.broadcast(shards_of), F.col("source").eqNullSafe(F.col("s_source")), "left")  # at most max_shards rows
        .withColumn("place", F.xxhash64(F.lit(m.seed), F.col("doc_id"), F.col("size")))
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(m.seed + 1), F.col("doc_id"), F.col("size")), F.coalesce("n_shards", F.lit(1))).cast("int"))
        .drop("s_source", "n_shards")
    )


def apportion(sizes: DataFrame, m: Mix = Mix(), told: bool = False) -> tuple:
    """From doc_id, source and size of all documents: the numbers of shards of sources with several, and each shard's quota; told: also whether the quotas are few."""
    spark = sizes.sparkSession
    per_source = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total, n_sources = per_source.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_shards = F.expr(f"least((n + {m.shard_docs - 1}) div {m.shard_docs}, {m.max_shards} * n div {max(total, 1)})").cast("int")
    shards_of = per_source.select(F.col("source").alias("s_source"), n_shards.alias("n_shards")).where("n_shards > 1").collect()
    shards_of = spark.createDataFrame(shards_of, "s_source string, n_shards int")
    shards = _dealt(sizes, shards_of, m).groupBy("source", "shard").agg(F.sum("size").alias("size"))
    if n_sources > m.max_sources:
        return shards_of, plan_table(cut(shards), m), *[False][: told]
    return shards_of, F.broadcast(plan(spark, [tuple(r) for r in shards.collect()], m)), *[True][: told]


def _laid(sizes: DataFrame, shards_of: DataFrame, quotas: DataFrame, m: Mix) -> DataFrame:
    """sizes with the quota of its shard, full (how often it holds the whole line), rest (what is left of it) and before (the words ahead on the line)."""
    # A quota for each shard; where it is not broadcast, the join deals the rows as the window needs them.
    dealt = _dealt(sizes, shards_of, m).withColumn("key", _key(F.col("source")))
    joined = dealt.join(quotas, (F.col("key") == F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    line = Window.partitionBy("key", "shard").orderBy("place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    full = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    laid = joined.withColumns({"before": F.coalesce(F.sum("size").over(line), F.lit(0)), "full": full})
    return laid.withColumn("rest", F.col("quota") - F.col("full") * F.col("shard_size"))


def take(sizes: DataFrame, shards_of: DataFrame, quotas: DataFrame, m: Mix = Mix()) -> DataFrame:
    """sizes, which has doc_id, source and size, with source_size, target and taken."""
    taken = F.col("full") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return _laid(sizes, shards_of, quotas, m).withColumn("taken", taken.cast("long")).drop("place", "key", "shard", "p_source", "p_shard", "quota", "shard_size", "full", "rest", "before")


def mixture(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    sizes = cut(sized(docs.select("doc_id", F.col("source").cast("string").alias("source"), "text")))
    return take(sizes, *apportion(sizes, m), m).select("doc_id", "size", "source_size", "target", "taken")


def ends(sizes: DataFrame, shards_of: DataFrame, quotas: DataFrame, m: Mix = Mix()) -> DataFrame:
    """The quotas with the place on each shard's line where the rest of the quota ends, and end_words, those taken of each document at that place."""
    laid = _laid(sizes, shards_of, quotas, m).where((F.col("size") > 0) & (F.col("rest") > 0))
    at = laid.groupBy("key", "shard", "place").agg(F.min("before").alias("before"), F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.first("rest").alias("rest"))
    at = at.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("words") >= F.col("rest")))
    end = at.select(F.col("key").alias("e_key"), F.col("shard").alias("e_shard"), F.col("place").alias("end_place"), F.floor((F.col("rest") - F.col("before")) / F.col("rows")).alias("end_words"))
    full = F.when(F.col("shard_size") > 0, F.floor(F.col("quota") / F.col("shard_size"))).otherwise(0).cast("long")
    return quotas.join(end, (F.col("p_source") == F.col("e_key")) & (F.col("p_shard") == F.col("e_shard")), "left").withColumn("full", full).drop("e_key", "e_shard")


def mix_documents(docs: DataFrame, m: Mix = Mix()) -> DataFrame:
    """The documents that the mix takes words of, in docs' columns, with mix_size, mix_target and mix_taken, which replace columns of these names.

    Light rows settle where each shard's quota ends; the quotas with that place are broadcast, and no text is shuffled (beyond
    max_sources sources they are joined by a shuffle).  Rows with one doc_id and size have one place; where a quota ends
    there they share what is left of it equally, rounded down.
    """
    columns = docs.columns
    names = [f"_{i}" for i in range(len(columns))]
    text, source, doc_id = (f"_{columns.index(c)}" for c in ("text", "source", "doc_id"))
    rows = docs.toDF(*names).select(*names, F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"))
    sizes = cut(sized(rows.select("doc_id", "source", text), text))
    shards_of, quotas, few = apportion(sizes, m, True)
    last = cut(ends(sizes, shards_of, quotas, m))
    dealt = _dealt(sized(rows, text, keep_text=True), shards_of, m).withColumn("key", _key(F.col("source")))
    joined = dealt.join(F.broadcast(last) if few else last, (F.col("key") == F.col("p_source")) & (F.col("shard") == F.col("p_shard")))
    more = F.when(F.col("place") < F.col("end_place"), F.col("size")).when(F.col("place") == F.col("end_place"), F.least("size", "end_words")).otherwise(0)
    heavy = joined.withColumn("taken", (F.col("full") * F.col("size") + more).cast("long")).where("taken > 0")
    own = [F.col(n).alias(c) for n, c in zip(names, columns) if c not in ("mix_size", "mix_target", "mix_taken")]
    return heavy.select(*own, F.col("size").alias("mix_size"), F.col("target").alias("mix_target"), F.col("taken").alias("mix_taken"))
