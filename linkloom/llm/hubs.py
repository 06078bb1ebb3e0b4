"""Links among many texts like one text, counted without listing their pairs.

A hub is a text P, of which others are variants.  Each of these is held as the set E of the shingles in which it differs from P: d that
it lacks and a that it adds.  With weight w = 100 d + p a and room K = (100 - p) |P|, two texts S and T have a similarity of p percent
exactly if

    w(S) + w(T) <= K + (100 + p) |E(S) & E(T)|.

Members of a hub are texts whose E is no longer than themselves.  Pairs with w(S) + w(T) <= K are linked whatever they share: they are counted by a
running sum over the weights up to K, of which a hub has |P| + 1 at most, and P itself, of weight 0, is linked to all members in them.  The other pairs are
compared in blocks of members by lists of the members at each difference, which are short beside the texts, so a block holds thousands; tasks
return counts and a spanning forest, never pairs.  Pairs of members of one hub need no search and no comparing elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.common import written
from linkloom.llm.components import components
from linkloom.llm.tokens import U, release

if TYPE_CHECKING:
    from linkloom.llm.neardup import Forest

_MEMBER = "vertex long, hub long, n long, w long, k long, items binary"


def shared_nodes(crowd: DataFrame, f: Forest) -> DataFrame:
    """The rows of crowd in nodes of many texts, one of them open at least; pairs of others are not listed anyhow."""
    many = crowd.groupBy("node").agg(F.count(F.lit(1)).alias("met"), F.bool_or("open").alias("some")).where((F.col("met") > f.hub_node) & F.col("some"))
    return written(crowd.join(many.select("node"), "node"))


def members_of(crowd: DataFrame, held: DataFrame, f: Forest) -> DataFrame:
    """vertex, hub, n (shingles), w, k (room of the hub) and items (its differences) of the members of hubs.

    crowd: vertex, tree, node, path and open of the texts in shared nodes; held: vertex and shingles (sorted) of these texts.
    Of texts whose nodes touch the hub is the one that shares most whole paths with others.  What no hub took chooses again, as long as hubs took an eighth of those that chose;
    the rest have no hub, so their pairs are listed.
    """
    found = []
    while not crowd.isEmpty():
        touching = components(crowd.select(F.col("vertex").alias("a"), F.col("node").alias("b")))
        group = written(crowd.select("vertex").distinct().join(touching, "vertex"))
        same = crowd.groupBy("tree", "path").agg(F.count(F.lit(1)).alias("same"))
        score = crowd.join(same, ["tree", "path"]).groupBy("vertex").agg(F.sum("same").alias("score"))
        hub = score.join(group, "vertex").groupBy("root").agg(F.max(F.struct("score", "vertex"))["vertex"].alias("hub"))
        base = written(hub.join(held.select(F.col("vertex").alias("hub"), F.col("shingles").alias("base")), "hub"))
        size = base.agg(F.sum(F.octet_length("base"))).first()[0] or 0
        near = held.join(group, "vertex").join(F.broadcast(base) if size <= f.broadcast_bytes else base, "root")
        found.append(written(near.select("vertex", "hub", "shingles", "base").mapInArrow(lambda batches: _differences(batches, f.threshold_percent), _MEMBER)))
        if 8 * found[-1].count() < group.count():
            break
        crowd = shared_nodes(crowd.join(found[-1].select("vertex"), "vertex", "left_anti"), f)
    return reduce(DataFrame.unionAll, found) if found else crowd.sparkSession.createDataFrame([], _MEMBER)


def _differences(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, n, w, k, items = [], [], [], [], []
        for i in range(batch.num_rows):
            own, base = (np.frombuffer(batch.column(c)[i].as_buffer(), U) for c in ("shingles", "base"))
            differ = np.setxor1d(own, base, assume_unique=True)
            lacks = (len(differ) + len(base) - len(own)) // 2
            weight, room = 100 * lacks + percent * (len(differ) - lacks), (100 - percent) * len(base)
            if len(differ) <= len(own):
                kept.append(i)
                n.append(len(own))
                w.append(weight)
                k.append(room)
                items.append(differ.tobytes())
        if kept:
            told = batch.select(["vertex", "hub"]).take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*told.columns, pa.array(n, pa.int64()), pa.array(w, pa.int64()), pa.array(k, pa.int64()), pa.array(items, pa.binary())], names=["vertex", "hub", "n", "w", "k", "items"])
    release()


def links_within(members: DataFrame, f: Forest) -> DataFrame:
    """vertex, other (a text of its class) and links: with how many members of its hub each member is linked; a vertex may have several rows, to be summed up."""
    weights = written(members.where("w <= k").groupBy("hub", "k", "w").agg(F.count(F.lit(1)).alias("n")))
    # At each weight the members up to what it leaves of the room; a member that fits twice has counted itself.
    line = weights.select("hub", F.col("w").alias("at"), F.lit(0).alias("asks"), "n", "w", "k").unionAll(weights.select("hub", F.col("k") - F.col("w"), F.lit(1), F.lit(0).cast("long"), "w", "k"))
    upto = F.sum("n").over(Window.partitionBy("hub").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sure = line.withColumn("upto", upto).where("asks = 1").select("hub", "w", (F.col("upto") - (2 * F.col("w") <= F.col("k")).cast("long")).alias("links"))
    light = members.join(sure, ["hub", "w"]).select("vertex", F.col("hub").alias("other"), "links")

    most = members.groupBy("hub").agg(F.max("w").alias("most"))
    heavy = written(members.join(most, "hub").where("w + most > k").drop("most"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / f.hub_docs), F.ceil(F.sum(F.octet_length("items")) / (8 * f.hub_items))).cast("int")
    sizes = heavy.groupBy("hub").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int")
    dealt = heavy.join(sizes, "hub").withColumn("own", own).withColumn("opposite", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A block meets all others: rows grow with the blocks, of which there is one for each hub_docs members.
    dealt = dealt.select("hub", F.least("own", "opposite").alias("i"), F.greatest("own", "opposite").alias("j"), "own", "vertex", "n", "w", "k", "items")
    percent = f.threshold_percent

    def compare(group: pa.Table) -> pa.Table:
        items = [np.frombuffer(x.as_buffer(), U) for x in group.column("items")]
        vertex, own, n, w = (group.column(c).to_numpy() for c in ("vertex", "own", "n", "w"))
        across = group.column("i")[0].as_py() != group.column("j")[0].as_py()
        links, root = linked_by_differences(items, n, w, group.column("k")[0].as_py(), percent, own if across else None)
        release()
        return pa.table({"vertex": vertex, "other": vertex[root], "links": links})

    return light.unionAll(dealt.groupBy("hub", "i", "j").applyInArrow(compare, "vertex long, other long, links long"))


def linked_by_differences(items: list[np.ndarray], size: np.ndarray, w: np.ndarray, room: int, percent: int, side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each member the number of links to members with which it exceeds the room, and the root of its tree in a forest of them; only pairs across if side is given.

    Two texts differ in what their differences differ in, from whatever they are taken.  So a difference of more than half of the
    members is turned into one of the others, and lists hold half of the members at most.
    """
    n = len(items)
    of = np.repeat(np.arange(n), [len(x) for x in items])
    _, column, seen = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    turned = np.flatnonzero(2 * seen > n)
    lacking = [np.setdiff1d(np.arange(n), of[column == c], assume_unique=True) for c in turned]
    kept = ~(2 * seen > n)[column]
    of = np.concatenate([of[kept], *lacking])
    column = np.concatenate([column[kept], np.repeat(turned, [len(x) for x in lacking])])
    differ = np.bincount(of, minlength=n)
    order = np.lexsort((of, column))
    held, lists = of[order], np.bincount(column, minlength=len(seen))  # the members at each difference, one difference after the other
    stop = np.cumsum(lists)
    common = lists[column] > 1
    by = np.argsort(of[common], kind="stable")
    first, column = np.searchsorted(of[common][by], np.arange(n + 1)), column[common][by]
    links, root = np.zeros(n, np.int64), np.arange(n)
    for i in range(n) if side is None else np.flatnonzero(side == side.min()):
        at = [held[stop[c] - lists[c] : stop[c]] for c in column[first[i] : first[i + 1]]]
        shared = np.bincount(np.concatenate(at), minlength=n) if at else 0
        both = (size + size[i] - (differ + differ[i] - 2 * shared)) // 2
        fit = (w + w[i] > room) & (100 * both >= percent * (size + size[i] - both))
        hit = np.flatnonzero(fit & (side != side[i])) if side is not None else i + 1 + np.flatnonzero(fit[i + 1 :])
        links[i] += len(hit)
        links[hit] += 1
        names = np.unique(root[np.append(hit, i)])
        if len(names) > 1:
            root[np.isin(root, names)] = names[0]
    return links, root
