"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Texts are sets of five-word shingles (a shorter text is one shingle).  Equal sets are collapsed first.  A signature has
`trees` sequences of `depth` MinHash values, each a path in one prefix trie; a path is packed into a long, so that order is
the trie's order and a prefix is a shift.

Every text's search begins at whole paths.  In each node, a run of the sorted trie, the texts that meet there are held against
each other by size and by the agreement of their whole signatures, each pair in the first tree where it meets.  From the
similarities that the signatures show, a text's own recall is measured: a pair of similarity s meets with probability
p = 1 - (1 - s^d)^trees, so each found pair stands for 1 / p pairs, and one more text at the threshold is taken to be there to be
missed.  A text ends at the prefix where its recall reaches the target; all others go on with prefixes shorter by a level,
against all texts, until even pairs at the threshold meet with the target's probability.  A pair is found if it meets at the
shorter of its texts' last prefixes.

Texts that meet more than `node_docs` others in a node may be of one template.  Their shingles are counted: a text of which more
than about a ninth is in no other such text is closed.  Of two closed texts neither has enough shingles to share for the
threshold, whatever their sizes, so only pairs with an open text are listed, and texts of a template with parts of their own
cost no square.  This loses no link: a text outside of such nodes is open.

Texts in nodes of more than `hub_node`, of which some are open, that are like one of them, their hub, are held by what they differ in from it, and their
links are counted from that, all of them (see hubs.py).  The forest lists no pair of two members of one hub.

Pairs that pass are plausible; components of them are the clusters, whose texts' shingles are brought together.  A cluster
of more than `block_docs` texts is cut by rank into blocks, and a text goes only to those pairs of blocks in which it has a plausible
partner.  A task compares exactly the pairs that met in the forest, on whole shingle sets, and returns counts of links and a
spanning forest of them, never the pairs.  Nodes are cut into block pairs as well, so no task holds an unbounded group and
no pair is lost.  Classes are the connected components of the links.

Defined cases: texts without words have no shingle, link to nothing and are each a class of their own; a class is named
after its least doc_id (null last: a class of null ids alone has a null name); repeated rows fall into one class, as
do texts with equal shingle sets; equal similarity 0.8 counts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkloom.llm.common import numbered, written
from linkloom.llm.components import components
from linkloom.llm.hubs import links_within, members_of, shared_nodes
from linkloom.llm.tokens import U, Words, map_texts, mix, ngrams, release, run_hashes, text_buffer

_BITS = 10
_PAIRS = 1 << 17


@dataclass(frozen=True)
class Forest:
    shingle: int = 5
    threshold_percent: int = 80
    trees: int = 16
    depth: int = 6
    target_recall: float = 0.999
    node_docs: int = 256
    block_docs: int = 256
    block_shingles: int = 500_000
    hub_node: int = 64
    hub_docs: int = 8192
    hub_items: int = 1 << 20
    count_shingles: int = 1_000_000
    broadcast_rows: int = 500_000
    broadcast_bytes: int = 64 << 20

    @property
    def shortest(self) -> int:
        """The longest prefix at which texts at the threshold meet in a tree with the target probability."""
        d = self.depth
        while d > 1 and meeting(self.threshold_percent / 100, d, self) < self.target_recall:
            d -= 1
        return d

    @property
    def agreement(self) -> int:
        """The least number of equal values in two signatures; a pair at the threshold has fewer once in ten thousand times."""
        n, s, below = self.trees * self.depth, self.threshold_percent / 100, 0.0
        for k in range(n):
            below += comb(n, k) * s**k * (1 - s) ** (n - k)
            if below > 1e-4:
                return k
        return n


def meeting(s, d: int, f: Forest):
    """The probability that texts of similarity s share a prefix of d values in some tree."""
    return 1 - (1 - s**d) ** f.trees


def shingle_sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of every text, sorted within it, and the texts' offsets in them."""
    buf, off = text_buffer(text)
    w = Words(buf, off)
    h = w.hashes()
    at, g = ngrams(h, w.first, n)
    doc = np.searchsorted(w.first, at, "right") - 1
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        g = np.concatenate([g, run_hashes(h, w.first[short], w.first[short + 1])])
        doc = np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    lead = np.ones(len(g), bool)
    lead[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[lead], doc[lead]
    return g, np.searchsorted(doc, np.arange(len(w.count) + 1))


def set_hashes(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; no two sets are expected to share both."""
    a = run_hashes(g, first[:-1], first[1:])
    b = run_hashes(mix(g ^ U(0xA0761D6478BD642F)), first[:-1], first[1:])
    return a.view(np.int64), b.view(np.int64)


def signatures(g: np.ndarray, first: np.ndarray, f: Forest) -> np.ndarray:
    """trees packed paths for each set; empty sets get zeros."""
    n = len(first) - 1
    out = np.zeros((n, f.trees), U)
    full = np.diff(first) > 0
    if not full.any():
        return out.view(np.int64)
    start = first[:-1][full]
    keys = np.random.default_rng(11).integers(0, 1 << 63, f.trees * f.depth, dtype=np.uint64) * U(2) + U(1)
    for t in range(f.trees):
        path = np.zeros(int(full.sum()), U)
        for d in range(f.depth):
            low = np.minimum.reduceat((g ^ keys[t * f.depth + d]) * keys[-1 - t * f.depth - d], start)
            path = (path << U(_BITS)) | (mix(low) >> U(64 - _BITS))
        out[full, t] = path
    return out.view(np.int64)


def signed(docs: DataFrame, f: Forest, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, h1, h2 (of its shingle set), n (shingles) and paths of each document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, first = shingle_sets(batch.column(text), f.shingle)
        a, b = set_hashes(g, first)
        paths = signatures(g, first, f)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, f.trees, dtype=np.int32)), pa.array(paths.reshape(-1)))
        return pa.RecordBatch.from_arrays([batch.column(doc_id), pa.array(a), pa.array(b), pa.array(np.diff(first).astype(np.int64)), flat], names=["doc_id", "h1", "h2", "n", "paths"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return map_texts(docs.select(doc_id, text), run, f"doc_id {kind}, h1 long, h2 long, n long, paths array<long>", text)


class Signed:
    """Texts of a task, by their signatures; last: the length of the last prefix of each."""

    def __init__(self, paths: np.ndarray, n: np.ndarray, f: Forest, last: np.ndarray):
        self.f, self.n, self.paths, self.last = f, n, paths, last
        steps = _BITS * np.arange(f.depth)
        self.values = ((paths[:, :, None] >> steps) & ((1 << _BITS) - 1)).astype(np.uint16).reshape(len(paths), -1)

    def plausible(self, a: np.ndarray, b: np.ndarray, tree: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs meet, first in that tree if one is given, with sizes and signatures that let them reach the threshold; and the agreement of those."""
        p = self.f.threshold_percent
        keep = np.flatnonzero((100 * self.n[a] >= p * self.n[b]) & (100 * self.n[b] >= p * self.n[a]))
        rest = _BITS * (self.f.depth - np.minimum(self.last[a[keep]], self.last[b[keep]]))
        met = (self.paths[a[keep]] ^ self.paths[b[keep]]) >> rest[:, None] == 0
        keep = keep[met.any(1) if tree is None else met.argmax(1) == tree[keep]]
        agree = (self.values[a[keep]] == self.values[b[keep]]).sum(1)
        good = agree >= self.f.agreement
        return keep[good], agree[good]


def pairs_within(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with one value in group, which is sorted, some at a time."""
    stop = np.searchsorted(group, group, "right")
    later = stop - np.arange(len(group)) - 1
    total = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(total, total[at] + _PAIRS, "right")) - 1)
        n = later[at:to]
        a = np.repeat(np.arange(at, to), n)
        yield a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        at = to


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n vertices' component over the edges a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (deeper := new[new]).tobytes() != new.tobytes():
            new = deeper
        if (new == root).all():
            return root
        root = new


_NODE = ["tree", "prefix", "i", "j"]


def in_nodes(mates: DataFrame, f: Forest, depth: int, carry: list[str], judge: Callable[[pa.Table, Signed, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch | None], schema: str) -> DataFrame:
    """judge over the plausible pairs of the forest at a depth that have an asking and an open text and aren't of one hub: it gets the texts of whole nodes, and the pairs with their agreement.

    mates: vertex, tree, n, paths, closed, hub (null: none), asking and the columns to carry.  The texts of a node of many are cut into
    blocks by their kind, and only blocks that have pairs to list meet.  The members of the hub that most in a node are of are one kind.
    """
    # Kinds in an order in which the kinds that each meets are neighbours: open ones that don't ask, open and asking, closed and asking, closed ones that don't ask.
    kind = F.when(F.col("closed"), F.when(F.col("asking"), 2).otherwise(3)).otherwise(F.when(F.col("asking"), 1).otherwise(0))
    rows = mates.withColumns({"prefix": F.shiftright(F.get("paths", F.col("tree")), _BITS * (f.depth - depth)), "kind": kind})
    each = rows.groupBy("tree", "prefix", "hub").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("kind") == k).alias(f"n{k}") for k in range(4)])
    most = F.max(F.when(F.col("hub").isNotNull(), F.struct("n", "hub", *[f"n{k}" for k in range(4)]))).alias("most")
    node = each.groupBy("tree", "prefix").agg(F.sum("n").alias("met"), most, *[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)])
    n = [F.col(f"n{k}") - F.coalesce(F.col(f"most.n{k}"), F.lit(0)) for k in range(4)] + [F.coalesce("most.n", F.lit(0))]
    sizes = [F.ceil(x / f.node_docs).cast("int") for x in n]
    ends = F.array(*[sum(sizes[:k], F.lit(0)) for k in range(6)]).alias("ends")
    some = (n[1] > 0) | ((n[0] > 0) & (n[2] > 0)) | ((n[4] > 0) & (n[4] < F.col("met")))
    nodes = node.where((F.col("met") > 1) & some).select("tree", "prefix", ends, F.col("most.hub").alias("main"), (F.col("met") > f.node_docs).alias("large"))
    rows = rows.join(nodes, ["tree", "prefix"]).withColumn("kind", F.when(F.col("hub") == F.col("main"), 4).otherwise(F.col("kind")))
    start, stop = F.get("ends", F.col("kind")), F.get("ends", F.col("kind") + 1)
    own = F.when(F.col("large"), start + F.pmod(F.xxhash64("vertex"), stop - start)).otherwise(0).cast("int")
    low = F.element_at(F.expr("array(ends[1], 0, 0, ends[1], 0)"), F.col("kind") + 1)
    high = F.element_at(F.expr("array(ends[3], ends[4], ends[2], ends[2], ends[4])"), F.col("kind") + 1)
    upto = lambda x, y: F.when(y > x, F.sequence(x, y - 1)).otherwise(F.array().cast("array<int>"))
    main = F.when(F.col("kind") < 4, upto(F.get("ends", F.lit(4)), F.get("ends", F.lit(5)))).otherwise(F.array().cast("array<int>"))
    others = F.when(~F.col("large"), F.array(F.lit(0))).otherwise(F.concat(upto(low, high), main))
    dealt = rows.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("tree", "prefix", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "closed", "asking", F.coalesce("hub", "vertex").alias("hub"), "vertex", "n", "paths", *carry)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in _NODE])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
            if len(new):  # the last node may go on in the next batch
                yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]) + 1)])
                held = [batch.slice(int(new[-1]) + 1)]
            else:
                held.append(batch)
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole(batches):
            keys = np.stack([t.column(k).to_numpy() for k in _NODE])
            group = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])
            paths = t.column("paths").combine_chunks().flatten().to_numpy().reshape(-1, f.trees)
            texts = Signed(paths, t.column("n").to_numpy(), f, np.full(len(paths), depth))
            own, hub, closed, asking = (t.column(k).to_numpy() for k in ("own", "hub", "closed", "asking"))
            found = []
            for a, b in pairs_within(group):
                across = (keys[2][a] == keys[3][a]) | (own[a] != own[b])
                across &= ~(closed[a] & closed[b]) & (asking[a] | asking[b]) & (hub[a] != hub[b])
                a, b = a[across], b[across]
                at, agree = texts.plausible(a, b, keys[0][a])
                found.append((a[at], b[at], agree))
            a, b, agree = (np.concatenate(x) for x in zip(*found))
            out = judge(t, texts, a, b, agree) if len(a) else None
            if out is not None:
                yield out
            release()

    return dealt.repartition(*_NODE).sortWithinPartitions(*_NODE).mapInArrow(run, schema)


def search(mates: DataFrame, f: Forest) -> tuple[DataFrame, DataFrame]:
    """Edges that hold clusters of plausible pairs together, and the last prefix (vertex, last) of every text that ended before the shortest.

    mates: vertex, tree, n, paths, closed and hub; without closed all are open, without hub none has one.
    """
    spark = mates.sparkSession
    if "closed" not in mates.columns:
        mates = mates.withColumn("closed", F.lit(False))
    if "hub" not in mates.columns:
        mates = mates.withColumn("hub", F.lit(None).cast("long"))

    def judge(t: pa.Table, texts: Signed, a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
        vertex = t.column("vertex").to_numpy()
        names, at = np.unique(vertex, return_inverse=True)
        a, b = at[a], at[b]
        s = agree / texts.values.shape[1]
        likely = s >= f.threshold_percent / 100
        weight = likely / meeting(s, int(texts.last[0]), f)
        n = len(names)
        found = np.bincount(a, likely, n) + np.bincount(b, likely, n)
        stands = np.bincount(a, weight, n) + np.bincount(b, weight, n)
        root = joined(n, a, b)
        some = np.unique(np.concatenate([a, b]))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (names[some], names[root[some]], found[some], stands[some])], names=["vertex", "other", "found", "stands"])

    edges, ended = [], []
    ends = spark.createDataFrame([], "vertex long, last int")
    for depth in range(f.depth, f.shortest - 1, -1):
        asking = mates.join(ends, "vertex", "left").withColumn("asking", F.col("last").isNull()) if ended else mates.withColumn("asking", F.lit(True))
        edges.append(written(in_nodes(asking, f, depth, [], judge, "vertex long, other long, found double, stands double")))
        if depth > f.shortest:
            missed = 1 / meeting(f.threshold_percent / 100, depth, f) - 1
            own = edges[-1].groupBy("vertex").agg(F.sum("found").alias("found"), F.sum("stands").alias("stands")).where(F.col("found") >= f.target_recall * (F.col("stands") + missed)).where("found > 0")
            ended.append(written(own.join(ends, "vertex", "left_anti").select("vertex", F.lit(depth).alias("last"))))
            ends = reduce(DataFrame.unionAll, ended)
    return reduce(DataFrame.unionAll, edges).select("vertex", "other"), ends


def closed_texts(crowded: DataFrame, content: Callable[[DataFrame, Callable[[pa.RecordBatch], pa.RecordBatch], str], DataFrame], text: str, f: Forest) -> DataFrame:
    """vertex of the crowded texts (vertex, n) that have too many shingles of their own to be linked with each other.

    Linked texts of sizes x and y share at least p (x + y) / (100 + p) shingles, so one of them shares 2 p / (100 + p) of its own.
    content: the documents of texts, run through a function.
    """
    total = crowded.agg(F.sum("n")).first()[0]
    segments = -(-total // f.count_shingles)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, first = shingle_sets(batch.column(text), f.shingle)
        vertex, _ = set_hashes(g, first)
        doc = np.repeat(np.arange(len(vertex)), np.diff(first))
        segment = ((g >> U(32)) * U(segments) >> U(32)).astype(np.int32)  # ascending in a text, as its shingles are
        lead = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (segment[1:] != segment[:-1])])) if len(g) else np.zeros(0, np.int64)
        runs = pa.ListArray.from_arrays(pa.array(np.append(lead, len(g)).astype(np.int32)), pa.array(g.view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(vertex[doc[lead]]), pa.array(segment[lead]), runs], names=["holder", "segment", "shingles"])

    # One shuffle of the hashes, in runs; they are counted where they lie.  Texts that come along by an equal id only make shingles count as shared.
    tasks = max(segments, int(crowded.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = content(crowded, run, "holder long, segment int, shingles array<long>").repartition(tasks, "segment").select("segment", "holder", F.explode("shingles").alias("shingle"))
    alone = rows.groupBy("segment", "shingle").agg(F.min("holder").alias("holder"), F.max("holder").alias("most")).where("holder = most")
    own = alone.groupBy("holder").agg(F.count(F.lit(1)).alias("own"))
    p = f.threshold_percent
    return crowded.join(own, F.col("vertex") == F.col("holder")).where((100 + p) * (F.col("n") - F.col("own")) < 2 * p * F.col("n")).select("vertex")


def links_of(sets: list[np.ndarray], side: np.ndarray, percent: int, met: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set the number of links, and the root of its tree in a spanning forest of the links.

    side: pairs of sets on one side are compared if all are on it, else only pairs across.  met: the places of pairs to compare, else all.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    of = np.repeat(np.arange(n), size)
    unique, column, seen = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1  # only shingles of several sets need a bit
    told = seen[column] > 1
    column, of = shared[column[told]], of[told]
    words = (int((seen > 1).sum()) + 63) // 64
    bits = np.zeros((n, max(1, words)), U)
    np.bitwise_or.at(bits, (of, column >> 6), np.left_shift(U(1), (column & 63).astype(U)))
    links = np.zeros(n, np.int64)
    across = len(np.unique(side)) > 1
    left = np.flatnonzero(side == side.min()) if across else np.arange(n)
    right = np.flatnonzero(side != side.min()) if across else None
    rows = max(1, (1 << 21) // (8 * bits.shape[1]))
    linked = []
    for i in left:
        other = right if across else np.arange(i + 1, n)
        # A Jaccard similarity of p % needs sizes within p %.
        other = other[(100 * size[other] >= percent * size[i]) & (100 * size[i] >= percent * size[other])]
        if met is not None and len(other):
            other = other[met(np.full(len(other), i), other)]
        for k in range(0, len(other), rows):
            part = other[k : k + rows]
            both = np.bitwise_count(bits[part] & bits[i]).sum(1, dtype=np.int64)
            hit = part[100 * both >= percent * (size[i] + size[part] - both)]
            links[i] += len(hit)
            links[hit] += 1
            linked.append((np.full(len(hit), i), hit))
    a, b = (np.concatenate(x) for x in zip(*linked)) if linked else (np.zeros(0, np.int64),) * 2
    return links, joined(n, a, b)


def block_tasks(mates: DataFrame, cluster: DataFrame, sets: DataFrame, f: Forest, ends: DataFrame) -> DataFrame:
    """root, i, j, own and vertex: the texts of each pair of blocks of each cluster; clusters of one block have i = j = 0."""
    member = cluster.join(sets.select(F.col("h1").alias("vertex"), "n"), "vertex")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / f.block_docs), F.ceil(F.sum("n") / f.block_shingles)).cast("int")
    sizes = written(member.groupBy("root").agg(F.count(F.lit(1)).alias("members"), blocks.alias("blocks")))
    large = sizes.where("blocks > 1")
    small = cluster.join(sizes.where("blocks = 1").select("root"), "root").select("root", *[F.lit(0).alias(x) for x in ("i", "j", "own")], "vertex")
    if large.isEmpty():
        return small
    # Blocks by rank in the cluster: the place among all members less that of the cluster's first.
    placed = numbered(cluster.join(large, "root"), "place", F.col("root"), F.col("vertex"))
    first = placed.groupBy("root").agg(F.min("place").alias("start"))
    block = F.floor((F.col("place") - F.col("start")) * F.col("blocks") / F.col("members")).cast("int")
    ranked = written(placed.join(first, "root").select("root", "vertex", block.alias("block")))

    def judge(t: pa.Table, texts: Signed, a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pa.RecordBatch:
        root, block, vertex = (t.column(x).to_numpy() for x in ("root", "block", "vertex"))
        met = np.unique(np.stack([np.concatenate([a, b]), block[np.concatenate([b, a])]]).astype(np.int64), axis=1)
        text, start = np.unique(met[0], return_index=True)
        partners = pa.ListArray.from_arrays(pa.array(np.append(start, met.shape[1]).astype(np.int32)), pa.array(met[1].astype(np.int32)))
        return pa.RecordBatch.from_arrays([pa.array(root[text]), pa.array(block[text].astype(np.int32)), pa.array(vertex[text]), partners], names=["root", "own", "vertex", "partners"])

    # A row for each text of a node, with the blocks of its partners there; at most trees of them meet for each text.
    members = mates.join(ranked, "vertex").join(ends, "vertex", "left").withColumn("last", F.coalesce("last", F.lit(f.shortest)))
    told = reduce(DataFrame.unionAll, [
        in_nodes(members.where(F.col("last") >= d).withColumn("asking", F.col("last") == d), f, d, ["root", "block"], judge, "root long, own int, vertex long, partners array<int>")
        for d in range(f.depth, f.shortest - 1, -1)
    ])
    told = told.groupBy("root", "own", "vertex").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")).withColumn("other", F.explode("partners"))
    return small.unionByName(told.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "vertex"))


def classes(docs: DataFrame, f: Forest = Forest(), text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The documents (doc_id, h1, h2, n), and the sets (h1, h2, least_id, n_copies, n_links, class_vertex)."""
    rows = written(signed(docs, f, text, doc_id))
    sets = written(rows.where("n > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_copies"), F.first("n").alias("n"), F.first("paths").alias("paths")))
    # Texts that meet no other at the shortest prefix meet none at a longer one.
    drop = _BITS * (f.depth - f.shortest)
    nodes = sets.select(F.col("h1").alias("vertex"), F.posexplode("paths").alias("tree", "path")).select("vertex", "tree", F.shiftright("path", drop).alias("prefix"))
    shared = nodes.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    met = written(nodes.join(shared, ["tree", "prefix"]).select("vertex", "tree", "met"))

    def content(texts: DataFrame, run: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
        """run over one document of each set; documents that share its id come along."""
        ids = written(texts.join(sets.select(F.col("h1").alias("vertex"), F.col("least_id").alias("w_id")), "vertex").select("w_id").distinct())
        n, size = ids.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col("w_id").cast("string")))).first()
        few = n <= f.broadcast_rows and (size or 0) <= f.broadcast_bytes  # else the texts are shuffled to the ids
        chosen = docs.select(doc_id, text).join(F.broadcast(ids) if few else ids, F.col(doc_id).eqNullSafe(F.col("w_id")), "left_semi")
        return map_texts(chosen.select(text), run, schema, text)

    # The shingles of sets, from one document of each.
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, first = shingle_sets(batch.column(text), f.shingle)
        a, b = set_hashes(g, first)
        parts = [g[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(parts, pa.binary())], names=["s1", "s2", "shingles"])

    mates = met.join(sets.select(F.col("h1").alias("vertex"), "n", "paths"), "vertex")
    crowded = written(mates.where(F.col("met") > min(f.node_docs, f.hub_node)).groupBy("vertex").agg(F.first("n").alias("n"), F.max("met").alias("most")))
    if crowded.isEmpty():
        members = None
        mates = written(mates.drop("met").withColumns({"closed": F.lit(False), "hub": F.lit(None).cast("long")}))
    else:
        large = crowded.where(F.col("most") > f.node_docs).select("vertex", "n")
        closed = large.select("vertex") if large.isEmpty() else written(closed_texts(large, content, text, f))
        marks = crowded.select("vertex").join(closed.withColumn("closed", F.lit(True)), "vertex", "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
        crowd = mates.where(F.col("met") > f.hub_node).join(marks, "vertex").select("vertex", "tree", F.get("paths", F.col("tree")).alias("path"), (~F.col("closed")).alias("open"))
        crowd = shared_nodes(crowd.withColumn("node", F.xxhash64("tree", F.shiftright("path", drop))), f)
        likely = crowd.select("vertex").distinct().join(sets.select(F.col("h1").alias("vertex"), "h1", "h2"), "vertex")
        told = content(likely.select("vertex"), run, "s1 long, s2 long, shingles binary").join(likely, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")))
        members = members_of(crowd, written(told.select("vertex", "shingles").dropDuplicates(["vertex"])), f)
        marks = written(marks.join(members.select("vertex", "hub"), "vertex", "left"))
        mates = written(mates.drop("met").join(marks, "vertex", "left").withColumn("closed", F.coalesce("closed", F.lit(False))))
    edges, ends = search(mates, f)
    cluster = components(edges.select(F.col("vertex").alias("a"), F.col("other").alias("b")))
    tasks = block_tasks(mates, cluster, sets, f, ends).join(sets.select(F.col("h1").alias("vertex"), "h1", "h2", "n", "paths"), "vertex").join(ends, "vertex", "left")
    tasks = tasks.withColumn("hub", F.col("vertex")) if members is None else tasks.join(members.select("vertex", "hub"), "vertex", "left").withColumn("hub", F.coalesce("hub", "vertex"))

    told = content(cluster.select("vertex"), run, "s1 long, s2 long, shingles binary")
    percent = f.threshold_percent

    def compare(group: pa.Table) -> pa.Table:
        h1, h2 = group.column("h1").to_numpy(), group.column("h2").to_numpy()
        _, at = np.unique(np.stack([h1, h2]), axis=1, return_index=True)  # repeated rows bring a set twice
        sets = [np.frombuffer(group.column("shingles")[int(k)].as_py(), U) for k in at]
        side = group.column("own").to_numpy()[at]
        paths = group.column("paths").combine_chunks().flatten().to_numpy().reshape(-1, f.trees)[at]
        texts = Signed(paths, group.column("n").to_numpy()[at], f, group.column("last").fill_null(f.shortest).to_numpy()[at])
        hub = group.column("hub").to_numpy()[at]

        def met(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            apart = np.flatnonzero(hub[a] != hub[b])
            return apart[texts.plausible(a[apart], b[apart])[0]]

        if group.column("i")[0].as_py() != group.column("j")[0].as_py() and len(np.unique(side)) < 2:
            links, root = np.zeros(len(at), np.int64), np.arange(len(at))
        else:
            links, root = links_of(sets, side, percent, met)
        v = h1[at]
        release()
        return pa.table({"vertex": v, "other": v[root], "links": links})

    filled = tasks.join(told, (F.col("h1") == F.col("s1")) & (F.col("h2") == F.col("s2")))
    compared = written(filled.groupBy("root", "i", "j").applyInArrow(compare, "vertex long, other long, links long"))
    if members is not None:
        compared = compared.unionAll(written(links_within(members, f)))
    links = compared.groupBy("vertex").agg(F.sum("links").alias("n_links"))
    roots = components(compared.where("vertex != other").select(F.col("vertex").alias("a"), F.col("other").alias("b")))
    told = links.join(roots, "vertex", "left")
    out = sets.drop("paths").join(told, F.col("h1") == F.col("vertex"), "left")
    return rows.drop("paths"), out.select("h1", "h2", "least_id", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "h1").alias("class_vertex"))


def near_duplicates(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """doc_id, class_id, n_links (other texts at or above the threshold) and n_copies (documents with its shingle set)."""
    rows, sets = classes(docs, f)
    names = sets.groupBy("class_vertex").agg(F.min("least_id").alias("class_id"))
    told = sets.join(names, "class_vertex").select("h1", "h2", "class_id", "n_links", "n_copies")
    alone = F.col("n") == 0
    return rows.join(told, ["h1", "h2"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def keep_one(docs: DataFrame, f: Forest = Forest()) -> DataFrame:
    """Of each class the document with the least doc_id, in docs' columns; texts without words all stay.

    Of rows with one id and one shingle set, that with the least text stays, then that with the least hash of its columns.
    """
    columns = docs.columns
    plain = docs.toDF(*[f"_{i}" for i in range(len(columns))])
    text, doc_id = (f"_{columns.index(c)}" for c in ("text", "doc_id"))
    _, sets = classes(plain, f, text, doc_id)
    best = sets.groupBy("class_vertex").agg(F.min(F.struct(F.col("least_id").isNull().alias("none"), "least_id", "h1", "h2")).alias("best")).select("best.least_id", F.col("best.h1").alias("k1"), F.col("best.h2").alias("k2"))
    names = plain.columns
    head = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in plain.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        g, first = shingle_sets(batch.column(text), f.shingle)
        a, b = set_hashes(g, first)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(a), pa.array(b), pa.array(np.diff(first).astype(np.int64))], names=[*names, "h1", "h2", "n"])

    hashed = map_texts(plain, run, f"{head}, h1 long, h2 long, n long", text)
    on = (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")) & F.col(doc_id).eqNullSafe(F.col("least_id"))
    chosen = hashed.where("n > 0").join(best, on).withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(text, F.xxhash64(*names)))).where("nth = 1")
    return hashed.where("n = 0").select(*names).unionAll(chosen.select(*names)).toDF(*columns)
