"""A Merkle manifest of a data set: a tree for each source, and one over their roots.

Leaves are hashed by Spark, sorted by source and document over all tasks, and numbered.  Each partition folds every run of siblings that it
holds whole, at all levels, and keeps what is unresolved: nodes keyed by tree, level and index.  Such fragments are a monoid: two are merged
by putting their nodes together and folding each run whose siblings are then all there; how many there must be is known from
the tree's size.  The reduction goes up as a tree over groups of neighbouring partitions, a table for each round, so nothing but the root
comes to the driver.  A fragment has at most a run's nodes at both ends of each level, whatever the size of the input.

A run that is resolved in a round is a row of that round's table.  Proofs take the siblings inside a partition from the partition, and those
beyond it from these rows, joined by the keys of the runs above the partition's unresolved nodes.

Defined cases: a null field is `-` in a leaf; a null doc_id comes first and is the empty text for crc32; rows with one doc_id are ordered by leaf; equal
rows are leaves of their own; a null source is a source, before all others; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import crc_mod, written
from linkloom.session import cut

HEX = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SOURCES, DOCUMENTS = 0, 1  # the tree over the sources' roots, and the trees of documents


@dataclass(frozen=True)
class Merkle:
    arity: int = 16
    leaves_per_part: int = 100_000
    merged_parts: int = 16
    tampered_every: int = 5


def digest(data: bytes) -> bytes:
    return sha256(data).hexdigest().encode()


def leaf_of(**values: Column) -> Column:
    """The hash of the fields in their order, each with its length in bytes before it; null without one."""
    told = [F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string"))) for v in values.values()]
    return F.sha2(F.encode(F.concat(*told), "UTF-8"), 256)


def leaves(docs: DataFrame, m: Merkle = Merkle()) -> DataFrame:
    """doc_id, source, leaf and claimed: the leaf of the document as it is delivered, with its text changed where it is tampered with."""
    fields = {c: F.col(c) for c in _FIELDS}
    delivered = F.when(crc_mod(F.col("doc_id"), m.tampered_every) == 0, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    return docs.select("doc_id", "source", leaf_of(**fields).alias("leaf"), leaf_of(**(fields | {"text": delivered})).alias("claimed"))


@dataclass
class Run:
    """Consecutive nodes of one tree from an index on, and what can be folded of them: for each level the first index and the digests."""

    tree: int
    rank: int
    size: int
    start: int
    nodes: bytes
    arity: int
    levels: list[tuple[int, bytes]] = field(default_factory=list)

    def __post_init__(self) -> None:
        first, nodes, size, k = self.start, self.nodes, self.size, self.arity
        self.levels.append((first, nodes))
        while size > 1:
            stop = first + len(nodes) // HEX
            low, high = -(-first // k), (stop // k if stop < size else -(-size // k))
            above = [digest(nodes[HEX * (r * k - first) : HEX * (min(r * k + k, size) - first)]) for r in range(low, high)]
            first, nodes, size = low, b"".join(above), -(-size // k)
            self.levels.append((first, nodes))

    @property
    def top(self) -> bytes | None:
        return self.levels[-1][1] or None

    def children(self, level: int, run: int, size: int) -> bytes | None:
        """The siblings of a run if all are here."""
        first, nodes = self.levels[level]
        a, b = run * self.arity, min(run * self.arity + self.arity, size)
        return nodes[HEX * (a - first) : HEX * (b - first)] if a >= first and HEX * (b - first) <= len(nodes) else None

    def unresolved(self) -> Iterator[tuple[int, int, int, int, int, bytes]]:
        """tree, rank, size of the level, level, index and digest of the nodes whose run isn't whole here."""
        size = self.size
        for level, (first, nodes) in enumerate(self.levels):
            for i in range(first, first + len(nodes) // HEX):
                if size > 1 and self.children(level, i // self.arity, size) is None:
                    at = HEX * (i - first)
                    yield self.tree, self.rank, size, level, i, nodes[at : at + HEX]
            size = -(-size // self.arity)


def merge(nodes: list[tuple[int, int, int, int, int, bytes]], sources: int, arity: int) -> tuple[list, list]:
    """The monoid's sum: the unresolved nodes of fragments put together, and the runs that this resolves (tree, rank, level, run, siblings).

    A source's root becomes a node of the tree over the sources; the last root has a size of 1.
    """
    held: dict[tuple[int, int, int, int, int], dict[int, bytes]] = {}
    runs, roots, todo = [], [], list(nodes)
    while todo:
        tree, rank, size, level, i, h = todo.pop()
        if size == 1:
            if tree == SOURCES:
                roots.append((tree, rank, size, level, i, h))
            else:
                todo.append((SOURCES, 0, sources, 0, rank, h))
            continue
        key = (tree, rank, size, level, i // arity)
        here = held.setdefault(key, {})
        here[i] = h
        if len(here) == min(arity, size - i // arity * arity):
            siblings = b"".join(here[j] for j in sorted(here))
            runs.append((tree, rank, level, i // arity, siblings))
            todo.append((tree, rank, -(-size // arity), level + 1, i // arity, digest(siblings)))
            del held[key]
    left = [(*key[:4], i, h) for key, here in held.items() for i, h in here.items()]
    return left + roots, runs


@dataclass(frozen=True)
class Place:
    """Where a partition begins: its first source's rank, that source's leaves before it, and the sizes of its first and last source."""

    rank: int
    before: int
    first_size: int
    last_size: int


def _segments(source: list) -> list[tuple[int, int]]:
    """Beginnings and ends of the rows of each source."""
    cuts = [0, *[k for k in range(1, len(source)) if source[k] != source[k - 1]], len(source)]
    return list(zip(cuts[:-1], cuts[1:])) if source else []


def _sorted_leaves(docs: DataFrame, m: Merkle) -> tuple[DataFrame, dict[int, Place], int]:
    """The leaves by source and document with their partition, each partition's place, and the number of sources."""
    rows = written(leaves(docs, m)).withColumn("nth", F.monotonically_increasing_id())  # so that equal rows can be in several partitions
    order = ["source", "doc_id", "leaf", "nth"]
    parts = max(1, -(-rows.count() // m.leaves_per_part))
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)).withColumn("part", F.spark_partition_id())

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, part = [], [], None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                source = batch.column("source").to_pylist()
                for a, b in _segments(source):
                    if names and names[-1] == source[a]:
                        counts[-1] += b - a
                    else:
                        names.append(source[a])
                        counts.append(b - a)
        if names:
            values = [[part], [names[0]], [names[-1]], [len(names)], [counts[0]], [counts[-1]]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["part", "first", "last", "sources", "first_n", "last_n"])

    found = sorted(rows.select("part", "source").mapInArrow(edges, "part int, first string, last string, sources long, first_n long, last_n long").collect(), key=lambda r: r.part)  # a row for each partition
    totals: list[int] = []  # by rank, of the sources at the edges of partitions
    starts, last, rank = [], (), -1
    size: dict[int, int] = {}
    for r in found:
        if (r.first,) != last:
            rank += 1
        starts.append((r.part, rank, size.get(rank, 0)))
        size[rank] = size.get(rank, 0) + r.first_n
        if r.sources > 1:
            rank += r.sources - 1
            size[rank] = r.last_n
        last = (r.last,)
    places = {part: Place(low, before, size[low], size[low + r.sources - 1]) for (part, low, before), r in zip(starts, found)}
    return rows, places, rank + 1


def _local(part: int, source: list, digests: list[bytes], places: dict[int, Place], sources: int, m: Merkle) -> tuple[list[tuple[int, int, Run]], Run]:
    """The runs of a partition's sources with their rows, and that of the roots of those that are whole here."""
    place, cuts = places[part], _segments(source)
    own, roots = [], []
    for k, (a, b) in enumerate(cuts):
        size = place.first_size if k == 0 else place.last_size if k == len(cuts) - 1 else b - a
        run = Run(DOCUMENTS, place.rank + k, size, place.before if k == 0 else 0, b"".join(digests[a:b]), m.arity)
        own.append((a, b, run))
        if run.top:
            roots.append((run.rank, run.top))
    start = roots[0][0] if roots else 0
    return own, Run(SOURCES, 0, sources, start, b"".join(h for _, h in roots), m.arity)


_KEY = ["tree", "rank", "level", "run"]
_FRAGMENT = "part int, tree int, rank long, size long, level int, place long, digest binary"


def _fragments(rows: DataFrame, places: dict[int, Place], sources: int, m: Merkle) -> DataFrame:
    """The unresolved nodes of each partition."""
    told = rows.sparkSession.sparkContext.broadcast(places)  # a few numbers for each partition

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, digests, part = [], [], None
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                source += batch.column("source").to_pylist()
                digests += batch.column("leaf").cast(pa.binary()).to_pylist()
        if source:
            own, roots = _local(part, source, digests, told.value, sources, m)
            nodes = [n for r in (*(x[2] for x in own), roots) for n in r.unresolved()]
            if sources == 1 and roots.top:
                nodes = [(SOURCES, 0, 1, 0, 0, roots.top)]
            elif roots.size > 1 and roots.top:
                nodes = [(SOURCES, 0, 1, len(roots.levels) - 1, 0, roots.top)]
            yield pa.RecordBatch.from_pandas(pd.DataFrame([(part, *n) for n in nodes], columns=["part", "tree", "rank", "size", "level", "place", "digest"]), schema=pa.schema([("part", pa.int32()), ("tree", pa.int32()), ("rank", pa.int64()), ("size", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.binary())]), preserve_index=False)

    return written(rows.select("part", "source", "leaf").mapInArrow(fold, _FRAGMENT))


def _reduced(fragments: DataFrame, parts: int, sources: int, m: Merkle) -> tuple[DataFrame, bytes]:
    """The runs that the reduction resolves, and the root."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        nodes = list(group[["tree", "rank", "size", "level", "place", "digest"]].itertuples(index=False, name=None))
        left, runs = merge(nodes, sources, m.arity)
        part = int(group["part"].iloc[0])
        out = [(part, t, r, s, lv, i, h, None) for t, r, s, lv, i, h in left] + [(part, t, r, 0, lv, i, None, c) for t, r, lv, i, c in runs]
        return pd.DataFrame(out, columns=["part", "tree", "rank", "size", "level", "place", "digest", "siblings"])

    rounds, now = [], fragments
    while True:
        parts = -(-parts // m.merged_parts)
        grouped = now.withColumn("part", F.floor(F.col("part") / m.merged_parts).cast("int"))
        done = written(grouped.groupBy("part").applyInPandas(add, _FRAGMENT + ", siblings binary"))
        rounds.append(done.where("siblings is not null").select("tree", "rank", "level", F.col("place").alias("run"), "siblings"))
        now = done.where("siblings is null").drop("siblings")
        if parts <= 1:
            break
    runs = rounds[0]
    for r in rounds[1:]:
        runs = runs.unionByName(r)
    left = now.limit(2).collect()
    if len(left) != 1 or left[0].size != 1:
        raise RuntimeError("the forest did not come to one root")
    return runs, bytes(left[0].digest)


def _needs(fragments: DataFrame, sources: int, m: Merkle) -> DataFrame:
    """part and the keys of the runs over each partition's unresolved nodes, up to the root."""

    def above(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for part, tree, rank, size, level, i in zip(*(batch.column(c).to_pylist() for c in ("part", "tree", "rank", "size", "level", "place"))):
                while size > 1 or tree == DOCUMENTS:
                    if size == 1:  # the source's root
                        tree, rank, size, level, i = SOURCES, 0, sources, 0, rank
                        continue
                    found.add((part, tree, rank, level, i // m.arity))
                    size, level, i = -(-size // m.arity), level + 1, i // m.arity
            rows = list(zip(*found)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["part", *_KEY])

    return fragments.mapInArrow(above, "part int, tree int, rank long, level int, run long").distinct()


class Proofs:
    """The ways up from the leaves of one partition; beyond: siblings of runs that are not whole in it."""

    def __init__(self, roots: Run, beyond: dict[tuple[int, int, int, int], bytes], m: Merkle):
        self.roots, self.beyond, self.k = roots, beyond, m.arity

    def steps(self, run: Run, level: int, i: int) -> Iterator[tuple[bytes, bytes]]:
        """The siblings before and after a node and each one above it."""
        size = run.size
        for _ in range(level):
            size = -(-size // self.k)
        while size > 1:
            siblings = run.children(level, i // self.k, size) or self.beyond[run.tree, run.rank, level, i // self.k]
            at = HEX * (i % self.k)
            yield siblings[:at], siblings[at + HEX :]
            size, level, i = -(-size // self.k), level + 1, i // self.k
        if run.tree == DOCUMENTS:
            yield from self.steps(self.roots, 0, run.rank)

    def subroot(self, run: Run, root: bytes) -> bytes:
        if run.top or self.roots.size == 1:
            return run.top or root
        at = HEX * (run.rank % self.k)
        return self.beyond[SOURCES, 0, 0, run.rank // self.k][at : at + HEX]


def manifest(docs: DataFrame, m: Merkle = Merkle()) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document."""
    rows, places, sources = _sorted_leaves(docs, m)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not places:
        return rows.sparkSession.createDataFrame([], schema)
    fragments = _fragments(rows, places, sources, m)
    runs, root = _reduced(fragments, max(places) + 1, sources, m)
    beyond = _needs(fragments, sources, m).join(runs, _KEY).select("part", *_KEY, "siblings")
    told = rows.sparkSession.sparkContext.broadcast(places)

    def prove(own: pa.Table, other: pa.Table) -> pa.Table:
        own = own.sort_by("place")
        digests = own.column("leaf").cast(pa.binary()).to_pylist()
        claimed = own.column("claimed").cast(pa.binary()).to_pylist()
        local, roots = _local(own.column("part")[0].as_py(), own.column("source").to_pylist(), digests, told.value, sources, m)
        known = dict(zip(zip(*(other.column(c).to_pylist() for c in _KEY)), other.column("siblings").to_pylist()))
        proofs, out = Proofs(roots, known, m), []
        for a, b, run in local:
            subroot, above, tail = proofs.subroot(run, root), None, []
            for k in range(a, b):
                i = run.start + k - a
                if run.size == 1:
                    way = list(proofs.steps(run, 0, i))
                else:
                    if i // m.arity != above:  # siblings share all but the first step
                        above = i // m.arity
                        tail = list(proofs.steps(run, 0, i))[1:]
                    way = [next(proofs.steps(run, 0, i)), *tail]
                folded = claimed[k]
                for left, right in way:
                    folded = digest(left + folded + right)
                out.append((subroot, digest(b"".join(x + y for x, y in way)), folded))
        columns = [pa.array([x.decode() for x in c], pa.string()) for c in zip(*out)]
        told_root = pa.array([root.decode()] * len(out), pa.string())
        good = pa.array([x[2] == root for x in out])
        return pa.table([own.column("doc_id"), own.column("leaf"), columns[0], told_root, columns[1], columns[2], good], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    placed = rows.withColumn("place", F.monotonically_increasing_id())
    return placed.groupBy("part").cogroup(beyond.groupBy("part")).applyInArrow(prove, schema)
