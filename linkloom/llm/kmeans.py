"""Clustering of vectors around centroids, with Drake's adaptive bounds.

Vectors are integers; all sums and distances are exact.  A snapshot keeps for each vector its nearest centroids in order, the
distance to the nearest as an upper bound, distances to the next `near` of them as lower bounds, and one more for all the rest.  In a later
round centroids have moved: the upper bound grows and each lower bound falls by how far its centroid now is from where it was in the
snapshot, the remainder's by the farthest move of the rest.  While the upper bound is under all lower bounds the order is certified and the
vector stays.  Else its true distances to the tracked centroids, as far as their bounds don't certify, are computed, and where the
remainder bound doesn't certify either the vector is rescanned exactly.  Bounds hold by a margin far above the rounding of doubles, so ties
are never certified and are settled by exact distances.

Vectors and bounds are one table; a round reads it and returns sums by cluster.  So rounds write nothing but when over
`rescans_percent` of the vectors had to be rescanned: the next round then takes a new snapshot, whose number of bounds is as many as
`covered_percent` of the vectors needed, and the old one is deleted.  The driver holds the centroids only.

Defined cases: a vector that is null, has another number of components, or a null or non-finite one is left out; repeated rows
count each; a null vec_id is an empty one in the choice of the first centroids, where ties go to the lesser bytes; with fewer vectors than
clusters each vector is a centroid at first; no vectors give no rows; further columns are ignored.  A component beyond +-2^27 after scaling is an error, as its squared
distances need not fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.common import forget, own_columns, written
from linkloom.llm.tokens import release

_MOST = 1 << 27
_EXACT = 1 << 22  # products of such components add up exactly in doubles
_MARGIN = 1e-9
_ROWS = 1 << 14


@dataclass(frozen=True)
class Clustering:
    clusters: int = 8
    components: int = 64
    rounds: int = 10
    scale: int = 1024
    seed: int = 3
    near: int = 3
    rescans_percent: int = 20
    covered_percent: int = 99


def whole_vectors(embeddings: DataFrame, c: Clustering) -> DataFrame:
    """vec_id and v (its components' integers as bytes) of the vectors that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("embedding")
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(e), c.components), False))
            flat = batch.column("embedding").flatten().cast(pa.float64())
            x = flat.to_numpy(zero_copy_only=False).reshape(-1, c.components)  # nulls become NaN
            good = np.isfinite(x).all(1)
            if not good.any():
                continue
            scaled = np.floor(c.scale * x[good])
            if np.abs(scaled).max() > _MOST:
                raise ValueError(f"a component beyond {_MOST // c.scale}: squared distances need not fit a long")
            rows = np.ascontiguousarray(scaled, "<i4")
            v = pa.Array.from_buffers(pa.binary(4 * c.components), len(rows), [None, pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(good)), v.cast(pa.binary())], names=["vec_id", "v"])

    given = own_columns(embeddings, "vec_id", "embedding").where(F.size("embedding") == c.components)
    return given.mapInArrow(run, f"vec_id {embeddings.schema['vec_id'].dataType.simpleString()}, v binary")


def _matrix(column: pa.Array, width: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer vectors to centroids."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= _EXACT:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x.astype(np.int64) - k) ** 2).sum(1) for k in centroids], axis=1)


def nearest(x: np.ndarray, centroids: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the centroids in order of distance (ties: number), as many as are tracked, and bounds: theirs and the rest's."""
    d = distances(x, centroids)
    order = np.argsort(d, axis=1, kind="stable")[:, : near + 2]
    bounds = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
    if order.shape[1] < near + 2:
        bounds = np.concatenate([bounds, np.full((len(x), near + 2 - order.shape[1]), np.inf)], axis=1)
        order = np.concatenate([order, np.repeat(order[:, :1], near + 2 - order.shape[1], axis=1)], axis=1)
    return order[:, : near + 1].astype(np.int16), bounds


def assign(x: np.ndarray, order: np.ndarray, bounds: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest centroid of each vector; how many bounds it took to certify that; and which vectors were rescanned.

    moved: how far each centroid is from where it was when the bounds were taken.
    """
    n, near = len(x), order.shape[1] - 1
    others = np.ones((n, len(centroids)), bool)
    np.put_along_axis(others, order.astype(np.int64), False, 1)
    far = np.where(others, moved, 0.0).max(1)
    slack = np.concatenate([moved[order], far[:, None]], axis=1)
    margin = _MARGIN * (1 + bounds + slack)
    margin[np.isinf(bounds)] = 0
    upper = bounds[:, 0] + slack[:, 0] + margin[:, 0]
    lower = bounds[:, 1:] - slack[:, 1:] - margin[:, 1:]
    best = order[:, 0].astype(np.int64)
    # A bound that the upper one doesn't stay under; the deepest says how many are needed.
    open_ = upper[:, None] >= lower
    depth = np.where(open_.any(1), near + 1 - open_[:, ::-1].argmax(1), 0)
    unsure = np.flatnonzero(depth > 0)
    scan = np.zeros(0, np.int64)
    if len(unsure):
        met = order[unsure].astype(np.int64)
        look = np.concatenate([np.ones((len(unsure), 1), bool), open_[unsure, :near]], axis=1)
        d = np.where(look, ((x[unsure][:, None, :] - centroids[met]) ** 2).sum(2), np.iinfo(np.int64).max)
        least = d.min(1)
        best[unsure] = np.where(d == least[:, None], met, len(centroids)).min(1)  # the least number of equals
        true = np.sqrt(least.astype(np.float64)) * (1 + _MARGIN) + _MARGIN
        left = np.where(look[:, 1:], np.inf, lower[unsure, :near]).min(1, initial=np.inf)
        scan = unsure[true >= np.minimum(left, lower[unsure, near])]
        best[scan] = distances(x[scan], centroids).argmin(1)
    rescanned = np.zeros(n, bool)
    rescanned[scan] = True
    return best, depth, rescanned


class Rounds:
    """The vectors with their bounds, as of the last snapshot."""

    def __init__(self, vectors: DataFrame, c: Clustering):
        self.c, self.vectors, self.table, self.near = c, vectors, None, c.near

    def snapshot(self, centroids: np.ndarray) -> None:
        c, near = self.c, min(self.near, max(1, len(centroids) - 2))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _cut(batches):
                x = _matrix(batch.column("v"), c.components, "<i4")
                order, bounds = nearest(x, centroids, near)
                # Rounded outwards: the first is an upper bound, the others are lower ones.
                short = bounds.astype("<f4")
                short[:, 0] = np.where(short[:, 0] < bounds[:, 0], np.nextafter(short[:, 0], np.float32(np.inf)), short[:, 0])
                short[:, 1:] = np.where(short[:, 1:] > bounds[:, 1:], np.nextafter(short[:, 1:], np.float32(-np.inf)), short[:, 1:])
                kept = [pa.array([r.tobytes() for r in z], pa.binary()) for z in (order, short)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *kept], names=["vec_id", "v", "nearest", "bounds"])
            release()

        old = self.table
        rows = self.vectors if old is None else old.select("vec_id", "v")
        kind = rows.schema["vec_id"].dataType.simpleString()
        self.table = written(rows.mapInArrow(run, f"vec_id {kind}, v binary, nearest binary, bounds binary"))
        self.at, self.tracked = centroids, near
        forget(self.vectors if old is None else old)

    def over(self, centroids: np.ndarray, tell, schema: str) -> DataFrame:
        """tell over the vectors, their exact assignment, the bounds it took and whether they were rescanned."""
        c, near, moved = self.c, self.tracked, np.sqrt(((centroids - self.at) ** 2).sum(1).astype(np.float64))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _cut(batches):
                x = _matrix(batch.column("v"), c.components, "<i4")
                order, bounds = _matrix(batch.column("nearest"), near + 1, np.int16), _matrix(batch.column("bounds"), near + 2, "<f4").astype(np.float64)
                yield tell(batch, x, *assign(x, order, bounds, centroids, moved))
            release()

        return self.table.mapInArrow(run, schema)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, _ROWS):
            yield batch.slice(k, _ROWS)


def _sums(rounds: Rounds, centroids: np.ndarray) -> tuple[np.ndarray, dict[int, int], int]:
    """New centroids; how many vectors needed how many bounds; and how many were rescanned."""
    (k, width), tracked = centroids.shape, rounds.tracked

    def tell(batch: pa.RecordBatch, x: np.ndarray, best: np.ndarray, depth: np.ndarray, rescanned: np.ndarray) -> pa.RecordBatch:
        total, n = np.zeros((k, width), np.int64), np.bincount(best, minlength=k)
        np.add.at(total, best, x)
        needed = np.bincount(depth, minlength=tracked + 2)
        what = ["sum"] * (k * width) + ["n"] * k + ["depth"] * len(needed) + ["rescanned"]
        place = [*range(k * width), *range(k), *range(len(needed)), 0]
        return pa.RecordBatch.from_arrays([pa.array(what), pa.array(place, pa.int32()), pa.array(np.concatenate([total.ravel(), n, needed, [rescanned.sum()]]))], names=["what", "place", "amount"])

    parts = rounds.over(centroids, tell, "what string, place int, amount long").groupBy("what", "place").agg(F.sum("amount"))
    found = {(r[0], r[1]): r[2] for r in parts.collect()}  # a row for each centroid's component
    n = np.array([found.get(("n", j), 0) for j in range(k)])
    total = np.array([found.get(("sum", j), 0) for j in range(k * width)]).reshape(k, width)
    new = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)  # floors, below zero too
    return new, {p: v for (w, p), v in found.items() if w == "depth"}, found.get(("rescanned", 0), 0)


def clusters(embeddings: DataFrame, c: Clustering = Clustering()) -> tuple[DataFrame, np.ndarray, list[dict]]:
    """vec_id, cluster and distance of each vector; the final centroids; and of each round whether it took a snapshot, and its rescans."""
    vectors = written(whole_vectors(embeddings, c))
    first = F.sha2(F.concat(F.lit(f"{c.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = vectors.orderBy(first, "v").limit(c.clusters).select("v").collect()  # the first centroids
    centroids = np.array([np.frombuffer(r.v, "<i4") for r in start], np.int64).reshape(-1, c.components)
    rounds, log, stale = Rounds(vectors, c), [], True
    for _ in range(c.rounds if len(centroids) else 0):
        if stale:
            rounds.snapshot(centroids)
        new, depth, rescanned = _sums(rounds, centroids)
        n = sum(depth.values())
        log.append({"snapshot": stale, "bounds": rounds.tracked, "rescanned": rescanned, "vectors": n})
        stale = 100 * rescanned > c.rescans_percent * n
        enough = [d for d in range(1, rounds.tracked + 1) if 100 * sum(v for p, v in depth.items() if p <= d) >= c.covered_percent * n]
        rounds.near = min(enough, default=c.near)
        centroids = new

    def tell(batch: pa.RecordBatch, x: np.ndarray, best: np.ndarray, depth: np.ndarray, rescanned: np.ndarray) -> pa.RecordBatch:
        d = ((x.astype(np.int64) - centroids[best]) ** 2).sum(1)
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(best.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema), centroids, log
    if rounds.table is None:
        rounds.snapshot(centroids)
    return written(rounds.over(centroids, tell, schema)), centroids, log


def clustered(embeddings: DataFrame, c: Clustering = Clustering()) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of each vector."""
    rows, centroids, _ = clusters(embeddings, c)
    spark = rows.sparkSession
    inertia = {r[0]: r[1] for r in rows.groupBy("cluster").agg(F.sum("distance")).collect()}  # a row for each cluster
    names = [hashlib.sha256(",".join(map(str, k.tolist())).encode()).hexdigest() for k in centroids]
    told = [(j, inertia.get(j, 0), sum(inertia.values()), name) for j, name in enumerate(names)]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(each), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
