"""Centroid clustering in exact whole numbers, by Lloyd's rounds with Exponion search.

Every vector keeps its centroid a, an upper bound u on the distance to it and a lower bound l on the distance to any other. After
centroids move, bounds follow by the lengths of the moves. A vector whose u is below l, or below half the way from a to the
nearest other centroid, stays where it is unseen. Else u becomes the distance itself, and if that doesn't settle it either, only the
centroids within ``2 u + s`` of a are compared, s being the way to a's nearest other centroid: a ball that holds
the nearest and the second nearest. Each centroid has the list of the others by distance, so a ball is a beginning of it, taken to the
next power of two. Bounds settle a vector only if they are strictly smaller and balls include their surface, so ties are always compared,
and go to the smaller number.

Vectors are kept if they have ``dim`` components, none null or not finite; a component becomes floor(256 x). Beyond ``REACH`` in size
it counts as that, so that distances fit 64 bits. Rows count one by one, whatever their ids: repeated rows are
vectors of their own, rows without an id are clustered but are the last to begin as centroids, and of rows of one id that with the least
components begins first. With fewer vectors than clusters there are as many clusters as vectors; without any there are no rows.

A round is one pass over the vectors, written to the shared folder, and one sum per cluster that Spark adds up before it
deals it out. The driver holds clusters x dim numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stored

SCALE = 256
CLUSTERS, ROUNDS, DIM, SEED = 40, 5, 64, 2
#: Components are cut to this size.
REACH = 2**27
#: Below this size floating-point numbers hold all products exactly.
SMALL = 2**22
#: Room for the rounding of bounds.
SLACK = 1e-9
MOST = 2**63 - 1


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x and c, which are whole numbers."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) < SMALL:
        return ((x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * (x @ c.T)


class Centroids:
    """Centroids, how far they moved, and the lists of the others by distance."""

    def __init__(self, at: np.ndarray, moved: np.ndarray | None = None):
        self.at = at.astype(np.float64)
        self.moved = np.zeros(len(at)) if moved is None else moved
        between = np.sqrt(squares(self.at, self.at).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.order, axis=1)
        for a, row in enumerate(self.order):  # a itself leads its list, also where others stand on it
            row[1 : int(np.flatnonzero(row == a)[0]) + 1] = row[: int(np.flatnonzero(row == a)[0])].copy()
            row[0] = a
        self.near = self.sorted[:, 1] if len(at) > 1 else np.full(len(at), np.inf)
        first = int(np.argmax(self.moved)) if len(at) else 0
        self.most = np.full(len(at), self.moved.max(initial=0))
        if len(at) > 1:
            self.most[first] = np.delete(self.moved, first).max()

    def assigned(self, x: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Each vector's centroid and bounds from those of the round before (a < 0: none yet), and how many distances that took."""
        a, new = a.copy(), a < 0
        u, low = np.where(new, np.inf, u + self.moved[a]), np.where(new, 0.0, low - self.most[a])
        u *= 1 + SLACK
        low = low - np.abs(low) * SLACK
        work = 0
        settled = lambda rows: u[rows] < np.maximum(low[rows], self.near[a[rows]] / 2) * (1 - SLACK)
        every = np.arange(len(x))
        left = every[new]
        if len(left):
            work += self._scan(x, left, np.arange(len(self.at)), a, u, low)
        left = every[~new][~settled(every[~new])]
        for k in np.unique(a[left]):
            mine = left[a[left] == k]
            u[mine] = np.sqrt(squares(x[mine], self.at[[k]])[:, 0].astype(np.float64))
            work += len(mine)
        left = left[~settled(left)]
        for k in np.unique(a[left]):
            mine = left[a[left] == k]
            ball = (2 * u[mine] + self.near[k]) * (1 + SLACK) + SLACK
            inside = np.searchsorted(self.sorted[k], ball, side="right")
            part = np.minimum(2 ** np.ceil(np.log2(np.maximum(inside, 2))).astype(int), len(self.at))
            for n in np.unique(part):
                work += self._scan(x, mine[part == n], np.sort(self.order[k][:n]), a, u, low)
        return a, u, low, work

    def _scan(self, x: np.ndarray, rows: np.ndarray, among: np.ndarray, a: np.ndarray, u: np.ndarray, low: np.ndarray) -> int:
        """Nearest and second nearest of some centroids, in ascending order of their numbers; ties go to the first."""
        d = squares(x[rows], self.at[among])
        first = d.argmin(axis=1)
        a[rows], u[rows] = among[first], np.sqrt(d[np.arange(len(rows)), first].astype(np.float64))
        d[np.arange(len(rows)), first] = MOST
        low[rows] = np.sqrt(d.min(axis=1).astype(np.float64)) if len(among) > 1 else np.inf
        return d.size


def whole(v: Column) -> Column:
    """Components as whole numbers, which doubles hold."""
    return F.transform(v.cast("array<double>"), lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e15)), F.lit(-1e15)) * SCALE), F.lit(REACH)), F.lit(-REACH)).cast("double"))


def usable(v: Column, dim: int) -> Column:
    x = v.cast("array<double>")
    return v.isNotNull() & (F.size(v) == dim) & ~F.coalesce(F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True))


def numbers(batch: pa.RecordBatch, name: str, dim: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


STATE = "id long, v array<double>, cluster int, u double, low double"


def passed(state: DataFrame, by: Centroids, dim: int) -> DataFrame:
    """state with every vector at its nearest centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                known = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "u", "low")]
                a, u, low, _ = by.assigned(numbers(batch, "v", dim), known[0].astype(np.int64), *known[1:])
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(a.astype(np.int32)), pa.array(u), pa.array(low)], names=["id", "v", "cluster", "u", "low"])

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, by: Centroids, dim: int) -> Centroids:
    """Every centroid at the floor of its vectors' mean; those without vectors stay."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *(F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dim))).collect()  # a row a cluster
    at = by.at.copy()
    for r in sums:
        at[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return Centroids(at, np.sqrt(np.square(at - by.at).sum(axis=1)) * (1 + SLACK))


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, Centroids]:
    """key, cluster, distance (squared) for every vector kept, and the final centroids."""
    kept = vectors.where(usable(F.col(vector), dim)).select(F.col(key).cast("long").alias("id"), whole(F.col(vector)).alias("v"), F.lit(-1).alias("cluster"), F.lit(0.0).alias("u"), F.lit(0.0).alias("low"))
    state = stored(kept, "centroids")
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = state.orderBy(place.asc_nulls_last(), "v").limit(clusters).select("v").collect()  # so many rows
    by = Centroids(np.array([r["v"] for r in first], np.float64).reshape(len(first), dim))
    for _ in range(rounds if len(first) else 0):
        state = stored(passed(state, by, dim), "centroids")
        by = moved(state, by, dim)

    def distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, a = numbers(batch, "v", dim), batch.column("cluster").to_numpy().astype(np.int64)
            if len(x):
                d = x.astype(np.int64) - by.at[a].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(a.astype(np.int32)), pa.array((d * d).sum(axis=1))], names=[key, "cluster", "distance"])

    last = passed(state, by, dim) if len(first) else state
    return stored(last.mapInArrow(distances, f"{key} long, cluster int, distance long"), "clustered"), by


def report(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, seed: int = SEED, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector kept; sums beyond 64 bits stand as the largest number."""
    found, by = clustered(vectors, clusters, rounds, dim, seed, key, vector)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a cluster
    total = min(sum(sums.values()), MOST)
    digest = {k: hashlib.sha256(",".join(str(int(x)) for x in by.at[k]).encode()).hexdigest() for k in sums}
    rows = [(k, min(s, MOST), total, digest[k]) for k, s in sorted(sums.items())]
    of = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
