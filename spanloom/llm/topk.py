"""Exact search for the largest inner products, with bounds from segment statistics.

Vectors are cut into equal segments. With segment means m and deviations d (the length of what the
mean leaves), the inner product of x and y is at most the sum over segments of
``length * m(x) * m(y) + d(x) * d(y)``: large distances show in few numbers. Bounds are taken coarse
to fine; pairs whose bound falls below the query's k-th best score so far go, and the exact integer
product decides among the rest. The scores of a bounded sample of rows give every query a first
threshold, which only ever rules out what can't be among the best. Bounds and, where many pairs survive
them, products are worked out tile by tile as matrix products.

Queries are sent out in blocks of about ``BLOCK``, each with one pass over all rows; rows stay where they
are, and each batch gives at most k rows a query. Components become floor(1024 x). Rows without id, null
vectors and vectors with null or non-finite components take no part; shorter vectors count as ending
in zeros. A query's own id is no candidate of it; repeated candidate rows are each ranked; of query
rows that repeat an id the least vector counts. Ties go to the smaller id. Products beyond 64 bits
are worked out exactly and reported as the nearest 64-bit number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
SEGMENTS = (2, 4, 8, 16)
BLOCK = 2048
SAMPLE = 4096
ROWS = 2048
#: Pairs of a query and a row that a task looks at at once.
PAIRS = 1 << 19


def matrix(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of the usable vectors, and which rows those are."""
    usable, rows = [], []
    for i, v in enumerate(vectors):
        if v is not None and None not in v:
            a = np.asarray(v, np.float64)
            if np.isfinite(a).all():
                usable.append(np.floor(SCALE * a))
                rows.append(i)
    out = np.zeros((len(usable), max((len(a) for a in usable), default=0)))
    for i, a in enumerate(usable):
        out[i, : len(a)] = a
    return out, np.array(rows, np.int64)


def whole(a: np.ndarray) -> np.ndarray:
    """As integers: 64 bits where they fit."""
    return a.astype(np.int64) if not a.size or np.abs(a).max() < 2.0**62 else np.array([[int(x) for x in r] for r in a], object)


def fits(q: np.ndarray, x: np.ndarray) -> bool:
    """Whether floating-point numbers hold the products of any two rows, and all sums on the way, exactly."""
    return not q.size or not x.size or bool(np.abs(q).max() * np.abs(x).max() * q.shape[1] < 2.0**53)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of paired rows."""
    if not q.size:
        return np.zeros(len(q), np.int64)
    if fits(q, x):
        return np.einsum("ij,ij->i", q, x).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for u, v in zip(q, x, strict=True)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in exact], np.int64)


def widened(a: np.ndarray, n: int) -> np.ndarray:
    return np.pad(a, ((0, 0), (0, n - a.shape[1]))) if a.shape[1] < n else a


def statistics(a: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a product of two rows is the bound."""
    n = a.shape[1]
    parts = widened(a, -(-n // segments) * segments).reshape(len(a), segments, -1)
    mean = parts.mean(axis=2)
    return np.concatenate([mean * np.sqrt(parts.shape[2]), np.sqrt(np.square(parts - mean[:, :, None]).sum(axis=2))], axis=1)


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floor: np.ndarray):
        self.ids, self.vectors, self.k, self.floor = ids, vectors, k, floor.copy()
        self.kept = tuple(np.empty(0, np.int64) for _ in range(3))  # query's place, id, score
        self.stats: dict[int, dict[int, np.ndarray]] = {}

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Rows are taken in tiles of at most PAIRS pairs of a query and a row."""
        n = max(rows.shape[1], self.vectors.shape[1])
        q = widened(self.vectors, n)
        known = self.stats.setdefault(n, {s: statistics(q, s) for s in SEGMENTS if s < n})
        step = max(1, PAIRS // max(1, len(q)))
        for i in range(0, len(ids), step):
            self._tile(ids[i : i + step], widened(rows[i : i + step], n), q, known)

    def _tile(self, ids: np.ndarray, x: np.ndarray, q: np.ndarray, known: dict[int, np.ndarray]) -> None:
        left = np.ones((len(q), len(x)), bool)
        for s, mine in known.items():
            bound = mine @ statistics(x, s).T
            left &= bound + np.abs(bound) * 1e-9 + 1 >= self.floor[:, None]
            if left.sum() < len(x):
                break
        left &= self.ids[:, None] != ids
        a, b = np.nonzero(left)
        if not len(a):
            return
        if len(a) * 8 > left.size and fits(q, x):
            score = (q @ x.T)[a, b].astype(np.int64)  # sums of whole numbers below 2 ** 53 are exact in any order
        else:
            score = np.concatenate([products(q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
        keep = score >= self.floor[a]
        self.kept = self._cut(*(np.concatenate(p) for p in zip(self.kept, (a[keep], ids[b[keep]], score[keep]), strict=True)))

    def _cut(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -score.astype(np.float64), q)) if not len(score) or np.abs(score.astype(np.float64)).max() < 2.0**53 else np.array(sorted(range(len(q)), key=lambda i: (q[i], -int(score[i]), ids[i])), np.int64)
        q, ids, score = q[order], ids[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last].astype(np.float64))
        keep = place < self.k
        return q[keep], ids[keep], score[keep]


def pieces(ids: np.ndarray, vectors: list) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for i in range(0, len(vectors), ROWS):
        rows, at = matrix(vectors[i : i + ROWS])
        if len(at):
            yield ids[i : i + ROWS][at], rows


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query_id, rank, key, score: for every row for which is_query holds, the k largest products among all others."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null")
    queries = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    parts = max(1, -(-queries.count() // block))
    sample = rows.limit(SAMPLE).collect()
    first = list(pieces(np.array([r["id"] for r in sample], np.int64), [r["v"] for r in sample]))

    def passed(part: int) -> DataFrame:
        mine = queries.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == part).collect()  # about block rows
        q, at = matrix([r["v"] for r in mine])
        ids = np.array([r["id"] for r in mine], np.int64)[at]
        start = Best(ids, q, k, np.full(len(ids), -np.inf))
        for more in first if len(ids) else ():
            start.add(*more)
        sent = spark.sparkContext.broadcast((ids, q, start.floor))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, floor = sent.value
            best = Best(ids, q, k, floor)
            for batch in batches:
                if len(ids):
                    for more in pieces(batch.column("id").to_numpy(), batch.column("v").to_pylist()):
                        best.add(*more)
            a, found, score = best.kept
            yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(found), pa.array(score)], names=["query_id", key, "score"])

        return rows.mapInArrow(run, f"query_id long, {key} long, score long")

    every = reduce(DataFrame.unionAll, map(passed, range(parts)))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return every.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", key, "score")
