"""Near copies among embeddings, by counting collisions on one-dimensional projections.

Unit vectors are projected on ``PROJECTIONS`` random directions. On a projection, two vectors collide if one lies in a window around the
other: the values are sorted, and each query's window is a stretch of ranks. The difference of two unit vectors at a given cosine has
normally distributed projections of known width, so collisions of a pair at the threshold follow a binomial law; ``calibrated`` takes from it the
window and the least count that keep all but ``LOST`` of such pairs while fewest unrelated ones pass. Pairs that reach the count are verified
by their cosine in double precision, so nothing below the threshold is linked.

Equal vectors of a label are one class with a count, so copies are never compared. A label's classes are put in order by
one projection and cut into blocks of ``BLOCK``, whatever the label's size, and blocks meet in pairs (tiles), each in a task of its own turn; two
blocks whose values lie further apart on any projection than a linked pair's can't hold a link and don't meet. A tile gives a row
for each class with a link: how many vectors it is linked to there, and the least class it is connected with
there. So links are counted but never written one by one, and components are found over at most a row per class and tile.
Tiles are dense where vectors aren't grouped: the work is then the square of a label's classes, over so many tiles.

Links need equal labels, not null, and equal numbers of components. Vectors that are null, empty, zero, or hold null or non-finite
components link with nothing. Rows count one by one: repeated rows and rows of one id are vectors of their own. Rows without an id
are left out. Ties don't arise; an empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import stored
from spanloom.llm.graph import components

SIMILARITY = 0.93
PROJECTIONS, LOST, SEED = 32, 1e-7, 11
#: Projections that all pairs of a tile are counted on; the others only for pairs that can still reach the count.
FIRST = 16
BLOCK = 2048
#: Pairs that are verified at once.
PAIRS = 1 << 16


def tail(n: int, p: float, k: int) -> float:
    """How likely more than k of n events of probability p are."""
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1, n + 1))


def calibrated(similarity: float = SIMILARITY, projections: int = PROJECTIONS, lost: float = LOST) -> tuple[float, int]:
    """Half the window's width and the least count: a pair of that similarity is lost with at most that probability."""
    near, far, best = math.sqrt(max(2 - 2 * similarity, 1e-12)), math.sqrt(2), (math.inf, 0.0, 0)
    for misses in range(projections):
        low, high = 0.0, 1.0
        for _ in range(60):  # the largest chance to miss a window that the count forgives
            mid = (low + high) / 2
            low, high = (mid, high) if tail(projections, mid, misses) <= lost else (low, mid)
        miss, low, high = low, 0.0, 40.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if math.erfc(mid / math.sqrt(2)) > miss else (low, mid)
        width = high * near
        passing = 1 - tail(projections, math.erfc(width / far / math.sqrt(2)), misses)
        best = min(best, (passing, width, projections - misses))
    return best[1], best[2]


def directions(dim: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, projections))


def units(batch_vectors: pa.Array, dim: int) -> np.ndarray:
    """Vectors of one length, each divided by its own length; by its largest component first, so that no square overflows."""
    v = batch_vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    v = v / np.exp2(np.floor(np.log2(np.abs(v).max(axis=1, keepdims=True))))
    return v / np.sqrt(np.square(v).sum(axis=1, keepdims=True))


def windows(queries: np.ndarray, values: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranks of the values on one projection, and each query's window as a first rank and a number of them."""
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.uint16)
    rank[order] = np.arange(len(values), dtype=np.uint16)
    low = np.searchsorted(values[order], queries - half, side="left")
    return rank, low.astype(np.uint16), (np.searchsorted(values[order], queries + half, side="right") - low).astype(np.uint16)


def candidates(p: np.ndarray, q: np.ndarray, half: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two blocks' projections that collide at least so many times."""
    n = p.shape[1]
    first = min(FIRST, n)
    count = np.zeros((len(p), len(q)), np.uint8)
    for j in range(first):
        rank, low, width = windows(p[:, j], q[:, j], half)
        count += rank - low[:, None] < width[:, None]  # ranks before the window wrap around to large numbers
    a, b = np.nonzero(count >= max(least - (n - first), 0))
    count = count[a, b]
    for j in range(first, n):
        rank, low, width = windows(p[:, j], q[:, j], half)
        count = count + (rank[b] - low[a] < width[a])
        keep = count >= max(least - (n - 1 - j), 0)
        a, b, count = a[keep], b[keep], count[keep]
    return a, b


def least_reached(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            return root


def linked(x: np.ndarray, y: np.ndarray | None, half: float, least: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y that are similar enough; without y each pair of x once."""
    to = x if y is None else y
    d = directions(x.shape[1])
    a, b = candidates(x @ d, to @ d, half, least)
    if y is None:
        a, b = a[a < b], b[a < b]
    keep = [np.einsum("ij,ij->i", x[a[i : i + PAIRS]], to[b[i : i + PAIRS]]) >= similarity for i in range(0, len(a), PAIRS)]
    keep = np.concatenate(keep) if keep else np.zeros(0, bool)
    return a[keep], b[keep]


def met(block: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], alone: bool, half: float, least: int, similarity: float) -> pa.RecordBatch:
    """node, links, root of the classes that have a link in a tile: sides, nodes, counts and units of its rows."""
    side, node, many, x = block
    order = np.lexsort((node, side))
    side, node, many, x = side[order], node[order], many[order], x[order]
    n = int((side == 0).sum())
    a, b = linked(x, None, half, least, similarity) if alone else linked(x[:n], x[n:], half, least, similarity)
    b = b if alone else b + n
    links = np.bincount(a, many[b], len(node)) + np.bincount(b, many[a], len(node))
    by_node = np.argsort(node, kind="stable")
    place = np.empty(len(node), np.int64)
    place[by_node] = np.arange(len(node))
    root = node[by_node][least_reached(len(node), place[a], place[b])][place]
    hit = links > 0
    return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], names=["node", "links", "root"])


def usable(v: Column) -> Column:
    x = v.cast("array<double>")
    return v.isNotNull() & ~F.coalesce(F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(True)) & F.exists(x, lambda e: e != 0)


def in_blocks(classes: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """The classes with the number of their block, and the blocks with the extremes of their projections.

    Rows come in order of label, length and first projection; a partition's runs of one label and length are cut into blocks.
    """

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, out = np.array([len(v) for v in batch.column("v")], np.int64), np.empty(batch.num_rows)
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                out[mine] = units(batch.column("v").take(pa.array(mine)), dim) @ directions(dim)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int32)), pa.array(out)], names=[*batch.schema.names, "dim", "at"])

    kind = dict(classes.dtypes)["v"]
    placed = classes.mapInArrow(lead, f"label string, v {kind}, node long, many long, dim int, at double")
    dealt = placed.repartitionByRange("label", "dim", "at").sortWithinPartitions("label", "dim", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, before, held = TaskContext.get().partitionId() << 32, None, 0
        for batch in batches:
            of = []
            for key in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True):
                if key != before or held == block:
                    number, before, held = number + 1, key, 0
                held += 1
                of.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.int64())], names=[*batch.schema.names, "block"])

    rows = stored(dealt.mapInArrow(cut, f"label string, v {kind}, node long, many long, dim int, at double, block long"), "blocks")

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, dims = batch.column("block").to_numpy(), batch.column("dim").to_numpy()
            for number in np.unique(of):
                mine = np.flatnonzero(of == number)
                dim = int(dims[mine[0]])
                d = directions(dim)
                p = units(batch.column("v").take(pa.array(mine)), dim) @ (d / np.sqrt(np.square(d).sum(axis=0)))
                yield pa.RecordBatch.from_pydict({"block": [number], "label": [batch.column("label")[int(mine[0])].as_py()], "dim": pa.array([dim], pa.int32()), "low": [p.min(axis=0).tolist()], "high": [p.max(axis=0).tolist()]})

    parts = rows.mapInArrow(extremes, "block long, label string, dim int, low array<double>, high array<double>")
    each = lambda c, f: F.array(*(f(F.col(c)[i]) for i in range(PROJECTIONS))).alias(c)
    return rows, parts.groupBy("block", "label", "dim").agg(each("low", F.min), each("high", F.max))


def tiles(blocks: DataFrame, similarity: float) -> DataFrame:
    """tile, block, side, alone: blocks of one label and length that may hold a link, two by two, and each with itself."""
    reach = math.sqrt(max(2 - 2 * similarity, 0)) + 1e-9
    other = blocks.select("label", "dim", *(F.col(c).alias(f"{c}_b") for c in ("block", "low", "high")))
    apart = lambda high, low: F.exists(F.zip_with(high, low, lambda h, b: b - h > reach), lambda x: x)
    two = blocks.join(other, ["label", "dim"]).where((F.col("block") <= F.col("block_b")) & ~apart("high", "low_b") & ~apart("high_b", "low"))
    alone = F.col("block") == F.col("block_b")
    side = lambda c, k: F.struct(F.col(c).alias("block"), F.lit(k).alias("side"))
    found = two.select(F.concat_ws("-", "block", "block_b").alias("tile"), alone.alias("alone"), F.when(alone, F.array(side("block", 0))).otherwise(F.array(side("block", 0), side("block_b", 1))).alias("sides"))
    return found.select("tile", "alone", F.inline("sides"))


def links(classes: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """node, links, root for classes (label, v, node, many): a row for each tile in which a class has a link."""
    if not 1 <= block <= 1 << 15:
        raise ValueError("ranks of a block are numbers of 16 bits")
    half, least = calibrated(similarity)
    rows, blocks = in_blocks(classes, block)
    dealt = rows.join(tiles(stored(blocks, "extremes"), similarity), "block").select("tile", "alone", "side", "node", "many", "dim", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finished() -> pa.RecordBatch:
            x = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            dim = x.column("dim")[0].as_py()
            return met((x.column("side").to_numpy(), x.column("node").to_numpy(), x.column("many").to_numpy(), units(x.column("v"), dim)), x.column("alone")[0].as_py(), half, least, similarity)

        for batch in batches:
            names = batch.column("tile").to_pylist()
            at = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(at, at[1:], strict=False):
                if i == j:
                    continue
                if held and held[0].column("tile")[0].as_py() != names[i]:
                    yield finished()
                    held.clear()
                held.append(batch.slice(i, j - i))
        if held:
            yield finished()

    return dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "node long, links long, root long")


def near_copies(vectors: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, n_links, component_id, kept for every vector: linked vectors, the smallest key reachable by links, and whether that is its own."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).alias("v")).where("id is not null")
    known = F.col("label").isNotNull() & usable(F.col("v"))
    grouped = rows.where(known).groupBy("label", "v").agg(F.min("id").alias("least"), F.count("*").alias("many"))
    classes = stored(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stored(links(classes.select("label", "v", "node", "many"), similarity, block), "tiles")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    rooted = stored(classes.drop("v", "label").join(counts, "node", "left").join(reached, "node", "left").select("node", "least", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "node").alias("root")), "rooted")
    of = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    each = classes.select("label", "v", "node").join(rooted.join(of, "root").select("node", "n_links", "component_id"), "node").drop("node")
    single = rows.where(~known).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = rows.where(known).join(stored(each, "linked"), ["label", "v"]).select("id", "n_links", "component_id").union(single)
    return every.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
