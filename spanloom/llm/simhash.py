"""Near-duplicates by SimHash fingerprints, found with Golay keys.

A fingerprint has a bit for each bit of a 64-bit hash: 1 if over half of the text's shingles have it
set. Texts whose fingerprints differ in at most three bits are linked.

Three bits spread over three segments leave at least two segments with one error at most. A word at
most one bit from another has its own Golay index among the few indices around the other, so for each
two segments a fingerprint is filed under (indices around the first, own index of the second) and the
other way round: about 32 keys, of 24 bits each, through which every link is found. Buckets are read
in key order, and each is reduced to verified links that connect the same fingerprints as all of its
links would; pairs are never listed. Equal fingerprints are one node from the start.

``near_duplicates`` links by fingerprints alone. ``alike`` takes a similarity instead: texts whose word shingles
agree to ``LEAST`` or more (Jaccard). One fingerprint can't show that: at 0.8 two texts' fingerprints differ in about
ten bits. So a text has ``VIEWS`` fingerprints, each of the two shingles of least hash in one of as many parts of
all shingles; at a similarity of 0.8 a view is the same in two texts of three, and fewer than two views are in one pair
of 230. Views within one bit are found by Golay keys as above. Texts that share two views are compared by their exact
shingle sets, and linked if they agree. Of a group of up to ``FEW`` texts that share two views all pairs are compared. A larger group's texts are
compared with ``HEADS`` of them first, which mostly connects it; then those that aren't with the most of the group are compared with all of it,
in tiles of two blocks that are dealt out, where numbers of shared shingles are a matrix product. So no pair that shares two views is left open,
pairs of large groups are never listed, and the work grows with the texts where groups hang together, with the square of
what doesn't where they don't. Equal shingle sets are one node.

A null text counts as empty; without words the fingerprint is zero, and is linked like any other (by ``alike``,
texts without words are equal). Repeated rows of an id have that id's results. Rows with a null id take part under it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import golay
from spanloom.llm.common import by_text, spread, stored
from spanloom.llm.collisions import least_reached
from spanloom.llm.graph import components

BITS = 3
SEED = 42
#: First bit and length of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
CHUNK = 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Of the word shingles of a text in lower case (A-Z), as a signed 64-bit integer."""
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n, counts, digest = max(1, len(w) - words + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, CHUNK):
        part = [w[i + k : min(n, i + CHUNK) + k] for k in range(words)] if len(w) >= words else [[b" ".join(w)]]
        hashes = np.array([digest(s, SEED) for s in map(b" ".join, zip(*part, strict=True))], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp."""
    return spread(docs.select(key, text)).mapInArrow(by_text(lambda t: (fingerprint(t, words),), key, text, [("fp", pa.int64())]), f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def golay_keys(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Position and key of every bucket entry. A key's lowest bit says which of the two segments has the indices around it.

    One bit leaves two segments as they are, so that their own indices do: an entry for both sides of each two segments.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"keys cover up to {BITS} bits")
    value = fps.view(np.uint64)
    words = [(value >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    around = [golay.around(w) if bits > 1 else golay.decode(w)[:, None] for w in words]
    at, keys = [], []
    for k, (i, j) in enumerate(PAIRS):
        for side, index in enumerate((around[i] << 12 | around[j][:, :1], around[i][:, :1] << 12 | around[j])):
            index = np.sort(index, axis=1)
            new = np.concatenate([np.ones((len(fps), 1), bool), index[:, 1:] != index[:, :-1]], axis=1)
            at.append(np.nonzero(new)[0])
            keys.append((np.int64(k) << 24 | index[new]) << 1 | side)
    return np.concatenate(at), np.concatenate(keys)


def file_under_keys(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every = batch.column("fp").to_numpy()
        for i in range(0, len(every), CHUNK):
            fps = every[i : i + CHUNK]
            at, keys = golay_keys(fps, bits)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 1), pa.array((keys & 1).astype(np.int32)), pa.array(fps[at])], names=["key", "side", "fp"])


def forest(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links among the fingerprints connect, one less than nodes for each part."""
    left, a, b = np.unique(fps.view(np.uint64)), [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= bits
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(np.full(len(found), x))
                b.append(found)
                front.extend(found)
    if not a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)


def links_of(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links of whole buckets that are sorted by key and side."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    ends = np.append(starts[1:], len(keys))
    ones = np.add.reduceat(sides, starts) if len(starts) else np.empty(0, int)
    zeros = ends - starts - ones
    out_a, out_b = [], []
    small = (zeros * ones > 0) & (zeros * ones <= 256)
    z, o, s = zeros[small], ones[small], starts[small]
    if len(z):
        n = z * o
        base = np.repeat(np.cumsum(n) - n, n)
        k = np.arange(n.sum()) - base
        width = np.repeat(o, n)
        first = np.repeat(s, n) + k // width
        second = np.repeat(s + z, n) + k % width
        x, y = fps[first].view(np.uint64), fps[second].view(np.uint64)
        good = (np.bitwise_count(x ^ y) <= bits) & (x != y)
        out_a.append(fps[first[good]])
        out_b.append(fps[second[good]])
    for i in np.flatnonzero((zeros * ones > 256)):
        a, b = forest(fps[starts[i] : ends[i]], bits)
        out_a.append(a)
        out_b.append(b)
    if not out_a:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b)


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: enough links among distinct fingerprints (column fp) to connect what belongs together."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            part = tuple(batch.column(c).to_numpy() for c in ("key", "side", "fp"))
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last bucket may go on in the next batch
            if cut:
                whole = [np.concatenate(x) for x in zip(*held, tuple(p[:cut] for p in part), strict=True)]
                a, b = links_of(*whole, bits)
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
                held = []
            held.append(tuple(p[cut:] for p in part))
        if held:
            a, b = links_of(*(np.concatenate(x) for x in zip(*held, strict=True)), bits)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])

    filed = nodes.select("fp").mapInArrow(lambda batches: file_under_keys(batches, bits), "key long, side int, fp long")
    return filed.repartition("key").sortWithinPartitions("key", "side").mapInArrow(verify, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (hex), component_id: the smallest key reachable over links, for every row."""
    found = stored(fingerprints(docs, words, key, text), "simhash")
    nodes = stored(found.groupBy("fp").agg(F.min(key).alias("first")), "simhash-nodes")
    roots = components(links(nodes, bits))
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    member = joined.join(least, "root").select("fp", "component_id")
    return found.join(member, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


VIEWS = 8
#: Texts of a group that are all compared with each other at once; larger groups' texts are first compared with so many of them.
FEW, HEADS = 16, 4
#: Texts and bytes of their shingles of a block, and columns of a block's shingles that are compared at a time.
BLOCK, BLOCK_BYTES, COLUMNS = 512, 8_000_000, 4096
MIX = np.uint64(0x9E3779B97F4A7C15)
VIEW_PATTERNS = np.array([xxhash.xxh64_intdigest(str(v)) for v in range(VIEWS)], np.uint64)
WORDS, LEAST = 5, 0.8


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted; of all its words if there are fewer, none without words."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    parts = [w[k : max(1, len(w) - words + 1) + k] for k in range(words)] if len(w) >= words else [[b" ".join(w)]]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*parts, strict=True))), np.uint64))


def views(hashes: np.ndarray) -> list[int | None]:
    """The fingerprints of the two least shingles of each part of a text's shingles, null for an empty part.

    Of two shingles more than half have a bit set if both have. A pattern of its own for each view keeps the views apart.
    """
    out: list[int | None] = []
    mixed, part = hashes * MIX, hashes % np.uint64(VIEWS)
    for v in range(VIEWS):
        mine = np.sort(mixed[part == v])[:2]
        both = np.bitwise_and.reduce((mine ^ mine >> np.uint64(29)) * MIX) if len(mine) else None
        out.append(None if both is None else int((both ^ VIEW_PATTERNS[v]).astype(np.int64)))
    return out


def agree(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets share enough; sets whose sizes alone keep them below aren't compared."""
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    shared = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
    return shared >= least * (len(x) + len(y) - shared)


def linked_in(left: list[np.ndarray], right: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a set of each side that agree: sizes and the number of shared hashes, of which only those on both sides count, decide."""
    n, m = (np.array([len(x) for x in s], np.int64) for s in (left, right))
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    places = [(np.repeat(np.arange(len(s)), k), np.concatenate(s)) for s, k in ((left, n), (right, m))]
    held = [(r[known], np.searchsorted(both, h[known])) for r, h in places for known in [np.isin(h, both)]]
    shared = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), COLUMNS):
        parts = []
        for (r, c), size in zip(held, (len(left), len(right)), strict=True):
            mine = (c >= at) & (c < at + COLUMNS)
            part = np.zeros((size, min(COLUMNS, len(both) - at)), np.float32)
            part[r[mine], c[mine] - at] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    shared = shared.astype(np.int64)
    return np.nonzero((shared >= least * (n[:, None] + m - shared)) & ((n[:, None] > 0) | (m > 0)))


def bridged(groups: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b: links between texts of a group that roots don't connect yet, enough of them to connect all that similar pairs would.

    groups are (group, node). In each, the texts that aren't with the most are compared with all, block by block: a tile of two blocks is a
    task's turn, and gives at most a link for each of its texts.
    """
    crowded = groups.join(roots, "node", "left").select("group", "node", F.coalesce("root", "node").alias("root"))
    crowded = stored(crowded.join(sets.select("node", F.octet_length("shingles").alias("size")), "node"), "crowded")
    parts = crowded.groupBy("group", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    whole = parts.groupBy("group").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("kinds")).where("kinds > 1")
    others = parts.join(whole.select("group", "main"), "group").where("root <> main.root").groupBy("group").agg(F.sum("n").alias("n_left"), F.sum("size").alias("size_left"))
    blocks = lambda n, size: F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1)).cast("int")
    plan = whole.join(others, "group").select("group", F.col("main.root").alias("main"), blocks("n_left", "size_left").alias("rows"), blocks("n", "size").alias("columns"))
    met = stored(crowded.drop("size").join(plan, "group"), "met")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    tile = lambda i, j: F.concat_ws("-", "group", i, j).alias("tile")
    left = met.where("root <> main").withColumn("i", place("rows")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).select(tile("i", "j"), F.lit(0).alias("side"), "node", "root")
    right = met.withColumn("j", place("columns")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).select(tile("i", "j"), F.lit(1).alias("side"), "node", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def finished() -> pa.RecordBatch:
            x = pa.Table.from_batches(held)
            side, node, root = (x.column(c).to_numpy() for c in ("side", "node", "root"))
            every = [np.frombuffer(b, np.uint32) for b in x.column("shingles").to_pylist()]
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                return pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            i, j = linked_in([every[k] for k in a], [every[k] for k in b], least)
            i, j = a[i], b[j]
            new = root[i] != root[j]
            known, back = np.unique(node, return_inverse=True)  # a text may stand on both sides
            reached = known[least_reached(len(known), back[i[new]], back[j[new]])]
            moved = reached != known
            return pa.RecordBatch.from_arrays([pa.array(known[moved]), pa.array(reached[moved])], names=["a", "b"])

        for batch in batches:
            names = batch.column("tile").to_pylist()
            at = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
            for first, end in zip(at, at[1:], strict=False):
                if first == end:
                    continue
                if held and held[0].column("tile")[0].as_py() != names[first]:
                    yield finished()
                    held.clear()
                held.append(batch.slice(first, end - first))
        if held:
            yield finished()

    return left.union(right).join(sets, "node").repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def alike(docs: DataFrame, words: int = WORDS, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, mark, component_id: the smallest key reachable over links between texts of similar word shingles, for every row; mark is a hash of the row's text.

    Nodes are sets of 64-bit hashes; comparisons take 32 bits of each, in which two shingles of a text are next to never the same.
    """
    kind = docs.schema[key].dataType.simpleString()

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            nodes = pa.array([xxhash.xxh64_intdigest(s.tobytes()) >> 1 for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("mark"), nodes, pa.array([views(s) for s in sets], pa.list_(pa.int64())), pa.array([np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets], pa.binary())], names=["key", "mark", "node", "views", "shingles"])

    texts = spread(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.col(text).alias("text")))
    rows = stored(texts.mapInArrow(sketched, f"key {kind}, mark long, node long, views array<long>, shingles binary"), "shingles")
    nodes = stored(rows.groupBy("node").agg(F.min("key").alias("first"), F.first("views").alias("views")), "shingle-nodes")
    seen = nodes.select("node", F.posexplode("views").alias("view", "fp")).where("fp is not null")
    fps = stored(seen.select("fp").distinct(), "views")
    one = components(links(fps, 1))
    placed = stored(seen.join(one, seen["fp"] == one["node"], "left").select(seen["node"], "view", F.coalesce("root", "fp").alias("fp")), "placed")
    after = placed.select("node", F.pmod(F.col("view") - 1, F.lit(VIEWS)).cast("int").alias("view"), F.col("fp").alias("next"))
    adjacent = placed.join(after, ["node", "view"]).select("node", F.xxhash64("view", "fp", "next").alias("group"))
    sized = lambda groups: groups.join(groups.groupBy("group").agg(F.count("*").alias("n")).where("n > 1"), "group")

    def pairs_of(groups: DataFrame) -> DataFrame:
        """All pairs of small groups."""
        few = groups.where(F.col("n") <= FEW).groupBy("group").agg(F.array_sort(F.collect_list("node")).alias("m")).select("m", F.posexplode("m").alias("at", "head"))
        return few.select(F.explode(F.slice("m", F.col("at") + 2, FEW)).alias("node"), "head")

    single = stored(sized(placed.select("node", "view", "fp", F.xxhash64("view", "fp").alias("group"))), "single-views")
    twice = pairs_of(single).groupBy("node", "head").agg(F.count("*").alias("n")).where("n > 1").select("node", "head")
    # texts whose view is crowded meet in groups of that view and any other, which two texts that share two views have in common
    other = placed.select("node", F.col("view").alias("view_b"), F.col("fp").alias("fp_b"))
    also = single.where(F.col("n") > FEW).join(other, "node").where("view <> view_b")
    low = F.col("view") < F.col("view_b")
    first, last = (F.when(low if k else ~low, F.struct("view", "fp")).otherwise(F.struct(F.col("view_b").alias("view"), F.col("fp_b").alias("fp"))) for k in (1, 0))
    apart = ~F.pmod(F.col("view_b") - F.col("view"), F.lit(VIEWS)).isin(1, VIEWS - 1)  # neighbours are together anyway
    also = also.where(apart).select("node", F.xxhash64(F.lit("any"), first, last).alias("group")).distinct()
    groups = stored(sized(adjacent.union(also)), "groups")
    large = groups.where(F.col("n") > FEW).select("group", "node")
    chosen = large.groupBy("group").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), "node"), "node"))["node"].alias(f"h{k}") for k in range(HEADS)))
    some = large.join(chosen, "group").select("node", F.explode(F.array(*(f"h{k}" for k in range(HEADS)))).alias("head")).where("node <> head")
    ordered = some.select(F.greatest("node", "head").alias("node"), F.least("node", "head").alias("head"))
    pairs = stored(twice.union(pairs_of(groups)).union(ordered).distinct(), "pairs")
    asked = stored(pairs.select("node").union(pairs.select("head")).union(large.select("node")).distinct(), "asked")
    sets = stored(rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min("shingles").alias("shingles")), "sets")

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [agree(np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32), least) for a, b in zip(batch.column("a"), batch.column("b"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("head")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = sets.withColumnRenamed("shingles", "a"), sets.select(F.col("node").alias("head"), F.col("shingles").alias("b"))
    linked = stored(pairs.join(left, "node").join(right, "head").select("node", "head", "a", "b").mapInArrow(agreeing, "a long, b long"), "linked")
    known = stored(components(linked), "known")
    more = bridged(large, known, sets, least)
    roots = components(known.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)).withColumnRenamed("node", "n")
    joined = nodes.join(roots, nodes["node"] == roots["n"], "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    least_key = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    member = joined.join(least_key, "root").select("node", "component_id")
    return rows.select(F.col("key").alias(key), "mark", "node").join(member, "node").select(key, "mark", "component_id")


def first_of_each(docs: DataFrame, words: int = WORDS, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without rows whose text is alike, over others perhaps, to that of a row of smaller key.

    Rows count one by one: of rows of one key with different texts each stays or goes by its own text, and equal rows go together. Rows without a key stay.
    """
    gone = alike(docs, words, least, key, text).where(f"`{key}` <> component_id").select(F.col(key).alias("_gone"), "mark").distinct()
    # the same plan at every size: the copies' ids grow with the table
    return docs.join(gone.hint("merge"), (docs[key] == gone["_gone"]) & (F.xxhash64(docs[text]) == gone["mark"]), "left_anti")
