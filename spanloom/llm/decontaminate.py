"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared in lower case with white space made single. A leak is a stretch of a document that
agrees with a window of a benchmark item of ``span`` characters (with the whole item if it is shorter)
up to ``errors`` edits a character. By the q-gram lemma a window of n characters with k edits keeps at
least n + 1 - (k + 1) q of its q-grams, and they lie within k of one diagonal. Documents are scanned
for the benchmark's q-grams; hits are counted in diagonal bands of width k that overlap by half, over
stretches of the window's length; every window that reaches the bound in a band is aligned, within the
band, and the alignment's edits decide. Items so short that the bound asks for nothing are looked for by
shorter q-grams.

Every document's whole text is scanned in one pass where it lies, without a shuffle. The benchmark is
sent out in blocks of at most ``BLOCK`` characters, one pass each; an item is never split. Null and
empty texts leak nothing; items that may have no edits and no q-gram are found where they stand whole, none if empty.
Repeated rows of a document give repeated results; items with equal texts are each reported.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import spread

Q = 12
SPAN = 80
ERRORS = 0.0625
BLOCK = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters scanned at once; longer texts are scanned in pieces that overlap by a q-gram.
PIECE = 1 << 21
#: Shared q-grams that are held at once, and the least diagonals of a range of them.
HITS, LEAST = 1 << 19, 64


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each position."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = codes[:n].astype(np.uint64)
    for i in range(1, q):
        h = h * np.uint64(0x100000001B3) + codes[i : i + n]
    return h * MIX


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def banded(a: np.ndarray, b: np.ndarray, low: int, high: int, most: int) -> tuple[int, int, int] | None:
    """Least edits of the whole of a against any stretch of b on diagonals low to high: edits, first, end in b; None if over most."""
    if not len(b):
        return (len(a), 0, 0) if len(a) <= most else None
    big, width = most + 1, high - low + 1
    offset = np.arange(width)
    cost, begin = np.full(width, big), np.zeros(width, np.int64)
    first = low + offset
    ok = (first >= 0) & (first <= len(b))
    cost[ok], begin[ok] = 0, first[ok]
    for i in range(1, len(a) + 1):
        j = low + i + offset
        inside = (j >= 1) & (j <= len(b))
        sub = cost + np.where(inside, a[i - 1] != b[np.clip(j - 1, 0, len(b) - 1)], big)
        gap = np.append(cost[1:] + 1, big)
        up = np.append(begin[1:], 0)
        take = sub <= gap
        new, start = np.where(take, sub, gap), np.where(take, begin, up)
        new[(j < 0) | (j > len(b))] = big
        # insertions run along the band: the least of new[k] - k so far, plus k
        lead = np.minimum.accumulate(new - offset)
        run = lead + offset
        source = np.maximum.accumulate(np.where(new - offset == lead, offset, 0))
        better = run < new
        cost, begin = np.where(better, run, new), np.where(better, start[source], start)
        cost[(j < 0) | (j > len(b))] = big
        if cost.min() > most:
            return None
    k = int(cost.argmin())
    return int(cost[k]), int(begin[k]), low + len(a) + k


def least_edits(item: np.ndarray, starts: np.ndarray, n: int, text: np.ndarray, low: int, high: int, most: int) -> np.ndarray:
    """Least edits of the n characters of an item from each start against any stretch of text on the item's diagonals low to high; over most, some number over most."""
    big, offset = most + 1, np.arange(high - low + 1)
    out, left = np.full(len(starts), big), np.arange(len(starts))
    j = starts[:, None] + low + offset
    cost = np.where((j >= 0) & (j <= len(text)), 0, big)
    for i in range(n):
        inside = (j >= 0) & (j < len(text))
        sub = cost + np.where(inside, item[starts + i][:, None] != text[np.clip(j, 0, len(text) - 1)], big)
        j = j + 1
        new = np.minimum(sub, np.pad(cost[:, 1:], ((0, 0), (0, 1)), constant_values=big) + 1)
        new[(j < 0) | (j > len(text))] = big
        cost = np.minimum(np.minimum.accumulate(new - offset, axis=1) + offset, big)
        cost[(j < 0) | (j > len(text))] = big
        if i % 8 == 7:
            live = cost.min(axis=1) <= most
            if not live.any():
                return out
            starts, left, j, cost = starts[live], left[live], j[live], cost[live]
    out[left] = cost.min(axis=1)
    return out


class Block:
    """Benchmark items with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, str | None]], q: int, span: int, errors: float):
        self.q, self.span, self.errors = q, span, errors
        self.ids = [i for i, _ in items]
        self.codes = [codes_of(plain(t)) for _, t in items]
        few = [k for k, c in enumerate(self.codes) if 0 < len(c) and self.need(min(len(c), span)) < 1]
        edited = [k for k in few if int(min(len(self.codes[k]), span) * errors)]
        self.short = [k for k in few if not int(min(len(self.codes[k]), span) * errors)]
        # of a window cut into one piece more than it may have edits, one piece stays whole
        piece = min((max(1, n // (int(n * errors) + 1)) for n in (min(len(self.codes[k]), span) for k in edited)), default=q)
        self.finer = Block([items[k] for k in edited], piece, span, errors) if piece < q else None
        passed = set(few)
        hashes = [grams(c, q) if k not in passed else np.empty(0, np.uint64) for k, c in enumerate(self.codes)]
        of = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        at = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, int)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.lexsort((at, h))
        self.item, self.at, h = of[order], at[order].astype(np.int64), h[order]
        self.hash, rank, self.times = np.unique(h, return_inverse=True, return_counts=True)
        self.place = rank.astype(np.int64) << 32 | self.at
        n = np.array([min(len(c), span) for c in self.codes], np.int64)
        self.width = np.maximum(1, (n * errors).astype(np.int64))
        self.least = np.array([max(1, self.need(int(x))) for x in n], np.int64)
        self.bits = max(16, int(np.ceil(np.log2(len(h) * 16 + 1))))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def need(self, n: int) -> int:
        """Shared q-grams that a window of n characters has at least."""
        return n + 1 - (int(n * self.errors) + 1) * self.q

    def shared(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the text of q-grams that items have, and which of the grams each is."""
        where, rank = [], []
        for i in range(0, len(codes), PIECE):
            h = grams(codes[i : i + PIECE + self.q - 1], self.q)
            p = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.hash, h[p]), max(len(self.hash) - 1, 0))
            there = self.hash[k] == h[p] if len(self.hash) else np.zeros(len(p), bool)
            where.append(p[there] + i)
            rank.append(k[there])
        return np.concatenate(where), np.concatenate(rank)

    def hits(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, int]]:
        """Position in the text, item and position in the item of each shared q-gram, for one range of diagonals after the other, and the range.

        A range holds about ``HITS``, however often a gram repeats in text and items, and what a band that begins in it may have beyond it.
        """
        where, rank = self.shared(codes)
        if not len(where):
            return
        total, longest, room = np.cumsum(self.times[rank]), int(self.at.max()) + 1, 2 * int(self.width.max()) + 1
        first, last = int(where[0]) - longest - room, int(where[-1]) + 1
        while first < last:
            begun = int(np.searchsorted(where, first))
            k = int(np.searchsorted(total, (total[begun - 1] if begun else 0) + HITS))
            end = max(int(where[k]) if k < len(where) else last, first + LEAST)
            mine = slice(begun, int(np.searchsorted(where, end + room + longest)))
            p, of = where[mine], rank[mine] << 32
            lo = np.searchsorted(self.place, of | np.clip(p - end - room + 1, 0, longest))
            hi = np.searchsorted(self.place, of | np.clip(p - first, 0, longest), "right")
            n = np.where(p >= first, np.maximum(hi - lo, 0), 0)
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(p, n), self.item[at], self.at[at], first, end
            first = end

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int, int, int]]:
        """Item, first and end in the text made plain, first and end in the item, edits; the best one of each item."""
        flat = plain(text)
        if not flat or not self.ids:
            return []
        codes, found = codes_of(flat), self.finer.leaks(text) if self.finer else []
        if self.short:
            for k in self.short:
                if (p := flat.find("".join(map(chr, self.codes[k].tolist())))) >= 0:
                    found.append((self.ids[k], p, p + len(self.codes[k]), 0, len(self.codes[k]), 0))
        if len(codes) >= self.q:
            best: dict[int, tuple] = {}
            for k, low, p, at in (r for part in self.hits(codes) for r in self.regions(*part)):
                if (k not in best or best[k][4]) and (got := self._align(codes, self.codes[k], low, p, at)) and (k not in best or got[4] < best[k][4]):
                    best[k] = got
            found += [(self.ids[k], *x) for k, x in best.items()]
        return sorted(found)

    def regions(self, p: np.ndarray, item: np.ndarray, at: np.ndarray, first: int, end: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Item, first diagonal, and hits, of every diagonal band that begins in a range and has as many hits as a window needs.

        A window's q-grams keep within as many diagonals as it may have edits; bands are twice as wide and overlap by half.
        """
        if not len(p):
            return
        for shift in (0, 1):
            wide = self.width[item]
            band = (p - at + shift * wide) // (2 * wide)
            group = item << 40 | band + (1 << 39)
            order = np.argsort(group, kind="stable")
            of, start, n = np.unique(group[order], return_index=True, return_counts=True)
            for g, s, c in zip(of.tolist(), start.tolist(), n.tolist(), strict=True):
                low = int(((g & (1 << 40) - 1) - (1 << 39)) * 2 - shift) * int(self.width[k := g >> 40])
                if c >= self.least[k] and first <= low < end:
                    mine = order[s : s + c]
                    yield k, low, p[mine], at[mine]

    def _align(self, text: np.ndarray, item: np.ndarray, low: int, p: np.ndarray, at: np.ndarray) -> tuple | None:
        """The best window of an item in one band of diagonals from low."""
        n = min(len(item), self.span)
        most, need = int(n * self.errors), self.need(n)
        width, whole = max(1, most), len(item) - n
        order = np.lexsort((p, at))
        p, at = p[order], at[order]
        # a window holds need hits in a row if it starts at the first of them or before, and not too far before for the last
        last = at[need - 1 :]
        begin, least = np.minimum(at[: len(last)], whole), np.maximum(0, last + self.q - n)
        good = least <= begin
        for i in np.flatnonzero(good).tolist():
            f = int(p[i] - at[i] + begin[i])
            if 0 <= f and np.array_equal(text[f : f + n], item[begin[i] : begin[i] + n]):
                return f, f + n, int(begin[i]), int(begin[i]) + n, 0
        steps = np.zeros(whole + 2, np.int64)
        np.add.at(steps, least[good], 1)
        np.add.at(steps, begin[good] + 1, -1)
        starts, best = np.flatnonzero(np.cumsum(steps)[:-1]), None
        for part in (starts[i : i + 512] for i in range(0, len(starts), 512)):
            edits = least_edits(item, part, n, text, low - width, low + 3 * width, most)
            k = int(edits.argmin())
            if edits[k] <= most and (best is None or edits[k] < best[4]):
                first = int(part[k])
                from_ = max(0, low + first - width)
                got = banded(item[first : first + n], text[from_ : low + first + 3 * width + n + 1], low + first - width - from_, low + first + 3 * width - from_, most)
                best = (from_ + got[1], from_ + got[2], first, first + n, got[0])
        return best


def scan(docs: DataFrame, items: list[tuple[int, str | None]], q: int, span: int, errors: float, key: str, text: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(items)
    names = ["item_id", "doc_start", "doc_end", "item_start", "item_end", "edits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(sent.value, q, span, errors)
        for batch in batches:
            rows = [(k, found) for k, t in enumerate(batch.column(text).to_pylist()) for found in block.leaks(t)]
            at = pa.array([k for k, _ in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key).take(at), *(pa.array([r[i] for _, r in rows], pa.int64()) for i in range(6))], names=[key, *names])

    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def blocks(benchmark: DataFrame, most: int = BLOCK) -> Iterator[list[tuple[int, str | None]]]:
    """The items, in blocks of at most most characters; a longer item is a block of its own. One block is on the driver at a time."""
    block: list[tuple[int, str | None]] = []
    size = 0
    for i, t in benchmark.select("item_id", "text").toLocalIterator(prefetchPartitions=False):
        if block and size + len(t or "") > most:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t or "")
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, span: int = SPAN, errors: float = ERRORS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document and item of which it has a passage: where, and with how many edits (the best place).

    Places count characters of the texts made plain: lower case, white space single.
    """
    parts = [scan(docs, b, q, span, errors, key, text) for b in blocks(benchmark)] or [scan(docs, [], q, span, errors, key, text)]
    return reduce(DataFrame.unionAll, parts)


def clean(docs: DataFrame, benchmark: DataFrame, q: int = Q, span: int = SPAN, errors: float = ERRORS, text: str = "text") -> DataFrame:
    """The rows of docs in which no benchmark passage is found; they stay where they are."""

    def without(df: DataFrame, items: list[tuple[int, str | None]]) -> DataFrame:
        sent = df.sparkSession.sparkContext.broadcast(items)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = Block(sent.value, q, span, errors)
            for batch in batches:
                yield batch.filter(pa.array([not block.leaks(t) for t in batch.column(text).to_pylist()], pa.bool_()))

        return df.mapInArrow(keep, df.schema)

    return reduce(without, blocks(benchmark), spread(docs))
