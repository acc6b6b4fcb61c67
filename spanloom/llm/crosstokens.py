"""Alignment of two tokenizers over a corpus: which tokens end together, and how often each pair does.

Both tokenizers split a text's bytes (a space and the text). Where a token of each ends at the same byte, the two are linked; these places cut
both sequences into groups. Neither tokenizer merges over the start of a run of spaces, so a text is taken piece by piece from one
such start to the next, and results of short pieces are remembered.

A pair is packed into one 64-bit key, the second tokenizer's id above the first's. Texts are written with their distinct keys and how often each is
there. From these, partitions make partial counts (``np.unique``, flushed at ``HELD`` keys), which are sorted globally by ranges and
summed run by run. Each range is written as a shard, two flat files of sorted keys and counts in the shared folder; a second pass over the
texts looks its keys up in the shards by ``searchsorted``, mapped into memory, so that a task holds only what it touches. Where the shared folder isn't
mounted as files, keys are joined with the same counts instead. The driver holds a row per shard and a number per id of the second tokenizer.

Null and empty texts, and those whose tokens' bytes don't spell the text, have no tokens: zeros, an empty digest, and no part in the counts. Special
tokens' strings inside texts are plain text. Rows count one by one, with repeated or null ids too.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.bpe import byte_letters, vocabulary_path
from spanloom.llm.common import shared_dir, spread, stored

#: Pieces that are remembered, and their longest; distinct keys that a task holds before it passes them on; bytes of keys of an output batch.
CACHE, SHORT, HELD, FLUSH = 400_000, 48, 2_000_000, 8_000_000
LOW = (1 << 32) - 1


def pieces(text: str) -> list[str]:
    """The text cut before every run of spaces that follows another character, each piece without its first space (of which the text has one more)."""
    first, *rest = text.split(" ")
    out, now = [], first
    for p in rest:
        if now and not now[-1].isspace():
            out.append(now)
            now = p
        else:
            now += f" {p}"
    if out and not now:  # a last space alone is no text of the second tokenizer
        now = f"{out.pop()} "
    out.append(now)
    return out


class Unspelled(Exception):
    """Tokens whose bytes aren't those of the text."""


class Aligner:
    """Both tokenizers, with the bytes of their tokens and the pieces met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(path_a, encoding="utf-8") as f:
            model = json.load(f)
        letters = byte_letters()
        ids = model["model"]["vocab"]
        self.bytes_a = [b""] * (1 + max([*ids.values(), *(t["id"] for t in model["added_tokens"])]))
        for token, i in ids.items():
            self.bytes_a[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i in range(len(self.b)) for p in [self.b.id_to_piece(i)]]
        if any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.b))):
            raise ValueError("the second tokenizer has pieces that reach over the start of spaces")
        self.names = [str(i) for i in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.known: dict[str, tuple[int, int, str, tuple[int, ...]] | None] = {}

    def cut(self, parts: list[str]) -> Iterator[tuple[int, int, str, tuple[int, ...]]]:
        """Numbers of tokens, groups and keys of each of some pieces, which are taken as one text."""
        text = f" {' '.join(parts)}"
        a, b, data = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:]), text.encode()
        in_a, in_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(in_a) != data or b"".join(in_b) != data:
            raise Unspelled
        names, i, j, end_a, end_b, end = self.names, 0, 0, 0, 0, 0
        for p in parts:
            end += 1 + len(p.encode())
            groups, keys, from_a, from_b, first_a, first_b = [], [], i, j, i, j
            while end_a < end or end_b < end:  # where a piece ends both do
                if end_a <= end_b:
                    end_a += len(in_a[i])
                    i += 1
                else:
                    end_b += len(in_b[j])
                    j += 1
                if end_a == end_b:
                    left = names[a[first_a]] if i - first_a == 1 else ",".join([names[x] for x in a[first_a:i]])
                    right = names[b[first_b]] if j - first_b == 1 else ",".join([names[x] for x in b[first_b:j]])
                    groups.append(f"{left}|{right}")
                    keys.append(b[j - 1] << 32 | a[i - 1])
                    first_a, first_b = i, j
            yield i - from_a, j - from_b, ";".join(groups), tuple(keys)

    def learn(self, parts: list[str]) -> dict[str, tuple | None]:
        """What is to be known of pieces; None of those whose tokens don't spell them."""
        try:
            return dict(zip(parts, self.cut(parts), strict=True))
        except Unspelled:
            half = len(parts) // 2
            return self.learn(parts[:half]) | self.learn(parts[half:]) if half else {parts[0]: None}

    def aligned(self, text: str | None) -> tuple[int, int, str, np.ndarray]:
        """Numbers of tokens, groups and keys of a text."""
        none = (0, 0, "", np.empty(0, np.int64))
        if not text:
            return none
        parts = pieces(text)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = list({p: None for p in parts if p not in known})
        loose = [new.pop()] if new and new[-1][-1:].isspace() else []  # a text's last piece may end in spaces: nothing may follow it
        for some in filter(None, (new, loose)):
            known |= self.learn(some)
        found = [known[p] for p in parts]
        for p in (*new, *loose):
            if len(p) > SHORT:
                del known[p]
        if None in found:
            return none
        return sum([f[0] for f in found]), sum([f[1] for f in found]), ";".join([f[2] for f in found]), np.fromiter(chain.from_iterable([f[3] for f in found]), np.int64)


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


TEXTS = "id long, n_a long, n_b long, n_groups long, sha string, keys array<long>, times array<int>"


def aligned(texts: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """id, n_a, n_b, n_groups, sha, and the distinct keys with how often each is there, of rows (id, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for batch in batches:
            ids, rows, size = batch.column("id"), [], 0

            def packed(first: int) -> pa.RecordBatch:
                ends = np.cumsum([0, *(len(r[4]) for r in rows)])  # noqa: B023
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, kind), *(r[i] for r in rows)]).astype(kind))) for i, kind in ((4, np.int64), (5, np.int32))]  # noqa: B023
                plain = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))]  # noqa: B023
                return pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *plain, *lists], names=["id", "n_a", "n_b", "n_groups", "sha", "keys", "times"])  # noqa: B023

            first = 0
            for i, t in enumerate(batch.column("t")):
                n_a, n_b, groups, keys = both.aligned(t.as_py())
                distinct, times = np.unique(keys, return_counts=True)
                rows.append((n_a, n_b, len(keys), hashlib.sha256(groups.encode()).hexdigest() if n_a else "", distinct, times))
                size += 12 * len(distinct)
                if size >= FLUSH:
                    yield packed(first)
                    first, rows, size = i + 1, [], 0
            yield packed(first)

    return texts.mapInArrow(run, TEXTS)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, each once, with their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[start], np.add.reduceat(counts, start) if len(start) else counts


def partial_counts(found: DataFrame) -> DataFrame:
    """key, n: counts of each partition's own texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            more, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("keys", "times"))
            keys, counts = summed(np.concatenate([keys, more]), np.concatenate([counts, times]))
            if len(keys) >= HELD:
                yield from rows(keys, counts)
                keys, counts = keys[:0], counts[:0]
        yield from rows(keys, counts)

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 65536]), pa.array(counts[i : i + 65536])], names=["key", "n"])

    return found.select("keys", "times").mapInArrow(run, "key long, n long")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sums of the runs of equal keys of sorted rows; a run may go on in the next batch."""
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        keys, counts = summed(np.concatenate([keys, batch.column("key").to_numpy()]), np.concatenate([counts, batch.column("n").to_numpy()]))
        yield keys[:-1], counts[:-1]
        keys, counts = keys[-1:], counts[-1:]
    yield keys, counts


def mounted(where: str) -> str | None:
    """The folder's path, if it is one of files."""
    url = urlparse(where)
    return unquote(url.path) if url.scheme in ("", "file") else None


def shards(partial: DataFrame, folder: str) -> DataFrame:
    """shard, first, b, most: the shards written, and the largest count of each of their second ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, most = uuid.uuid4().hex, None, {}  # a repeated task writes files of its own
        with open(f"{folder}/{name}.keys", "wb") as f, open(f"{folder}/{name}.counts", "wb") as g:
            for keys, counts in runs(batches):
                if len(keys):
                    first = int(keys[0]) if first is None else first
                    f.write(keys.tobytes())
                    g.write(counts.tobytes())
                    b = keys >> 32
                    start = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
                    for i, top in zip(b[start].tolist(), np.maximum.reduceat(counts, start).tolist(), strict=True):
                        most[i] = max(most.get(i, 0), top)
        if most:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(most)), pa.array([first] * len(most)), pa.array(list(most)), pa.array(list(most.values()))], names=["shard", "first", "b", "most"])
        else:
            os.remove(f"{folder}/{name}.keys")
            os.remove(f"{folder}/{name}.counts")

    return partial.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(run, "shard string, first long, b long, most long")


class Shards:
    """Sorted counts, mapped into memory shard by shard as they are asked for."""

    def __init__(self, folder: str, places: list[tuple[int, str]]):
        self.folder, self.places = folder, sorted(places)
        self.first = np.array([f for f, _ in self.places], np.int64)
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Of sorted keys that are all there."""
        out = np.empty(len(keys), np.int64)
        at = np.searchsorted(self.first, keys, side="right") - 1
        for k in np.unique(at):
            if k not in self.open:
                self.open[k] = tuple(np.memmap(f"{self.folder}/{self.places[k][1]}.{kind}", np.int64, "r") for kind in ("keys", "counts"))
            mine, (known, n) = at == k, self.open[k]
            out[mine] = n[np.searchsorted(known, keys[mine])]
        return out


RESULT = "n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def looked_up(found: DataFrame, folder: str, written: DataFrame, key: str) -> DataFrame:
    rows = written.collect()  # a row for each shard and second id in it
    places = sorted({(r["first"], r["shard"]) for r in rows})
    most = np.zeros(1 + max((r["b"] for r in rows), default=0), np.int64)
    for r in rows:
        most[r["b"]] = max(most[r["b"]], r["most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Shards(folder, places)
        for batch in batches:
            keys, times = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("keys", "times"))
            distinct, back = np.unique(keys, return_inverse=True)
            n = known.counts(distinct)
            best = (n == most[distinct >> 32])[back] if len(keys) else np.empty(0, bool)
            row = np.repeat(np.arange(batch.num_rows), [len(x) for x in batch.column("keys")])
            add = lambda v: pa.array(np.array([int(x) for x in np.add.reduceat(np.append(v, 0), starts)]) * filled) if len(filled) else pa.array([], pa.int64())  # noqa: E731, B023
            starts = np.searchsorted(row, np.arange(batch.num_rows))
            filled = np.diff(np.append(starts, len(row))) > 0
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in ("n_a", "n_b", "n_groups")), add(times), add(times * best), add(times * n[back]), batch.column("sha")], names=[key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return found.mapInArrow(run, f"{key} long, {RESULT}")


def joined(found: DataFrame, partial: DataFrame, key: str) -> DataFrame:
    """The same by joins, for shared folders that can't be mapped."""
    counts = stored(partial.groupBy("key").agg(F.sum("n").alias("n")).withColumn("b", F.shiftright("key", 32)), "counts")
    ranked = counts.join(counts.groupBy("b").agg(F.max("n").alias("most")), "b").select("key", "n", (F.col("n") == F.col("most")).alias("best"))
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "rows")
    links = rows.select("row", F.inline(F.arrays_zip("keys", "times"))).select("row", F.col("keys").alias("key"), "times").join(ranked, "key")
    sums = links.groupBy("row").agg(F.sum("times").alias("n_links"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select(F.col("id").alias(key), "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), F.col("sha").alias("groups_sha256"))


def report(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path("piece_bpe_32k.model")
    texts = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")))
    found = stored(aligned(texts, path_a, path_b), "aligned")
    partial = stored(partial_counts(found), "partial-counts")
    folder = mounted(shared_dir(docs.sparkSession))
    if folder is None:
        return joined(found, partial, key)
    folder = f"{folder}/shards-{uuid.uuid4().hex}"
    os.makedirs(folder)
    return looked_up(found, folder, shards(partial, folder), key)


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b, n: how often each pair of ids ends together in the corpus."""
    texts = spread(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")))
    found = aligned(texts, path_a or vocabulary_path(), path_b or vocabulary_path("piece_bpe_32k.model"))
    sums = partial_counts(found).groupBy("key").agg(F.sum("n").alias("n"))
    return sums.select(F.col("key").bitwiseAND(F.lit(LOW)).alias("a"), F.shiftright("key", 32).alias("b"), "n")
