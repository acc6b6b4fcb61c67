"""A quality classifier of subword embeddings.

A text's words (runs of anything but white space) and their character n-grams are hashed into
``BUCKETS`` learned vectors; their average over the document goes through a softmax. A word that
repeats the one before it also counts as ``AGAIN``, since an average can't see order. Vectors
and output weights are trained by stochastic gradient descent in numpy, one document a step, on
at most ``SAMPLE`` labelled documents: the first by a hash of their id, while their features
stay within ``BYTES``. They are made by Spark from their whole texts. Every document is scored from
its whole text.

Null texts count as empty; a text without words gets the score of the bias alone, about the share of
good labels. Without any labels all scores are 0.5. Labels other than 0 and 1 are ignored; repeated
rows are scored alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import by_text, fold, spread

BITS = 15
BUCKETS = 1 << BITS
SIZE = 12
GRAMS = (3, 4)
SAMPLE = 4000
#: Bytes of features that training takes at most, by a bound on each document's: 8 for a bucket, a word and a character at most having their own.
BYTES = 128 << 20
EPOCHS = 4
RATE = 0.5
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Odd factors for a word's characters by place.
PLACES = np.array([(0xD1342543DE82EF95 * (2 * i + 1) ^ 0x2545F4914F6CDD1D) % (1 << 64) | 1 for i in range(64)], np.uint64)
#: Stands for a word that repeats the one before it.
AGAIN = np.uint64(0xA5A5A5A5A5A5A5A5)
FOLDS = 5


def features(text: str | None) -> np.ndarray:
    """Buckets of all words, all n-grams of words between spaces, and all repetitions of a text."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    c = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    inner = c != 32
    hashes = []
    for n in GRAMS:
        h = c[: len(c) - n + 1] * MIX
        whole = np.ones(max(0, len(c) - n + 1), bool)
        for i in range(1, n):
            h = (h ^ c[i : len(c) - n + 1 + i]) * MIX
            if i < n - 1:
                whole &= inner[i : len(c) - n + 1 + i]
        hashes.append(h[whole] * MIX)
    starts = np.flatnonzero(~inner)[:-1]
    place = np.arange(len(c) - 1) - np.repeat(starts, np.diff(np.append(starts, len(c) - 1)))
    own = np.add.reduceat(c[:-1] * PLACES[place % len(PLACES)], starts) * MIX
    again = int((own[1:] == own[:-1]).sum())
    hashes += [own, np.full(again, AGAIN)]
    return (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document and their shares."""
    ids, n = np.unique(features(text), return_counts=True)
    return ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, output weights and bias, by gradient descent one document at a time with a falling rate."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5 / SIZE, 0.5 / SIZE, (BUCKETS, SIZE))
    weights, share = np.zeros((SIZE, 2)), np.bincount(labels, minlength=2) + 1.0
    bias = np.log(share / share.sum())
    weights[:, 1] = rng.uniform(-0.5, 0.5, SIZE)
    step, steps = 0, epochs * max(1, len(bags))
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, part = bags[i]
            now = rate * (1 - step / steps)
            step += 1
            if not len(ids):
                continue
            hidden = part @ vectors[ids]
            p = np.exp((z := hidden @ weights + bias) - z.max())
            off = p / p.sum()
            off[labels[i]] -= 1
            back = weights @ off
            weights -= now * np.outer(hidden, off)
            bias -= 0.05 * now * off
            # a share is a small number, so vectors move by its ratio to the largest
            vectors[ids] -= now * 4 * np.outer(part / part.max(), back) * part.max() ** 0.5
    return vectors.astype(np.float32), weights, bias


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Trains on the driver, from the features of at most sample documents; None if there are no labels."""
    rows = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.max(label).cast("int").alias("y"))
    chosen = F.broadcast(rows.orderBy(F.xxhash64("k"), "k").limit(sample))

    def run(batches):
        for batch in batches:
            bags = [bag(t) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array([i.tobytes() for i, _ in bags]), pa.array([p.tobytes() for _, p in bags])], names=["k", "y", "ids", "part"])

    texts = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    bound = F.least(F.lit(BUCKETS), 4 * F.coalesce(F.char_length("t"), F.lit(0)) + 4) * 8
    sizes = texts.join(chosen, "k").groupBy("k", "y").agg(F.max(bound).cast("long").alias("bytes"))  # at most sample rows
    within = sizes.withColumn("total", F.sum("bytes").over(Window.orderBy(F.xxhash64("k"), "k"))).where(F.col("total") <= most)
    picked = texts.join(F.broadcast(within.select("k", "y")), "k").select("k", "y", "t")
    found = {r["k"]: r for r in picked.mapInArrow(run, f"k {docs.schema[key].dataType.simpleString()}, y int, ids binary, part binary").collect()}
    if not found:
        return None
    ordered = [found[k] for k in sorted(found)]
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["part"], np.float32)) for r in ordered], [r["y"] for r in ordered])


class Scorer:
    """The softmax of two classes over averaged vectors; what each bucket adds to the difference is worked out once."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.lead = vectors.astype(np.float64) @ (weights[:, 1] - weights[:, 0])
        self.bias = float(bias[1] - bias[0])

    def score(self, text: str | None) -> float:
        ids = features(text)
        z = (float(self.lead[ids].mean()) if len(ids) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-z)))


@lru_cache(maxsize=1)
def scorer(sent) -> Scorer:
    return Scorer(*sent.value)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model) if model else None
    kernel = lambda t: (scorer(sent).score(t) if sent else 0.5,)
    return spread(docs.select(key, text)).mapInArrow(by_text(kernel, key, text, [("score", pa.float64())]), f"{key} {docs.schema[key].dataType.simpleString()}, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels outside the held-out fold."""
    held_out = fold(F.col("doc_id"), FOLDS) == 0
    out = score(docs, learn(docs, labels.where(~held_out)))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
