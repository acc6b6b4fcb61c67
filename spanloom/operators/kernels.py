"""Dynamic programmes for a pair or an utterance, as small numpy helpers that Spark applies to rows or batches."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import FOLDED, FOLDS, MARK_RANGES

INFEASIBLE = 1e9
_DROP = {c: None for a, b in MARK_RANGES for c in range(a, b + 1)} | {ord(a): b for a, b in zip(FOLDED, FOLDS, strict=True)}


@lru_cache(maxsize=1 << 16)
def normal(text: str) -> str:
    """What functions.text.normalize gives, for one text."""
    form = lambda c: unicodedata.normalize("NFKC", c) if "ﭐ" <= c <= "﷿" or "ﹰ" <= c <= "ﻼ" else c
    return " ".join("".join(map(form, text)).translate(_DROP).split())


def edits_along(query: Sequence, target: Sequence, free: bool = False) -> list[int]:
    """Edits between the query and each beginning of the target, from the empty one on; if free, between it and the best stretch that ends there.

    A column of the dynamic programme is two whole numbers, whose bits tell where it rises and falls.
    """
    if not query:
        return [0] * (len(target) + 1) if free else list(range(len(target) + 1))
    places: dict = {}
    for i, c in enumerate(query):
        places[c] = places.get(c, 0) | 1 << i
    n, carry = len(query), 0 if free else 1
    every, top = (1 << n) - 1, 1 << n - 1
    rises, falls, score = every, 0, n
    out = [n]
    for c in target:
        same = places.get(c, 0)
        either = same | falls
        level = (((same & rises) + rises) ^ rises) | same
        up, down = falls | every & ~(level | rises), rises & level
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        out.append(score)
        up = up << 1 | carry
        rises = (down << 1 | ~(either | up)) & every
        falls = up & either & every
    return out


def edit_distance(a: Sequence, b: Sequence) -> int:
    return edits_along(a, b)[-1] if len(a) < len(b) else edits_along(b, a)[-1]


@lru_cache(maxsize=1 << 18)
def ratio(a: str, b: str) -> float:
    return 1.0 if a == b else 0.0 if not a or not b else 1.0 - edit_distance(a, b) / max(len(a), len(b))


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """ratio of every word of a with every one of b, all pairs at once: the columns of edits_along as bits of 64-bit words.

    A word of b takes part for as many steps as it has letters; those of a that are longer than 64 are compared one by one.
    """
    if not a or not b:
        return np.zeros((len(a), len(b)))
    n, m = (np.array([len(w) for w in s], np.int64) for s in (a, b))
    edits = np.empty((len(a), len(b)), np.int64)
    for i in np.flatnonzero(n > 64):
        edits[i] = [edit_distance(a[i], w) for w in b]
    short, order = np.flatnonzero((n > 0) & (n <= 64)), np.argsort(-m, kind="stable")
    if len(short):
        number: dict[str, int] = {}
        places: dict[tuple[int, int], int] = {}
        for k, i in enumerate(short):
            for at, c in enumerate(a[i]):
                key = number.setdefault(c, len(number)), k
                places[key] = places.get(key, 0) | 1 << at
        table = np.zeros((len(number) + 1, len(short)), np.uint64)  # the last row is for letters that a doesn't have
        table[tuple(zip(*places, strict=True))] = list(places.values())
        letters = np.full((int(m.max()), len(b)), len(number))
        for k, j in enumerate(order):
            letters[: m[j], k] = [number.get(c, len(number)) for c in b[j]]
        one, last = np.uint64(1), (n[short] - 1).astype(np.uint64)
        plus, minus = np.full((len(b), len(short)), ~np.uint64(0)), np.zeros((len(b), len(short)), np.uint64)
        score = np.repeat(n[short][None, :], len(b), axis=0)
        live = np.searchsorted(-m[order], -np.arange(len(letters)), side="left")  # words of b that are longer than so much
        for step, k in zip(letters, live, strict=True):
            p, v, same = plus[:k], minus[:k], table[step[:k]]
            either = same | v
            level = (((same & p) + p) ^ p) | same
            up, down = v | ~(level | p), p & level
            score[:k] += ((up >> last) & one).view(np.int64) - ((down >> last) & one).view(np.int64)
            up = up << one | one
            plus[:k] = down << one | ~(either | up)
            minus[:k] = up & either
        edits[np.ix_(short, order)] = score.T
    edits[n == 0] = m
    longest = np.maximum(n[:, None], m[None, :])
    return np.where(longest == 0, 1.0, 1.0 - edits / np.maximum(longest, 1))


Aligned = list[tuple[str, int | None, int | None, float | None]]


def align_all(references: list[list[str]], hypothesis: list[str], gap: float = 0.5) -> list[Aligned]:
    """Global word alignments of one hypothesis with each of many references, all at once.

    Rows are (status, place in the reference, place in the hypothesis, score). Of equally good ways a pair goes before a gap,
    a missing word before an extra one. Words are compared as they are.
    """
    return _aligned(references, [hypothesis] * len(references), gap) if references else []


def align_pairs(references: list[Sequence[str]], hypotheses: list[Sequence[str]], gap: float = 0.5) -> list[Aligned]:
    """align_all for a hypothesis of its own to each reference.

    Every word of one side is compared with every one of the other only among pairs that share so many words that this costs about what they do apart.
    """
    same = [list(r) == list(h) for r, h in zip(references, hypotheses, strict=True)]  # no other way is as good as all matches
    out: list[Aligned] = [[("match", i, i, 1.0) for i in range(len(r))] if x else [] for r, x in zip(references, same, strict=True)]
    sets = [(set(r), set(h)) for r, h in zip(references, hypotheses, strict=True)]
    parts = [p] if (p := [k for k, x in enumerate(same) if not x]) else []
    while parts:
        ks = parts.pop()
        size = len(set().union(*(sets[k][0] for k in ks))) * len(set().union(*(sets[k][1] for k in ks)))
        if len(ks) > 1 and size > min(CELLS, 2 * sum(len(r) * len(h) for r, h in (sets[k] for k in ks))):
            parts += [ks[: len(ks) // 2], ks[len(ks) // 2 :]]
            continue
        ks.sort(key=lambda k: (len(hypotheses[k]), len(references[k])))
        for k, rows in zip(ks, _aligned([references[k] for k in ks], [hypotheses[k] for k in ks], gap), strict=True):
            out[k] = rows
    return out


def padded(rows: list[Sequence], number: dict, fill: int) -> np.ndarray:
    """The rows' items by number, filled up to the longest."""
    out = np.full((len(rows), max(map(len, rows), default=0)), fill, np.int64)
    for k, r in enumerate(rows):
        out[k, : len(r)] = [number[w] for w in r]
    return out


def together(references: list[Sequence], hypotheses: list[Sequence]) -> Iterator[slice]:
    """Parts of the pairs whose dynamic programmes are held at once."""
    at = 0
    while at < len(references):
        end, n, m = at, 0, 0
        while end < len(references) and (end == at or (end + 1 - at) * (max(n, len(references[end])) + 1) * (max(m, len(hypotheses[end])) + 1) <= TOGETHER):
            n, m, end = max(n, len(references[end])), max(m, len(hypotheses[end])), end + 1
        yield slice(at, end)
        at = end


def _aligned(references: list[Sequence[str]], hypotheses: list[Sequence[str]], gap: float) -> list[Aligned]:
    words, of = ({w: k for k, w in enumerate(dict.fromkeys(w for x in s for w in x))} for s in (references, hypotheses))
    same = np.concatenate([ratios(list(words), list(of)), np.full((1, len(of)), -1e9)])  # the last row stands for what is past a reference's end
    out = []
    for part in together(references, hypotheses):
        some, heard = references[part], hypotheses[part]
        out += _traced(padded(some, words, len(words)), list(map(len, some)), same, padded(heard, of, 0), list(map(len, heard)), gap)
    return out


#: Pairs of words, and cells of dynamic programmes, that are held at once.
CELLS, TOGETHER = 1 << 20, 1 << 20


def _traced(ids: np.ndarray, length: list[int], same: np.ndarray, columns: np.ndarray, heard: list[int], gap: float) -> list[Aligned]:
    """Alignments of pairs of a reference, given as rows of same, and a hypothesis, as columns of it."""
    step = gap * np.arange(ids.shape[1] + 1)
    score = np.empty((columns.shape[1] + 1, *ids.shape[:1], len(step)))
    score[0] = -step
    pair = np.empty((columns.shape[1], *ids.shape))
    for i in range(columns.shape[1]):
        np.add(score[i, :, :-1], same[ids, columns[:, i : i + 1]], out=pair[i])
        new = score[i] - gap
        np.maximum(new[:, 1:], pair[i], out=new[:, 1:])
        new += step
        np.maximum.accumulate(new, axis=1, out=new)
        np.subtract(new, step, out=score[i + 1])
    way = np.full(score.shape, 2, np.int8)  # 0 a pair, 1 a missing word, 2 an extra one
    way[0] = 1
    least = score[1:, :, 1:] - 1e-9
    np.copyto(way[1:, :, 1:], 1, where=score[1:, :, :-1] - gap >= least)
    np.copyto(way[1:, :, 1:], 0, where=pair >= least)
    out, wide = [], len(step)
    for k, (n, m) in enumerate(zip(length, heard, strict=True)):
        i, j, rows, ways = m, n, [], way[:, k].tobytes()
        while i or j:
            kind = ways[i * wide + j]
            if kind == 0:
                i, j = i - 1, j - 1
                s = float(same[ids[k, j], columns[k, i]])
                rows.append(("match" if s >= 0.8 else "near" if s >= 0.5 else "mismatch", j, i, s))
            elif kind == 1:
                j -= 1
                rows.append(("missing", j, None, None))
            else:
                i -= 1
                rows.append(("extra", None, i, None))
        out.append(rows[::-1])
    return out


def align(reference: list[str], hypothesis: list[str], gap: float = 0.5) -> list[tuple[str, str | None, str | None, float | None]]:
    """Global word alignment by similarity of normalised words: (status, reference, hypothesis, score) rows."""
    ref, hyp = ([w for w in s if w and w.strip()] for s in (reference, hypothesis))
    rows = align_all([[normal(w) for w in ref]], [normal(w) for w in hyp], gap)[0]
    return [(status, None if i is None else ref[i], None if j is None else hyp[j], s) for status, i, j, s in rows]


def word_errors(reference: list[str], hypothesis: list[str]) -> tuple[int, int, int, int]:
    """Reference words, substitutions, deletions, insertions; a pair goes before a deletion, that before an insertion."""
    a, b = normal(" ".join(reference)).split(), normal(" ".join(hypothesis)).split()
    cost = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    cost[:, 0], cost[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    offset, other = np.arange(len(b) + 1), np.array(b, object)
    for i, w in enumerate(a, 1):
        cost[i, 1:] = np.minimum(cost[i - 1, :-1] + (other != w), cost[i - 1, 1:] + 1) if b else cost[i, 1:]
        cost[i] = np.minimum.accumulate(cost[i] - offset) + offset
    i, j, s, d, n = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            s += a[i - 1] != b[j - 1]
            i, j = i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 1:
            d, i = d + 1, i - 1
        else:
            n, j = n + 1, j - 1
    return len(a), int(s), d, n


def word_errors_all(references: Sequence[Sequence[str]], hypotheses: Sequence[Sequence[str]]) -> list[tuple[int, int, int, int]]:
    """word_errors of many pairs, those of about one length at once."""
    told = lambda s: [[x for w in words for x in normal(w).split()] for words in s]
    a, b = told(references), told(hypotheses)
    order, out = sorted((k for k in range(len(a)) if a[k] != b[k]), key=lambda k: (len(b[k]), len(a[k]))), [(len(x), 0, 0, 0) for x in a]
    number: dict[str, int] = {}
    for words in (*a, *b):
        for w in words:
            number.setdefault(w, len(number))
    a, b = [a[k] for k in order], [b[k] for k in order]
    for part in together(a, b):
        x, y = padded(a[part], number, -1), padded(b[part], number, -2)
        cost = np.empty((x.shape[1] + 1, len(x), y.shape[1] + 1), np.int32)
        way = np.full(cost.shape, 2, np.int8)  # 0 a pair of one word, 1 a substitution, 2 an insertion, 3 a deletion
        offset = np.arange(y.shape[1] + 1, dtype=np.int32)
        cost[0] = offset
        for i in range(x.shape[1]):
            other = x[:, i : i + 1] != y
            pair, new = cost[i, :, :-1] + other, cost[i] + 1
            np.minimum(new[:, 1:], pair, out=new[:, 1:])
            new -= offset
            np.minimum.accumulate(new, axis=1, out=new)
            np.add(new, offset, out=cost[i + 1])
            np.copyto(way[i + 1], 3, where=cost[i + 1] == cost[i] + 1)
            np.copyto(way[i + 1, :, 1:], other, where=cost[i + 1, :, 1:] == pair)
        wide = y.shape[1] + 1
        for k, (n, m) in enumerate(zip(map(len, a[part]), map(len, b[part]), strict=True)):
            i, j, found, ways = n, m, [0, 0, 0, 0], way[:, k].tobytes()
            while i or j:
                kind = ways[i * wide + j]
                found[kind] += 1
                i, j = i - (kind != 2), j - (kind != 3)
            out[order[part.start + k]] = n, found[1], found[3], found[2]
    return out


def ctc_score(logs: np.ndarray, tokens: list[int], blank: int, per_token: bool = False) -> float:
    """Negative log-probability of a token sequence over all its alignments, per frame or token; 1e9 if it doesn't fit."""
    n, frames = len(tokens), len(logs)
    if not n or 2 * n + 1 > frames:
        return INFEASIBLE
    states = np.full(2 * n + 1, blank)
    states[1::2] = tokens
    skips = np.zeros(2 * n + 1, bool)
    skips[3::2] = states[3::2] != states[1:-2:2]
    alpha = np.full(2 * n + 1, -np.inf)
    alpha[:2] = logs[0, states[:2]]
    for t in range(1, frames):
        one = np.concatenate([[-np.inf], alpha[:-1]])
        two = np.where(skips, np.concatenate([[-np.inf, -np.inf], alpha[:-2]]), -np.inf)
        alpha = np.logaddexp(np.logaddexp(alpha, one), two) + logs[t, states]
    total = float(np.logaddexp(alpha[-1], alpha[-2]))
    return -total / (n if per_token else frames) if math.isfinite(total) else INFEASIBLE


def ctc_scores(logs: np.ndarray, sequences: list[list[int]], blank: int, per_token: bool = False) -> np.ndarray:
    """ctc_score of many token sequences, the evidence read once for all of them."""
    frames, n = len(logs), np.array([len(s) for s in sequences], np.int64)
    out = np.full(len(sequences), INFEASIBLE)
    fits = np.flatnonzero((n > 0) & (2 * n + 1 <= frames))
    if not len(fits):
        return out
    n, width = n[fits], 2 * int(n[fits].max()) + 1
    states = np.full((len(fits), width), blank)
    for k, i in enumerate(fits):
        states[k, 1 : 2 * len(sequences[i]) : 2] = sequences[i]
    skips = np.zeros((len(fits), width), bool)
    skips[:, 3::2] = states[:, 3::2] != states[:, 1:-2:2]
    alpha = np.full((len(fits), width + 2), -np.inf)  # two columns before the first state
    alpha[:, 2:4] = logs[0][states[:, :2]]
    for t in range(1, frames):
        two = np.where(skips, alpha[:, :-2], -np.inf)
        alpha[:, 2:] = np.logaddexp(np.logaddexp(alpha[:, 2:], alpha[:, 1:-1]), two) + logs[t][states]
    rows = np.arange(len(fits))
    total = np.logaddexp(alpha[rows, 2 * n + 2], alpha[rows, 2 * n + 1])
    good = np.isfinite(total)
    out[fits[good]] = -total[good] / (n[good] if per_token else frames)
    return out


def tolerant_scores(logs: np.ndarray, sequences: list[list[int]], blank: int, opening: list[int]) -> np.ndarray:
    """The better of each whole sequence and, where it begins with the opening, of what follows that."""
    k = len(opening)
    short = [i for i, s in enumerate(sequences) if k and len(s) > k and list(s[:k]) == list(opening)]
    scores = ctc_scores(logs, [*sequences, *(sequences[i][k:] for i in short)], blank)
    out = scores[: len(sequences)].copy()
    np.minimum.at(out, np.array(short, np.int64), scores[len(sequences) :])
    return out


def ctc_align(logs: np.ndarray, tokens: list[int], blank: int) -> list[tuple[int, int]] | None:
    """First and last frame of each token on the best path; ties keep the smaller step. None if it doesn't fit."""
    n, frames = len(tokens), len(logs)
    if not n or 2 * n + 1 > frames:
        return None
    states = np.full(2 * n + 1, blank)
    states[1::2] = tokens
    skips = np.zeros(2 * n + 1, bool)
    skips[3::2] = states[3::2] != states[1:-2:2]
    score, steps = np.full(2 * n + 1, -np.inf), np.zeros((frames, 2 * n + 1), np.int8)
    score[:2] = logs[0, states[:2]]
    for t in range(1, frames):
        from_ = np.stack([score, np.concatenate([[-np.inf], score[:-1]]), np.where(skips, np.concatenate([[-np.inf, -np.inf], score[:-2]]), -np.inf)])
        steps[t] = from_.argmax(axis=0)
        score = from_.max(axis=0) + logs[t, states]
    s = 2 * n if score[-1] >= score[-2] else 2 * n - 1
    path = [s]
    for t in range(frames - 1, 0, -1):
        s -= steps[t, s]
        path.append(int(s))
    path = np.array(path[::-1])
    spans = [np.flatnonzero(path == 2 * k + 1) for k in range(n)]
    return None if any(not len(x) for x in spans) else [(int(x[0]), int(x[-1])) for x in spans]


def longest_stable_prefix(scores: list[float], lengths: list[int], tolerance: float = 0.12) -> int | None:
    """The longest prefix whose score is within tolerance of the best; the last of equal lengths."""
    if not scores or min(scores) >= INFEASIBLE:
        return None
    near = [i for i, s in enumerate(scores) if s <= min(scores) + tolerance]
    return max(near, key=lambda i: (lengths[i], i))


def words_read(logs: np.ndarray, words: list[list[int]], blank: int, tolerance: float = 0.35) -> int:
    """Words whose prefix still scores, per token, within tolerance of the best prefix."""
    scores = [ctc_score(logs, [t for w in words[: k + 1] for t in w], blank, per_token=True) for k in range(len(words))]
    best = longest_stable_prefix(scores, list(range(1, len(words) + 1)), tolerance)
    return 0 if best is None else best + 1


def progress(logs: np.ndarray, words: list[list[int]], blank: int) -> tuple[int, int]:
    """Words read so far and the last frame of the last of them: those whose first token starts by the last frame that isn't blank.

    Without a way through all tokens the number comes from prefix scores, and the frame is -1; so is it if all frames are blank.
    """
    flat = [t for w in words for t in w]
    if not flat:
        return 0, -1
    spans = ctc_align(logs, flat, blank)
    if spans is None:
        return words_read(logs, words, blank), -1
    content = np.flatnonzero(logs.argmax(axis=1) != blank)
    if not len(content):
        return 0, -1
    firsts = np.cumsum([0, *map(len, words)])
    read = int(np.searchsorted([spans[i][0] for i in firsts[:-1]], content[-1], side="right"))
    return read, spans[firsts[read] - 1][1] if read else -1


def heard_up_to(text: str, words: list[str], least: float = 0.55) -> int:
    """The place of the word in which a shorter text's best stretch of a verse ends, spaces apart; -1 if none is alike enough.

    Stretches a fifth of the text apart are compared, then all near the best one; the first of equals counts.
    """
    said, whole = text.replace(" ", ""), "".join(words)
    n = len(said)
    if n < 3 or n >= len(whole):
        return -1
    alike = lambda i: (2 * n - edit_distance(said, whole[i : i + n])) / (2 * n)
    step, last = max(1, n // 5), len(whole) - n
    coarse = max(range(0, last + 1, step), key=lambda i: (alike(i), -i))
    near = range(max(0, coarse - step), min(last, coarse + step) + 1)
    fine = max(near, key=lambda i: (alike(i), i == coarse, -i))
    if alike(fine) < least:
        return -1
    return min(int(np.searchsorted(np.cumsum([len(w) for w in words]), fine + n)), len(words) - 1)


def fewest_tokens(piece: str, vocabulary: set[str]) -> list[str] | None:
    """The split into known tokens of fewest parts, then of the largest sum of squared lengths; None if there is none."""
    longest = max(map(len, vocabulary), default=0)
    best: list[tuple[int, int, int] | None] = [(0, 0, 0)] + [None] * len(piece)  # tokens, minus squares, start of the last
    for end in range(1, len(piece) + 1):
        for start in range(max(0, end - longest), end):
            if best[start] and piece[start:end] in vocabulary:
                new = (best[start][0] + 1, best[start][1] - (end - start) ** 2, start)
                if best[end] is None or new[:2] < best[end][:2]:
                    best[end] = new
    if best[-1] is None:
        return None
    out, end = [], len(piece)
    while end:
        out.append(piece[best[end][2] : end])
        end = best[end][2]
    return out[::-1]


def longest_tokens(piece: str, vocabulary: set[str], unknown: str = "<unk>") -> list[str]:
    """The longest known token each time, else the unknown mark for a character."""
    longest, at, out = max(map(len, vocabulary), default=1), 0, []
    while at < len(piece):
        n = next((k for k in range(min(longest, len(piece) - at), 0, -1) if piece[at : at + k] in vocabulary), 0)
        out.append(piece[at : at + n] if n else unknown)
        at += n or 1
    return out


def nearest_fragment(query: str, target: str) -> float:
    """1 less the edits of the query against its best stretch of the target, over its length."""
    return max(0.0, 1.0 - min(edits_along(query, target, free=True)) / len(query)) if query else 1.0


def shared_subsequence(a: str, b: str) -> float:
    """Length of the longest common subsequence over the length of b; 0 for an empty b."""
    if not b:
        return 0.0
    y, row = np.array([ord(c) for c in b]), np.zeros(len(b) + 1, np.int64)
    for c in map(ord, a):
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == c)))
    return float(row[-1]) / len(b)


def follow_words(heard: list[str], verse: list[str], start: int = 0, ahead: int = 5, threshold: float = 0.7) -> tuple[int, list[int]]:
    """Position after the last verse word found, and those found, reading the heard words in order with a bounded look ahead."""
    def alike(u: str, v: str) -> bool:
        total = len(u) + len(v)
        return u == v or len(u) > 2 and len(v) > 2 and (total - edit_distance(u, v)) / total >= threshold

    at, found = start, []
    for w in heard:
        k = next((i for i in range(at, min(at + ahead, len(verse))) if alike(w, verse[i])), None)
        if k is not None:
            found.append(k)
            at = k + 1
    return at, found


def stitch(texts: list[str], most: int = 80, least: int = 2) -> list[str]:
    """Words of overlapping windows as one text: what a window begins with and the text ends with is taken once."""
    words: list[str] = []
    plain: list[str] = []
    for text in texts:
        new = (text or "").split()
        flat = [normal(w) for w in new]
        limit = min(len(new), most, len(plain))
        k = next((k for k in range(limit, 0, -1) if (k >= least or k == len(flat)) and plain[-k:] == flat[:k]), 0)
        words += new[k:]
        plain += flat[k:]
    return words


def best_path(cycles: list[list[tuple[str, float]]], step) -> list[str]:
    """One candidate of each cycle: the greatest sum of scores and of step(previous, next, score of the next); the first of equals."""
    if not cycles:
        return []
    total, back = [s for _, s in cycles[0]], []
    for before, cycle in zip(cycles, cycles[1:], strict=False):
        found = [max(range(len(before)), key=lambda i: (total[i] + step(before[i][0], r, s), -i)) for r, s in cycle]
        total = [total[i] + step(before[i][0], r, s) + s for i, (r, s) in zip(found, cycle, strict=True)]
        back.append(found)
    at = max(range(len(total)), key=lambda i: (total[i], -i))
    path = [at]
    for found in reversed(back):
        path.append(at := found[at])
    return [cycle[i][0] for cycle, i in zip(cycles, reversed(path), strict=True)]


#: What a step within a chapter adds by how many verses it goes ahead; any other step ahead, back, or to another chapter (less if that is all but certain).
AHEAD = {0: 0.15, 1: 0.35, 2: -0.3, 3: -0.45}
FAR, BACK, ELSEWHERE, ELSEWHERE_SURE, SURE = -0.65, -1.0, -1.25, -0.35, 0.85


def transition(previous: str, following: str, confidence: float = 0.0) -> float:
    """What a step between refs (chapter:verse or chapter:first-last) adds to a path, from the last verse of one to the first of the next."""
    c, verses = previous.split(":")
    d, w = following.split("-")[0].split(":")
    v, w = int(verses.split("-")[-1]), int(w)
    if int(c) != int(d):
        return ELSEWHERE_SURE if confidence >= SURE else ELSEWHERE
    return BACK if w < v else AHEAD.get(w - v, FAR)


def fnv64(text: str) -> str:
    """The 64-bit FNV-1a hash of the UTF-8 bytes, in hex."""
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
    return f"{h:016x}"


#: Counts of a pair's alignment by status, and of its word errors.
STATUSES, ERRORS = ("match", "near", "mismatch", "missing", "extra"), ("words", "substitutions", "deletions", "insertions")


def counts_by_status(references: Sequence, hypotheses: Sequence) -> list[tuple]:
    """How many words of each pair's alignment have each status."""
    told = lambda c: [tuple(normal(w) for w in ([] if s is None else s) if w and w.strip()) for s in c]
    known, heard, asked = told(references), told(hypotheses), {}
    for k, h in enumerate(heard):
        asked.setdefault(h, []).append(k)
    shared, alone = [ks for ks in asked.values() if len(ks) > 1], [ks[0] for ks in asked.values() if len(ks) == 1]
    # what is set against one hypothesis goes together, and so do pairs of their own
    found = [*((ks, align_all([known[k] for k in ks], list(heard[ks[0]]))) for ks in shared), (alone, align_pairs([known[k] for k in alone], [heard[k] for k in alone]))]
    rows = [()] * len(known)
    for ks, every in found:
        for k, one in zip(ks, every, strict=True):
            rows[k] = tuple(map([r[0] for r in one].count, STATUSES))
    return rows


def counts_of_errors(references: Sequence, hypotheses: Sequence) -> list[tuple]:
    return word_errors_all(*([() if x is None else x for x in s] for s in (references, hypotheses)))


def counted(pairs: DataFrame, names: Sequence[str], *count: Callable[[Sequence, Sequence], list[tuple]]) -> DataFrame:
    """pair_id and what is counted of each pair, all of it while the pair is at hand."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            every = zip(pdf["pair_id"], *(f(pdf["reference"], pdf["hypothesis"]) for f in count), strict=True)
            yield pd.DataFrame([(p, *(x for row in rows for x in row)) for p, *rows in every], columns=["pair_id", *names])

    kind = pairs.schema["pair_id"].dataType.simpleString()
    return pairs.select("pair_id", "reference", "hypothesis").mapInPandas(run, f"pair_id {kind}, {', '.join(f'{n} int' for n in names)}")


def with_measures(counts: DataFrame) -> DataFrame:
    weight = F.col("match") + 0.5 * F.col("near")
    n, m = F.col("match") + F.col("near") + F.col("mismatch") + F.col("missing"), F.col("match") + F.col("near") + F.col("mismatch") + F.col("extra")
    out = counts.withColumn("recall", F.coalesce(F.try_divide(weight, n), F.lit(0.0))).withColumn("precision", F.coalesce(F.try_divide(weight, m), F.lit(0.0)))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def with_rate(counts: DataFrame) -> DataFrame:
    errors = F.col("substitutions") + F.col("deletions") + F.col("insertions")
    return counts.withColumn("rate", F.when(F.col("words") > 0, errors / F.col("words")).when(errors == 0, 0.0).otherwise(float("inf")))


def alignments(pairs: DataFrame) -> DataFrame:
    """pair_id with counts by status and the measures made of them, for rows of (pair_id, reference, hypothesis) word arrays."""
    return with_measures(counted(pairs, STATUSES, counts_by_status))


def word_error_rates(pairs: DataFrame) -> DataFrame:
    """pair_id, words, substitutions, deletions, insertions, rate: infinite for a hypothesis without reference, 0 without either."""
    return with_rate(counted(pairs, ERRORS, counts_of_errors))


def compared(pairs: DataFrame) -> DataFrame:
    """What alignments and word_error_rates give, and reference_words and hypothesis_words, in one pass over the pairs."""
    sizes = lambda r, h: [(len(a), len(b)) for a, b in zip(r, h, strict=True)]
    return with_rate(with_measures(counted(pairs, (*STATUSES, *ERRORS, "reference_words", "hypothesis_words"), counts_by_status, counts_of_errors, sizes)))
