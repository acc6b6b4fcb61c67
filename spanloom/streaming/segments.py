"""Steps over streams of sound levels and texts: utterances, stitched texts, timed words, cuts, tracked refs.

A state is a small dataclass of plain values; a step takes it and one chunk and gives the rows that the chunk settles.
``folds`` runs them over tables and streams.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from dataclasses import dataclass, field
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.kernels import normal


@dataclass
class SegmenterConfig:
    """Seconds of silence that end an utterance, its least and greatest length, what the next one repeats; levels of quiet and speech."""

    silence: float = 1.2
    least: float = 0.8
    most: float = 30.0
    overlap: float = 1.0
    quiet_factor: float = 2.0
    speech_factor: float = 3.0
    least_rms: float = 0.008
    rise: float = 1.02


@dataclass
class Segmenter:
    """An open utterance: where it starts and has come to, how long it has been still, its loudest peak; and the room's level."""

    start: float = 0.0
    now: float = 0.0
    silent: float = 0.0
    baseline: float = -1.0
    peak: float = 0.0


SEGMENT = "start double, end double, reason string, has_speech boolean"
#: What ends an utterance of an age after a silence, tried in this order.
ENDINGS = {
    "silence": lambda age, still, c: still >= c.silence and age >= c.least,
    "maxDuration": lambda age, still, c: age >= c.most,
}


def room_level(before: float, rms: float, c: SegmenterConfig) -> float:
    """The level follows down at once and rises slowly."""
    return min(rms, c.least_rms if before < 0 else before * c.rise)


def segment_step(s: Segmenter, chunk: dict, c: SegmenterConfig) -> list[tuple]:
    """chunk: seconds, rms, peak. Gives the utterance that the chunk closes, if any."""
    length = chunk["seconds"]
    if length <= 0:
        return []
    s.baseline = room_level(s.baseline, chunk["rms"], c)
    still = chunk["rms"] < max(c.least_rms, s.baseline * c.quiet_factor)
    s.now, s.peak, s.silent = s.now + length, max(s.peak, chunk["peak"]), (s.silent + length) * still
    reasons = [r for r, ends in ENDINGS.items() if ends(s.now - s.start, s.silent, c)]
    return [cut_off(s, reasons[0], c)] if reasons else []


def cut_off(s: Segmenter, reason: str, c: SegmenterConfig) -> tuple:
    """The utterance as a row; the next one begins at its end, or within it if it was cut for its length."""
    row = (round(s.start, 6), round(s.now, 6), reason, s.peak >= max(c.least_rms, s.baseline) * c.speech_factor)
    repeated = min(s.now - s.start, c.overlap) if reason == "maxDuration" else 0.0
    s.start, s.silent, s.peak = s.now - repeated, 0.0, 0.0
    return row


def segment_flush(s: Segmenter, c: SegmenterConfig) -> list[tuple]:
    """The end of a session: what is left, unless it is shorter than half an utterance."""
    return [cut_off(s, "stopped", c)] if s.now - s.start >= max(c.least / 2, 1e-12) else []


@dataclass
class Previews:
    """An open utterance with the last preview and the last boundary, in seconds of the session."""

    segmenter: Segmenter = field(default_factory=Segmenter)
    last: float = 0.0
    boundary: float = 0.0

    def __post_init__(self) -> None:
        if isinstance(self.segmenter, dict):  # as it comes out of a state store
            self.segmenter = Segmenter(**self.segmenter)


PREVIEW = "start double, end double"
#: Seconds between previews, and the most that one looks back.
BETWEEN, BACK = 1.0, 12.0


def preview_step(s: Previews, chunk: dict, c: SegmenterConfig, slack: float = 1e-9) -> list[tuple]:
    """The stretch that a preview is due for after a chunk: the open utterance's last seconds, not sooner than a while after the last preview, its boundary and its own start."""
    if segment_step(s.segmenter, chunk, c):
        s.boundary = s.segmenter.now
    now = s.segmenter.now
    if min(now - s.last, now - s.boundary, now - s.segmenter.start) < BETWEEN - slack:
        return []
    s.last = now
    return [(round(max(s.segmenter.start, now - BACK), 6), round(now, 6))]


@dataclass
class Stitcher:
    """Words of overlapping texts; only the last ones, that an overlap may reach, are kept in state."""

    tail: list = field(default_factory=list)
    count: int = 0


STITCHED = "added string, count int"


def stitch_step(s: Stitcher, chunk: dict, most: int = 80, least: int = 2) -> list[tuple]:
    new = (chunk["text"] or "").split()
    flat = [normal(w) for w in new]
    k = next((k for k in range(min(len(new), most, len(s.tail)), 0, -1) if (k >= least or k == len(flat)) and s.tail[-k:] == flat[:k]), 0)
    s.tail = (s.tail + flat[k:])[-most:]
    s.count += len(new) - k
    return [(" ".join(new[k:]), s.count)] if new[k:] else []


@dataclass
class Reconciler:
    """Timed words, as intervals (word, start, end): those before the boundary are told for good, the pending ones may still be heard otherwise."""

    pending: list = field(default_factory=list)
    boundary: float | None = None


TIMED = "word string, start double, end double"


def beyond(interval: tuple, boundary: float | None, slack: float) -> bool:
    """Whether an interval reaches past the boundary, and begins about there or has its middle there."""
    if boundary is None:
        return True
    _, start, end = interval
    reaches, begins, lies = end > boundary + slack, start >= boundary - slack, (start + end) / 2 > boundary
    return reaches and (begins or lies)


def reconcile_step(s: Reconciler, chunk: dict, lookahead: float = 2.0, slack: float = 0.12) -> list[tuple]:
    """chunk: words (word, start, end), window_start, window_end, final. Gives newly told words.

    What the window covers replaces what was pending there. Words that end a lookahead before the window does are settled, but for
    the last one, which may be cut; a final window settles all.
    """
    before = [tuple(w) for w in s.pending if w[2] < chunk["window_start"]]
    waiting = before + [tuple(w) for w in chunk["words"] if beyond(w, s.boundary, slack)]
    ends = list(accumulate((w[2] for w in waiting), max))
    settled = len(waiting) if chunk["final"] else min(bisect_right(ends, chunk["window_end"] - lookahead), max(len(waiting) - 1, 0))
    told, s.pending = waiting[:settled], waiting[settled:]
    s.boundary = told[-1][2] if told else s.boundary
    return told


@dataclass
class Tracker:
    """Follows recognised refs: commits one that repeats or leads clearly, and drops it when it goes stale."""

    committed: str = ""
    leader: str = ""
    repeats: int = 0
    stale: int = 0


TRACKED = "kind string, ref string, score double"


def tracker_step(s: Tracker, chunk: dict, first: float = 0.75, later: float = 0.45, clear: float = 0.12, near: float = 0.06, rounds: int = 2, patience: int = 4) -> list[tuple]:
    """chunk: ref, score, margin, next (whether ref follows the committed one). Gives candidate, commit and rollback events."""
    ref, score = chunk["ref"], chunk["score"]
    if not ref:
        s.leader, s.repeats = "", 0
        s.stale += 1
        if s.committed and s.stale >= patience:
            gone, s.committed, s.stale = s.committed, "", 0
            return [("rollback", gone, 0.0)]
        return []
    s.repeats = s.repeats + 1 if ref == s.leader else 1
    s.leader = ref
    follows = bool(chunk["next"]) and bool(s.committed)
    sure = chunk["margin"] >= (near if follows else clear)
    enough = score >= (later if s.committed else first)
    blocked = bool(s.committed) and not follows and ref != s.committed and s.repeats < rounds
    if ref != s.committed and enough and not blocked and (sure or s.repeats >= rounds):
        s.committed, s.stale = ref, 0
        return [("verse_match", ref, float(score))]
    s.stale = 0 if ref == s.committed else s.stale
    return [("verse_candidate", ref, float(score))]


def levels(events: DataFrame) -> DataFrame:
    """session, n, seconds, rms, peak: events as sound levels, half a second each."""
    level = F.abs(F.col("value")) / 1000
    return events.select(F.col("user_id").alias("session"), F.col("event_id").alias("n"), F.lit(0.5).alias("seconds"), F.round(level * F.when(F.col("event_id") % 7 < 4, 0.01).otherwise(1.0), 9).alias("rms"), F.round(level * 4, 9).alias("peak"))


@dataclass
class Cutter:
    """Cuts a recording at its pauses, not closer than a gap, nor near the end."""

    last: float = 0.0


CUT = "start double, end double"


def cut_step(s: Cutter, chunk: dict, gap: float = 2.0, tail: float = 1.0) -> list[tuple]:
    """chunk: middle of a pause, total length; a last row with middle null closes the recording."""
    middle, total = chunk["middle"], chunk["total"]
    if middle is None or math.isnan(middle):
        return [(s.last, total)] if total > s.last else []
    if middle - s.last >= gap and total - middle >= tail:
        out, s.last = (s.last, middle), middle
        return [out]
    return []


@dataclass
class Follower:
    """The level of the background: no louder than the quietest chunk lately."""

    base: float | None = None


FOLLOWED = "event_id long, baseline double"


def follow_step(s: Follower, chunk: dict, start: float = 0.008, rise: float = 1.02) -> list[tuple]:
    """chunk: event_id, rms. A chunk without a level leaves the rise alone."""
    most = start if s.base is None else s.base * rise
    s.base = most if chunk["rms"] is None or math.isnan(chunk["rms"]) else min(float(chunk["rms"]), most)
    return [(chunk["event_id"], s.base)]
