"""Long recordings as windows: cut at pauses, or overlapping where there are none; decoded window by window and reconciled.

Frames come one by one with their best token. A fold gathers them into windows, each is decoded by itself, and a second fold settles
words that the next window can't change. So a session of any length needs the state of a window, and gives what one pass over it would.
The same three steps run over tables and, chained, over streams.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.decode import WORD_START
from spanloom.operators.kernels import normal
from spanloom.streaming import folds
from spanloom.streaming import segments as S


@dataclass
class WindowConfig:
    """Seconds of the longest window, of what two windows share, of the end of a window that isn't settled yet, and the least before a cut at a pause."""

    longest: float = 30.0
    overlap: float = 8.0
    lookahead: float = 8.0
    least: float = 2.0


@dataclass
class Windows:
    """An open window: where it starts and has come to, its tokens, and whether any are new since the last window ended."""

    start: float = 0.0
    now: float = 0.0
    tokens: list = field(default_factory=list)
    new: bool = False


WINDOW = "window_start double, window_end double, tokens array<int>, final boolean"
ROOM = 1e-9


def window_step(s: Windows, frame: dict, c: WindowConfig) -> list[tuple]:
    """frame: seconds, token, pause (whether the recording may be cut after it). Gives the window that ends here, if one does."""
    s.now += frame["seconds"]
    s.tokens.append(int(frame["token"]))
    s.new = True
    return closed(s, bool(frame["pause"]), c)


def closed(s: Windows, pause: bool, c: WindowConfig) -> list[tuple]:
    """The window, if it ends with its last frame."""
    held = s.now - s.start
    if pause and held >= c.least - ROOM:
        return [ended(s, s.now, 0)]
    if held >= c.longest - ROOM:
        again = round(len(s.tokens) * c.overlap / held)
        return [ended(s, s.now - held * again / len(s.tokens), again)]
    return []


def windows_in(s: Windows, frames: dict[str, np.ndarray], c: WindowConfig) -> list[tuple]:
    """What window_step gives for a session's next frames, one after the other; only those that end a window are looked at."""
    now = np.cumsum(np.concatenate([[s.now], frames["seconds"].astype(np.float64)]))[1:]
    tokens, pauses = frames["token"].astype(np.int64).tolist(), frames["pause"].astype(bool)
    out, at = [], 0
    while at < len(now):
        held = now[at:] - s.start
        ends = (held >= c.longest - ROOM) | pauses[at:] & (held >= c.least - ROOM)
        end = at + int(ends.argmax()) if ends.any() else len(now) - 1
        s.tokens += tokens[at : end + 1]
        s.now, s.new = float(now[end]), True
        out += closed(s, bool(pauses[end]), c)
        at = end + 1
    return out


def ended(s: Windows, start: float, again: int) -> tuple:
    """The window as a row; the next one starts with as many of its tokens again. Without any the row is final."""
    out = round(s.start, 6), round(s.now, 6), s.tokens, not again
    s.start, s.tokens, s.new = start, s.tokens[len(s.tokens) - again :], False
    return out


def window_flush(s: Windows) -> list[tuple]:
    """The end of a recording settles what the last window left open, though nothing new may have come."""
    return [(round(s.start, 6), round(s.now, 6), s.tokens, True)] if s.tokens else []


def timed_words(tokens: list[int], start: float, end: float, pieces: dict[int, str], blank: int) -> list[tuple[str, float, float]]:
    """The words of a window's frames: runs of one token are one, blanks and marks in brackets are none, and a piece with the mark begins a word."""
    step = (end - start) / max(len(tokens), 1)
    runs = [i for i in range(len(tokens)) if i == 0 or tokens[i] != tokens[i - 1]]
    out: list[list] = []
    for first, last in zip(runs, [*runs[1:], len(tokens)], strict=True):
        piece = "" if tokens[first] == blank else pieces.get(tokens[first], "")
        if not piece or piece.startswith("<"):
            continue
        if piece.startswith(WORD_START) or not out:
            out.append(["", start + first * step, 0.0])
        out[-1][0] += piece.replace(WORD_START, "")
        out[-1][2] = start + last * step
    return [(normal(w), a, b) for w, a, b in out if normal(w)]


def decoded(windows: DataFrame, pieces: dict[int, str], blank: int, session: str = "session") -> DataFrame:
    """windows with their words, as JSON of (word, start, end)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            words = [json.dumps(timed_words(list(t), a, b, pieces, blank)) for t, a, b in zip(pdf["tokens"], pdf["window_start"], pdf["window_end"], strict=True)]
            yield pdf[[session, "window_start", "window_end", "final"]].assign(words=words)

    kind = windows.schema[session].dataType.simpleString()
    return windows.select(session, "window_start", "window_end", "tokens", "final").mapInPandas(run, f"{session} {kind}, window_start double, window_end double, final boolean, words string")


def transcribed(frames: DataFrame, pieces: dict[int, str], blank: int, c: WindowConfig | None = None, session: str = "session", order: str = "n") -> DataFrame:
    """session, word, start, end of the frames (session, n, seconds, token, pause) of a table."""
    c = c or WindowConfig()
    windows = folds.run_arrays(frames, session, order, Windows, lambda s, x: windows_in(s, x, c), WINDOW, window_flush)
    return folds.run_batch(decoded(windows, pieces, blank, session), session, "window_end", S.Reconciler, lambda s, x: S.reconcile_step(s, x | {"words": json.loads(x["words"])}, c.lookahead), S.TIMED)


def transcribed_stream(frames: DataFrame, pieces: dict[int, str], blank: int, ends: str, c: WindowConfig | None = None, session: str = "session", order: str = "n") -> DataFrame:
    """The same over a stream, as two stateful steps one after the other; a frame whose column ends is true is its session's last."""
    c = c or WindowConfig()
    windows = folds.run_stream(frames, session, order, Windows, lambda s, x: window_step(s, x, c), WINDOW, window_flush, ends)
    return folds.run_stream(decoded(windows, pieces, blank, session), session, "window_end", S.Reconciler, lambda s, x: S.reconcile_step(s, x | {"words": json.loads(x["words"])}, c.lookahead), S.TIMED)


@dataclass
class Replay:
    """What a replayed recording came to: refs seen, stable and covered, and the stitched words, of which a segment's longest decoding waits."""

    seen: list = field(default_factory=list)
    stable: list = field(default_factory=list)
    covered: dict = field(default_factory=dict)
    events: int = 0
    waiting: str = ""
    tail: list = field(default_factory=list)
    count: int = 0
    words: list = field(default_factory=list)


REPLAYED = "seen string, stable string, covered string, words string, events int"


def replay_step(s: Replay, event: dict, longest: float = 15.0) -> list[tuple]:
    """event: ref, stable, text (decoded), seconds (of the window), advanced. A segment ends where the window moves on or is full."""
    from spanloom.streaming.live import verses_of

    s.events += 1
    ref = event["ref"]
    for kept in [s.seen, s.stable][: 1 + bool(event["stable"])] if ref else ():
        if kept[-1:] != [ref]:
            kept.append(ref)
    if event["stable"]:
        s.covered |= {v: None for v in (verses_of(ref) if ref else ()) if v not in s.covered}
        s.waiting = max(s.waiting, event["text"] or "", key=lambda t: len(t.split())) if len((event["text"] or "").split()) != len(s.waiting.split()) else event["text"] or ""
    if event["advanced"] > 0 or event["seconds"] >= longest - 0.05:
        settle(s)
    return []


def settle(s: Replay) -> None:
    if s.waiting:
        stitcher = S.Stitcher(s.tail, s.count)
        s.words += [w for added, _ in S.stitch_step(stitcher, {"text": s.waiting}) for w in added.split()]
        s.tail, s.count, s.waiting = stitcher.tail, stitcher.count, ""


def replay_flush(s: Replay) -> list[tuple]:
    settle(s)
    return [(",".join(s.seen), ",".join(s.stable), ",".join(s.covered), " ".join(s.words), s.events)] if s.events else []


def pauses_of(frames: DataFrame, pauses: DataFrame, seconds: float, session: str = "session", order: str = "n") -> DataFrame:
    """frames with pause: whether it is the frame in the middle of a pause (session, middle, in seconds)."""
    middle = pauses.select(session, F.floor(F.col("middle") / seconds).cast("long").alias(order), F.lit(True).alias("pause")).distinct()
    return frames.join(middle, [session, order], "left").withColumn("pause", F.coalesce("pause", F.lit(False)))
