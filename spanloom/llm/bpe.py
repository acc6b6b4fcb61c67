"""Byte-level BPE as a streaming transducer with a bounded lookahead.

Merging may still change a token while more text can come, but only so far back: a merge that
uses text beyond the end takes a token from a merge of higher rank, which frees the token before,
and so on to the left with ever higher ranks. ``lookahead`` adds up the longest such chain of the
merge list. Tokens that end further than that from the end of what was read are final, so the
encoder emits them and forgets their bytes; so is all of a pre-token once it has ended, since no merge
reaches over its end. The decoder is the reverse machine: token bytes go
through an incremental UTF-8 decoder that holds at most an unfinished character.

Null and empty texts have no tokens. Text is never cut: a run of a million letters passes through
a window of a few kilobytes.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from spanloom.llm.common import by_text, spread

#: The published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RUNS = {"L": r"\p{L}*", "N": r"\p{N}*", "O": r"[^\s\p{L}\p{N}]*", "S": r"\s*"}
#: An incomplete contraction or special token may end a buffer.
HOLD = 16
#: Characters of a buffer without a certain boundary after which a pre-token is handled as an open run.
OPEN = 4096
CACHE = 500_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next letter from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that settle it, whatever follows them."""
    parts = {a + b: (a, b) for a, b in reversed(merges)}
    chain: dict[bytes, int] = defaultdict(int)  # by token: the longest chain of later merges that its absence can set off
    most = 0
    for a, b in reversed(merges):
        length = len(a) + chain[a]
        most = max(most, length)
        while True:
            chain[b] = max(chain[b], length)
            if b not in parts:
                break
            b = parts[b][0]
    return most + max((len(a + b) for a, b in merges), default=1)


@lru_cache(maxsize=1)
def newer_letters() -> frozenset[str]:
    """Letters and numbers that the regex module knows but the tokenizers' older Unicode tables don't."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")


@lru_cache(maxsize=1)
def latin_pattern() -> re.Pattern[str]:
    """The same pattern for texts within Latin-1, with its classes spelt out; twice as fast."""
    of = lambda p: "".join(re.escape(chr(c)) for c in range(256) if regex.match(p, chr(c)))
    letters, numbers, spaces = of(r"\p{L}"), of(r"\p{N}"), of(r"\s")
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


class Model:
    """A tokenizer file's vocabulary, merges and special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.merges = [(raw(a), raw(b)) for a, b in merges]
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.ranks = {m: r for r, m in reversed(list(enumerate(self.merges)))}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.pairs = {self.ids[a] << 17 | self.ids[b]: (r, self.ids[a + b]) for (a, b), r in self.ranks.items()}
        self.sizes = {i: len(t) for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = {str(i): t for t, i in self.ids.items()} | {str(i): s.encode() for s, i in self.special.items()}
        self.lookahead = sufficient_lookahead(self.merges)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.runs = {k: regex.compile(p) for k, p in RUNS.items()}
        self.known = Known(self)

    def tokens(self, data: bytes) -> list[int]:
        """The tokens of a window, in whose merging nothing from outside takes part."""
        return self._short(data) if len(data) <= 64 else [self.ids[t] for t in self._heap(data)]

    def _short(self, data: bytes) -> list[bytes]:
        pairs, never = self.pairs.get, (1 << 60, 0)
        word = [self.single[b] for b in data]
        found = [pairs(a << 17 | b, never) for a, b in zip(word, word[1:], strict=False)]
        while found and (best := min(found)) is not never:
            i = found.index(best)
            word[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = pairs(word[i - 1] << 17 | word[i], never)
            if i < len(found):
                found[i] = pairs(word[i] << 17 | word[i + 1], never)
        return word

    def _heap(self, data: bytes) -> list[bytes]:
        n, ranks = len(data), self.ranks
        word: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i in range(n - 1) if (p := (word[i], word[i + 1])) in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j >= n or word[i] is None or (word[i], word[j]) != pair:
                continue
            word[i], word[j], after[i] = pair[0] + pair[1], None, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (p := (word[i], word[after[j]])) in ranks:
                    heapq.heappush(heap, (ranks[p], i, p))
            if before[i] >= 0 and (p := (word[before[i]], word[i])) in ranks:
                heapq.heappush(heap, (ranks[p], before[i], p))
        return [w for w in word if w is not None]

    def settled(self, tail: bytes, out: list[str], final: bool) -> bytes:
        """Emits the tokens at the start of a pre-token that nothing can change any more; gives the rest.

        Every pre-token comes through here. Once it has ended, what ends the window settles it; before that, and in windows
        that don't reach its end, only tokens that lie a lookahead before the window's end are settled.
        """
        ids, ahead = self.ids, self.lookahead
        while len(tail) > 4 * ahead or final and tail:
            window = tail[: 8 * ahead]
            last, done = final and len(window) == len(tail), 0
            for i in self.tokens(window):
                if not last and done + self.sizes[i] > len(window) - ahead:
                    break
                out.append(str(i))
                done += self.sizes[i]
            tail = tail[done:]
        return tail


class Known(dict):
    """Ids of the pre-tokens seen so far, joined by commas; emptied when it is full, and never holds long ones."""

    def __init__(self, m: Model):
        super().__init__()
        self.m = m

    def __missing__(self, text: str) -> str:
        out: list[str] = []
        data = text.encode()
        self.m.settled(data, out, True)
        found = ",".join(out)
        if len(data) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[text] = found
        return found


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Encoder:
    """feed() takes pieces of a text and gives ids that are final, joined by commas; finish() gives the rest."""

    def __init__(self, m: Model):
        self.m, self.buffer = m, ""
        self.run, self.tail, self.held = "", b"", ""  # an open pre-token: its class, its bytes that may change, its last space

    def feed(self, piece: str) -> str:
        return self._advance(self.buffer + piece, final=False)

    def finish(self) -> str:
        return self._advance(self.buffer, final=True)

    def _advance(self, text: str, final: bool) -> str:
        out: list[str] = []
        while text or (final and self.run):
            if self.run:
                text = self._continue(text, final, out)
                if self.run:
                    break
                continue
            cut = len(text) if final else self._boundary(text)
            if cut:
                self._whole(text[:cut], out)
                text = text[cut:]
            elif len(text) < OPEN:
                break
            else:
                text = self._first(text, out)
        self.buffer = text
        return ",".join(out)

    def _boundary(self, text: str) -> int:
        """Before the last white space that follows something else; no pre-token or special token spans it."""
        for m in self.m_spaces(text):
            return m.start()
        return 0

    #: Backwards from the end.
    m_spaces = staticmethod(regex.compile(r"(?r)(?<=\S)\s").finditer)

    def _words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            return latin_pattern().findall(text)
        except UnicodeEncodeError:
            pass
        if regex.search(r"[^\u0000-՗]", text) and not newer_letters().isdisjoint(text):
            plain = text.translate({ord(c): "\U000e0080" for c in newer_letters()})  # an unassigned stand-in of the same length
            return [text[slice(*m.span())] for m in self.m.pattern.finditer(plain)]
        return self.m.pattern.findall(text)

    def _whole(self, text: str, out: list[str]) -> None:
        for part in self.m.split.split(text) if self.m.split else [text]:
            if part in self.m.special:
                out.append(str(self.m.special[part]))
            elif part:
                out.append(",".join(map(self.m.known.__getitem__, self._words(part))))

    def _first(self, text: str, out: list[str]) -> str:
        """Emits the first pre-token of a long text without boundaries, or opens it as a run."""
        sure = len(text) - HOLD
        if self.m.split and (m := self.m.split.search(text)):
            self._whole(text[: m.end()], out)
            return text[m.end() :]
        words, at = self._words(text), 0
        for k, w in enumerate(words):
            if at + len(w) > sure:
                break
            at += len(w)
        if at:
            out.extend(map(self.m.known.__getitem__, words[:k]))
            return text[at:]
        w = words[0]
        body = w[1:] if w[0] == " " and w[1:].strip() else w
        c = body[0]
        self.run = "S" if c.isspace() and regex.match(r"\s", c) else "O" if c in newer_letters() else "L" if regex.match(r"\p{L}", c) else "N" if regex.match(r"\p{N}", c) else "O"
        self.tail, self.held = (w[: len(w) - len(body)]).encode(), ""
        return text[len(w) - len(body) :]

    def _continue(self, text: str, final: bool, out: list[str]) -> str:
        rest = text
        if self.run == "S":
            m = self.m.runs["S"].match(text)
            spaces, rest = self.held + m[0], text[m.end() :]
            ended = final and not rest
            self.tail += (spaces if ended else spaces[:-1]).encode()
            self.held = "" if ended else spaces[-1:]
            if rest or final:
                self._settle(out, True)
                self.run, rest, self.held = "", self.held + rest, ""
            else:
                self._settle(out, False)
            return rest
        plain = text.translate({ord(c): "\U000e0080" for c in newer_letters()}) if regex.search(r"[^\u0000-՗]", text) else text
        end = self.m.runs[self.run].match(plain).end()
        if self.m.split and (m := self.m.split.search(text)):
            end = min(end, m.start())
        closed = final or end < len(text)
        if not closed:
            end = max(0, end - HOLD)  # a special token may begin there
        elif not final and end > len(text) - HOLD and self.run == "O":
            closed, end = False, max(0, end - HOLD)
        self.tail += text[:end].encode()
        self._settle(out, closed)
        if closed:
            self.run = ""
        return text[end:]

    def _settle(self, out: list[str], final: bool) -> None:
        self.tail = self.m.settled(self.tail, out, final)


class Decoder:
    """feed() takes ids joined by commas and gives the text that is certain; finish() gives the rest."""

    def __init__(self, m: Model):
        self.bytes, self.state = m.bytes, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: str) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids.split(",")))) if ids else ""

    def finish(self) -> str:
        return self.state.decode(b"", True)


def encoded(text: str, m: Model, piece: int = 1 << 16) -> Iterator[str]:
    """Ids of a text, some at a time."""
    e = Encoder(m)
    for i in range(0, len(text), piece):
        if ids := e.feed(text[i : i + piece]):
            yield ids
    if ids := e.finish():
        yield ids


def encode(text: str | None, path: str | None = None) -> list[int]:
    return [int(i) for ids in encoded(text or "", model(path or vocabulary_path())) for i in ids.split(",")]


def decode(ids: list[int], path: str | None = None) -> str:
    d = Decoder(model(path or vocabulary_path()))
    return d.feed(",".join(map(str, ids))) + d.finish()


def digests(text: str | None, m: Model) -> tuple[int, str, str]:
    """Number of tokens, SHA-256 of the ids, SHA-256 of the decoded text."""
    n, of_ids, of_text, back = 0, hashlib.sha256(), hashlib.sha256(), Decoder(m)
    for ids in encoded(text or "", m):
        of_ids.update((b"," if n else b"") + ids.encode())
        n += ids.count(",") + 1
        of_text.update(back.feed(ids).encode())
    of_text.update(back.finish().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, token_ids: every text's ids as an array."""
    path = path or vocabulary_path()
    types = [("n_tokens", pa.int64()), ("token_ids", pa.list_(pa.int32()))]
    kernel = lambda t: (len(ids := encode(t, path)), ids)
    return spread(docs.select(key, text)).mapInArrow(by_text(kernel, key, text, types), f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, token_ids array<int>")


def token_digests(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256; texts are encoded and decoded in full, one piece at a time."""
    path = path or vocabulary_path()
    types = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    kernel = lambda t: digests(t, model(path))
    return spread(docs.select(key, text)).mapInArrow(by_text(kernel, key, text, types), f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
