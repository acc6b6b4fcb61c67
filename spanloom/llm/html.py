"""Main text of web pages, by a tree-structured graphical model.

Every block element of a page is a node that is content or not. Its own evidence (tag, its parent's tag,
words of its class and id, how much text it holds and how much of that are links) and parent-child
potentials give a distribution over all nodes together; messages up and down the tree (sum-product) give
each node's exact marginal. Weights and potentials are trained by gradient ascent on the likelihood of
labelled pages, which ``labelled_pages`` lays out: articles, menus, headers, footers, sidebars, notices,
adverts, forms and comments under many tags and names. Text whose node is content with
probability one half or more is kept.

Inline elements belong to their block. Scripts, styles and other elements without text of their own are
skipped unread; character references are decoded; white space in a block is one space; blocks that are
not empty are joined by a line break, in page order. Null and empty pages have an empty text. Broken markup is
read as browsers do where that matters: unclosed elements end with their parent, a new paragraph or item
ends the last one, stray end tags are ignored. Repeated rows give repeated results.
"""

from __future__ import annotations

import html as references
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from spanloom.llm.common import spread

TOKEN = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"<]*"|'[^'<]*')*|[^>]*)>|<!--.*?(?:--!?>|\Z)|<[!?/][^>]*>?""", re.S)
REST = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?/][^>]*>?", re.S)
NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Elements whose content isn't page text.
SKIPPED = frozenset("script style noscript template iframe object svg math textarea select title noembed noframes xmp audio video canvas".split())
ENDING = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in SKIPPED}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What a start tag ends, and what keeps it from reaching further up.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "thead": ({"tr", "td", "th"}, {"table"}), "tbody": ({"thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"})}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("html body table td th caption button".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Page:
    """Nodes in page order, each after its parent, and pieces of text with their node and block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.names = ["#page"], [-1], [""]
        self.text: list[tuple[int, int, str]] = []
        self.chars, self.linked = [0], [0]
        #: Open elements, and for each tag the places in that stack where it is open: what a tag ends is found without a search.
        self.stack, self.open = [0], defaultdict(list)
        self._read(source)

    def _read(self, source: str) -> None:
        at, block, links, n = 0, 0, 0, len(source)
        tags, stack = self.tags, self.stack
        closed = source.rfind(">")  # no tag ends after this, so none is looked for
        while at < n:
            m = (TOKEN if at <= closed else REST).search(source, at)
            start = m.start() if m else n
            if start > at:
                self._add(stack[-1], block, source[at:start], links)
            if not m:
                break
            at = m.end()
            name = m[2] if m.re is TOKEN else None
            if name is None:
                continue
            name, closing = name.lower(), m[1]
            if name in SKIPPED:
                if not closing and not m[3].endswith("/"):
                    end = ENDING[name].search(source, at)
                    at = end.end() if end else n
                continue
            if name in INLINE:
                if name == "a":
                    links = 0 if closing else 1
                elif name == "br":
                    self._add(stack[-1], block, " ", 0)
                continue
            block += 1
            if closing:
                k = self._last(HEADINGS if name in HEADINGS else (name,))
                if k and (name in SCOPE or k >= self._last(SCOPE)):
                    self._cut(k)
                    links = 0
                continue
            if name in VOID:
                continue
            if name in CLOSES_P:
                self._close(("p",), SCOPE)
            if name in HEADINGS and tags[stack[-1]] in HEADINGS:
                self._cut(len(stack) - 1)
            if name in ENDS:
                self._close(*ENDS[name])
            names = m[3]
            self.open[name].append(len(stack))
            self.parents.append(stack[-1])
            stack.append(len(tags))
            tags.append(name)
            self.names.append(" ".join(x.strip("\"'") for x in NAMED.findall(names)) if names and ("=" in names) else "")
            self.chars.append(0)
            self.linked.append(0)

    def _last(self, tags) -> int:
        """The innermost place in the stack of open elements of one of these tags, 0 without one."""
        return max([self.open[t][-1] for t in tags if self.open.get(t)], default=0)

    def _cut(self, k: int) -> None:
        """Ends the open elements from a place on."""
        for node in self.stack[k:]:
            self.open[self.tags[node]].pop()
        del self.stack[k:]

    def _close(self, ended, fence) -> None:
        while (k := self._last(ended)) > self._last(fence):
            self._cut(k)
            if self.tags[self.stack[-1]] not in ended:
                return

    def _add(self, node: int, block: int, text: str, links: int) -> None:
        self.text.append((node, block, text))
        n = len(text) if not text.isspace() else 0
        self.chars[node] += n
        if links:
            self.linked[node] += n

    def keys(self) -> list[tuple]:
        """What each node's own evidence depends on."""
        tags, n = self.tags, len(self.tags)
        below, linked = self.chars[:], self.linked[:]
        for i in range(n - 1, 0, -1):
            below[self.parents[i]] += below[i]
            linked[self.parents[i]] += linked[i]
        out = [("#page", "", "", 0, 0, 0)]
        for i in range(1, n):
            share = linked[i] / below[i] if below[i] else -1
            size, own = below[i], self.chars[i]
            out.append((tags[i], tags[self.parents[i]], self.names[i], -1 if share < 0 else 0 if share < 0.25 else 1 if share < 0.6 else 2, 0 if size == 0 else 1 if size < 30 else 2 if size < 120 else 3 if size < 500 else 4, 0 if own == 0 else 1 if own < 30 else 2 if own < 120 else 3))
        return out


def evidence(key: tuple) -> list[str]:
    tag, parent, names, links, size, own = key
    words = sorted({w.lower() for w in WORDS.findall(names)})
    # a word that names a part also tells in compounds
    return ["bias", f"tag {tag}", f"in {parent} {tag}", f"links {links}", f"size {size}", f"own {own}", f"own {own} links {links}", *(f"word {w}" for w in words)]


class Model:
    """Weights of the evidence, and potentials of (parent, child) in logarithms."""

    def __init__(self, weights: dict[str, float], pair: list[float]):
        self.weights, self.pair = weights, pair
        self.known: dict[tuple, float] = {}

    def own(self, key: tuple) -> float:
        if (v := self.known.get(key)) is None:
            v = sum(self.weights.get(f, 0.0) for f in evidence(key))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[key] = v
        return v

    def marginals(self, keys: list[tuple], parents: list[int]) -> tuple[list[float], list[float]]:
        """Log-odds of each node being content: exact, by messages to the root and back. Also the messages upwards."""
        p00, p01, p10, p11 = map(math.exp, self.pair)
        n, log, exp = len(keys), math.log, math.exp
        odds = [max(-30.0, min(30.0, self.own(k))) for k in keys]
        up = [0.0] * n
        for i in range(n - 1, 0, -1):
            e = exp(max(-60.0, min(60.0, odds[i])))
            up[i] = log((p10 + p11 * e) / (p00 + p01 * e))
            odds[parents[i]] += up[i]
        for i in range(1, n):
            e = exp(max(-60.0, min(60.0, odds[parents[i]] - up[i])))
            odds[i] += log((p01 + p11 * e) / (p00 + p10 * e))
        return odds, up


#: Names and tags under which parts of pages come. Fixed values of the training layouts.
PARTS = {
    "nav": ("nav", "div nav", "div menu", "ul menu", "div navbar", "div main-nav", "div navigation", "div breadcrumbs", "div topbar", "ul nav-list", "div site-nav", "nav breadcrumb", "div pagination", "div tags", "div toc"),
    "header": ("header", "div header", "header site-header", "div masthead", "div branding", "div logo", "header page-header", "div site-header"),
    "footer": ("footer", "div footer", "footer site-footer", "div copyright", "div bottom", "div page-footer", "div legal"),
    "side": ("aside", "div sidebar", "aside sidebar", "div widget", "div related", "div rail", "section related-posts", "div recommended", "div trending", "div side", "aside widget", "div more-stories", "div author-box", "div bio"),
    "ad": ("div ad", "div ads", "div advert", "div advertisement", "div sponsored", "div promo", "div banner", "aside ad", "div ad-slot", "section sponsor", "div ad-container", "ins adsbygoogle", "div outbrain"),
    "notice": ("div cookie-banner", "div cookie", "div notice", "div consent", "div alert", "div popup", "div modal", "div newsletter", "div subscribe", "section paywall", "div gdpr", "dialog", "div cookie-notice", "div disclaimer", "div warning"),
    "form": ("form", "form search", "div login", "form subscribe-form", "div search", "form contact", "fieldset", "div signup", "button"),
    "comments": ("div comments", "section comments", "div comment-list", "ol commentlist", "div disqus_thread", "section discussion", "ul comments-list", "div replies", "div reader-comments", "div responses", "div user-comments"),
    "share": ("div share", "div social", "ul share-buttons", "div sharing", "div social-links"),
}
WRAPPERS = ("article", "main", "div content", "div article-body", "article post", "div entry-content", "section", "div main-content", "div story", "main content", "div post-body", "div container", "div text", "div", "div page", "div body", "td")
OUTER = ("div wrapper", "div container", "main", "div", "div page", "div layout", "div row", "section", "div site", "div inner", "div col")


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """Pages whose content elements have the attribute data-content."""
    rng = random.Random(seed)

    def words(k: int) -> str:
        return " ".join("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(2, 9))) for _ in range(k))

    def element(spec: str, inside: str, content: bool = False) -> str:
        tag, _, name = spec.partition(" ")
        attribute = f' {rng.choice(("class", "class", "id"))}="{name}"' if name else ""
        return f"<{tag}{' data-content' if content else ''}{attribute}>{inside}</{tag}>"

    def links(k: int) -> str:
        return "".join(f'<a href="#">{words(rng.randint(1, 4))}</a> ' for _ in range(k))

    def boilerplate(kind: str) -> str:
        spec = rng.choice(PARTS[kind])
        if kind in ("nav", "share") or spec.startswith("ul"):
            inner = "".join(f'<li><a href="#">{words(rng.randint(1, 3))}</a></li>' for _ in range(rng.randint(1, 8)))
            return element(spec, inner if spec.startswith("ul") else f"<ul>{inner}</ul>" if rng.random() < 0.7 else links(rng.randint(2, 8)))
        if kind == "comments":
            item, plain = rng.choice(("div comment", "li comment", "div", "article comment", "li", "div reply")), rng.random() < 0.5
            one = lambda: element(item, (element(rng.choice(("span author", "h4", "div meta")), words(2)) if rng.random() < 0.6 else "") + (words(rng.randint(4, 50)) if plain else f"<p>{words(rng.randint(4, 50))}</p>"))
            return element(spec, (f"<h3>{words(2)}</h3>" if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 5))))
        if kind == "form":
            return element(spec, rng.choice(("", f"<label>{words(2)}</label>")) + f'<input type="text"> <p>{words(rng.randint(1, 15))}</p><button>{words(1)}</button>')
        if kind == "side":
            return element(spec, f"<h3>{words(2)}</h3>" + rng.choice((f"<ul>{''.join(f'<li>{links(1)}</li>' for _ in range(4))}</ul>", f"<p>{words(rng.randint(5, 40))}</p>", words(rng.randint(3, 20)), links(5))))
        body = words(rng.randint(2, 30)) + (links(rng.randint(1, 4)) if rng.random() < 0.4 else "")
        return element(spec, rng.choice((body, f"<p>{body}</p>", f"<div>{body}</div>", f"<span>{body}</span>")))

    def content() -> str:
        parts = []
        for _ in range(rng.choice((1, 2, 3, 4, 6, 8))):
            kind = rng.random()
            if kind < 0.68:
                parts.append(f"<p data-content>{words(rng.choice((1, 2, 4, 10, 30, 60, 120)))}{links(1) if rng.random() < 0.2 else ''} {words(3)}</p>")
            elif kind < 0.76:
                parts.append(f"<{(h := rng.choice(('h2', 'h3')))} data-content>{words(rng.randint(1, 6))}</{h}>")
            elif kind < 0.84:
                parts.append(f"<ul data-content>{''.join(f'<li data-content>{words(rng.randint(2, 20))}</li>' for _ in range(rng.randint(2, 5)))}</ul>")
            elif kind < 0.89:
                parts.append(f"<blockquote data-content>{rng.choice((words(20), f'<p data-content>{words(20)}</p>'))}</blockquote>")
            elif kind < 0.93:
                parts.append(f"<table data-content><tr data-content>{''.join(f'<td data-content>{words(3)}</td>' for _ in range(3))}</tr></table>")
            elif kind < 0.96:
                parts.append(f"<pre data-content>{words(12)}</pre>")
            else:
                parts.append(f"<div data-content>{words(rng.randint(10, 80))}</div>")
        return "".join(parts)

    def page() -> str:
        title = f"<h1 data-content>{words(rng.randint(2, 9))}</h1>"
        if rng.random() < 0.25:
            title = f'<header data-content>{title}{f"<p data-content>{words(12)}</p>" if rng.random() < 0.4 else ""}</header>'
        inner = title + content()
        for kind in ("ad", "share", "side", "notice", "comments"):
            if rng.random() < 0.15:
                inner = inner + boilerplate(kind) + (content() if rng.random() < 0.5 and kind != "comments" else "")
        body, wraps = inner, rng.random()
        if wraps < 0.85:  # else the text lies in the body itself
            body = element(rng.choice(WRAPPERS[:-1]), inner, True)
        elif wraps < 0.93:
            return f"<html data-content><body data-content>{content()}</body></html>"
        if wraps < 0.28:
            body = element(rng.choice(WRAPPERS[:-1]), body, True)
        before = [boilerplate(k) for k in ("notice", "header", "nav", "nav", "ad", "form") if rng.random() < 0.45]
        after = [boilerplate(k) for k in ("comments", "side", "ad", "share", "form", "nav", "footer", "notice") if rng.random() < 0.4]
        rng.shuffle(before)
        middle = "".join(before) + body + "".join(after)
        return f"<html data-content><body data-content>{element(rng.choice(OUTER), middle, True) if rng.random() < 0.4 else middle}</body></html>"

    return [page() for _ in range(n)]


MARK = "data-content"


def labels(source: str) -> tuple[Page, list[int]]:
    """A labelled page without its marks, and each node's label."""
    marked = Page(source.replace(f" {MARK}", ' role="datacontent"', -1))
    truth = [1] + [int("datacontent" in x) for x in marked.names[1:]]
    return Page(source.replace(f" {MARK}", "")), truth


@lru_cache(maxsize=1)
def trained(rounds: int = 12, rate: float = 0.15) -> Model:
    """Gradient ascent: what the labelled pages have less what the model expects of them, page by page."""
    weights: dict[str, float] = {}
    pair = [0.3, -0.3, -0.3, 0.3]
    model = Model(weights, pair)
    pages = [(p.keys(), p.parents, truth) for p, truth in map(labels, labelled_pages())]
    listed = [[evidence(k) for k in keys] for keys, _, _ in pages]
    order = random.Random(5)
    for step in range(rounds):
        now = rate / (1 + 0.3 * step)
        for k in order.sample(range(len(pages)), len(pages)):
            keys, parents, truth = pages[k]
            model.known.clear()
            odds, up = model.marginals(keys, parents)
            exps = [math.exp(x) for x in pair]
            for i in range(len(keys)):
                off = now * (truth[i] - 1 / (1 + math.exp(-max(-30.0, min(30.0, odds[i])))))
                for f in listed[k][i]:
                    weights[f] = weights.get(f, 0.0) * (1 - 2e-4) + off
                if i:
                    above, below = odds[parents[i]] - up[i], odds[i]
                    # the joint of parent and child: what else speaks for each, and the potential between them
                    e = math.exp(max(-30.0, min(30.0, above)))
                    rest = below - math.log((exps[1] + exps[3] * e) / (exps[0] + exps[2] * e))
                    c = math.exp(max(-30.0, min(30.0, rest)))
                    joint = [exps[0], exps[1] * c, exps[2] * e, exps[3] * e * c]
                    total, seen = sum(joint), 2 * truth[parents[i]] + truth[i]
                    for j in range(4):
                        pair[j] += 0.3 * now * ((j == seen) - joint[j] / total)
    model.known.clear()
    return model


def extract(source: str | None, model: Model) -> str:
    """The main text of a page."""
    if not source:
        return ""
    page = Page(source)
    odds, _ = model.marginals(page.keys(), page.parents)
    blocks: list[list[str]] = []
    last = -1
    for node, block, text in page.text:
        if odds[node] >= 0:
            if block != last:
                blocks.append([])
                last = block
            blocks[-1].append(references.unescape(text) if "&" in text else text)
    return "\n".join(b for b in (" ".join("".join(parts).split()) for parts in blocks) if b)


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """key, url, text, n_chars. The model, a few hundred numbers, is trained on the driver and sent out."""
    model = trained()
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.pair))

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            texts = [extract(t, m) for t in batch.column(source).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(url), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[key, url, "text", "n_chars"])

    return spread(pages.select(key, url, source)).mapInArrow(run, f"{key} {pages.schema[key].dataType.simpleString()}, {url} string, text string, n_chars long")
