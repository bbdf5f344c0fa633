"""Operator 6: main text of web pages by minimum-cut labelling.

A page is read into text blocks, each with its container and cues from tags, classes, ids and roles around it. A
logistic model gives each block the chance that it is content; the negative logs of that chance and of its complement
are the capacities of the block's terminal edges. Smoothness edges join blocks that follow each other (strong inside
one container, weak across) and blocks that follow each other among one container's own (DOM proximity). Max-flow
finds the minimum cut; blocks on the source side are the main text.

The model is trained here, in numpy, on pages that a seeded generator makes with known labels; nothing is learned from
the table, so a page's text depends on the page alone. Null and empty html give an empty text; an empty table gives no rows;
rows that repeat are each extracted; a null page_id or url stays null. Broken markup is read as far as it goes. A very long
page costs in proportion to its length, and is held by one task. Other columns are ignored, whatever their names. The head,
scripts, styles, forms' fields, hidden elements and comments of the markup are never text.
"""

from __future__ import annotations

import html
import re
from collections import Counter, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[a-z]+")
#: Elements whose content is not text.
OPAQUE = frozenset("script style noscript template svg math iframe title textarea canvas noembed noframes".split())
#: Elements whose content holds no markup and ends at their own end tag alone.
RAW = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in "script style textarea title iframe xmp noembed noframes".split()}
COMMENT_END = re.compile(r"--!?>")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
BOILER = frozenset("nav footer aside form menu dialog button fieldset".split())
MAIN = frozenset("article main".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Attributes whose names tell what an element is for; elements that make no container; how styles hide.
CUES = frozenset("class id role aria-label".split())
INNER = frozenset("p li td blockquote pre".split())
NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")
#: Parts of class, id and role names that tell of boilerplate and of content.
BAD = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs footer foot header masthead topbar toolbar sidebar "
    "aside widget widgets cookie cookies consent notice notices alert gdpr popup modal overlay subscribe subscription newsletter signup login signin share sharing social comment comments "
    "discussion disqus reply replies respond related recommended recommendations trending popular pagination pager search tags contentinfo complementary copyright legal".split()
)
GOOD = frozenset("article content contents post entry story body text main maintext articlebody prose".split())
CLAMP, NEXT, ACROSS, SIBLING = 6.0, 0.6, 0.05, 1.0
FEATURES = 9


def tags(source: str):
    """(text, tag, closing, attributes) of each piece of a page, in order; tag is None for text. Comments and declarations go, and
    so does what is inside raw elements: quotes, `<!--` and tags there mean nothing.

    A quote that opens a value and is never closed is an ordinary character; so is a `<` that begins no tag, and one whose
    tag never ends. Each character is looked at a bounded number of times, whatever the markup.
    """
    at, n = 0, len(source)
    last = {c: source.rfind(c) for c in ">\"'"}
    while at < n:
        lt = source.find("<", at)
        if lt != at:
            yield source[at : lt if lt >= 0 else n], None, False, ""
            if lt < 0:
                return
            at = lt
        if source.startswith("<!--", at):
            # `<!-->` and `<!--->` are whole comments
            end = COMMENT_END.search(source, at + 2)
            at = end.end() if end else n
            continue
        m = NAME.match(source, at + 1)
        if not m and source[at + 1 : at + 2] not in ("!", "?", "/") or last[">"] < at:
            yield "<", None, False, ""
            at += 1
            continue
        if not m:
            at = source.find(">", at) + 1
            continue
        end = m.end()
        while True:
            stop = STOP.search(source, end)
            if stop is None or stop[0] == ">":
                break
            end, quote = stop.end(), stop[0]
            # a quote opens a value only after an equals sign
            if last[quote] >= end and source[m.end() : stop.start()].rstrip()[-1:] == "=":
                end = source.find(quote, end) + 1
        if stop is None:
            # no end after the last value: the first `>` after the name is the tag's end
            end = source.find(">", m.end())
        else:
            end = stop.start()
        tag, closing, attributes = m[1].lower(), source[at + 1] == "/", source[m.end() : end]
        yield "", tag, closing, attributes
        at = end + 1
        if tag in RAW and not closing and not attributes.rstrip().endswith("/"):
            ended = RAW[tag].search(source, at)
            at = ended.start() if ended else n


class Page:
    """The blocks of a page: text, container (its number), and features."""

    def __init__(self, source: str):
        # an element: tag, container, and boilerplate around, main around, bad cue around, good cue around, hidden
        self.names, self.around, self.state = ["#root"], [0], [(0, 0, 0, 0, 0)]
        self.blocks: list[tuple[str, int, list[float]]] = []
        self.stack, self.open_tags, self.text, self.linked, self.in_link, self.heads = [0], Counter(), [], 0, 0, 0
        self.read(source)
        self.flush()

    def flush(self) -> None:
        if self.text:
            words = html.unescape("".join(self.text)).split()
            if words:
                self.blocks.append((" ".join(words), self.around[self.stack[-1]], self.features(words)))
            self.text, self.linked = [], 0

    def features(self, words: list[str]) -> list[float]:
        chars = sum(map(len, words)) + len(words) - 1
        boiler, main, bad, good, _ = self.state[self.stack[-1]]
        return [1.0, min(3.0, np.log1p(chars) / 3), min(1.0, self.linked / max(1, chars)), float(words[-1][-1] in ".!?…:;\"'»”"), float(len(words) < 4), float(boiler > 0), float(main > 0), float(bad > 0), float(good > 0)]

    def open(self, tag: str, attributes: str) -> None:
        boiler, main, bad, good, hidden = self.state[self.stack[-1]]
        tokens: set[str] = set()
        for m in ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if name in CUES:
                tokens.update(WORDS.findall(value))
            hidden = hidden or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(NO_DISPLAY.search(value))
        top_header = tag == "header" and not main
        inner = tag in INLINE or tag in HEADING or tag in INNER
        self.names.append(tag)
        own = len(self.names) - 1
        self.around.append(self.around[self.stack[-1]] if inner else own)
        plain = tag in ("body", "html")
        self.state.append((boiler or tag in BOILER or top_header, main or tag in MAIN, bad or (not plain and bool(tokens & BAD)), good or (not plain and bool(tokens & GOOD)), hidden))
        self.stack.append(own)
        self.open_tags[tag] += 1

    def close(self, tag: str) -> None:
        if self.open_tags[tag] > 0:
            name = None
            while name != tag:
                name = self.names[self.stack.pop()]
                self.open_tags[name] -= 1

    def read(self, source: str) -> None:
        skip = None
        for text, tag, closing, attributes in tags(source):
            if skip:
                # inside an element whose content is not text, up to its end tag
                skip = None if closing and tag == skip else skip
            elif tag is None:
                if not self.state[self.stack[-1]][4] and not self.heads:
                    self.text.append(text)
                    if self.in_link:
                        self.linked += len(text)
            elif closing:
                if tag == "a":
                    self.in_link = max(0, self.in_link - 1)
                if tag not in INLINE:
                    self.flush()
                    if tag == "head":
                        self.heads = 0
                self.close(tag)
            elif tag in OPAQUE and not attributes.rstrip().endswith("/"):
                skip = tag
            elif tag == "br":
                self.text.append(" ")
            elif tag in VOID:
                if tag == "hr":
                    self.flush()
            else:
                if tag not in INLINE:
                    self.flush()
                    self.in_link = 0
                    if tag in ("body", "head"):
                        self.heads = tag == "head"
                    if "p" in (self.names[e] for e in self.stack[-4:]):
                        self.close("p")
                    if tag in ("li", "td", "tr", "dd", "dt", "option") and self.names[self.stack[-1]] == tag:
                        self.close(tag)
                elif tag == "a":
                    self.in_link += 1
                self.open(tag, attributes)


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source side of a minimum cut.

    gain: source capacity less sink capacity (their common part flows straight through); edges: undirected capacities.
    Flow is pushed from nodes with excess to nodes that lack it along shortest residual paths. What a search without success
    has reached is a closed set: no path can leave it later, so it lies on the source side and is never searched again.
    """
    n, rest = len(gain), list(gain)
    arcs: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        arcs[a][b] = arcs[a].get(b, 0.0) + c
        arcs[b][a] = arcs[b].get(a, 0.0) + c
    eps, side = 1e-9, [False] * n
    for s in range(n):
        while rest[s] > eps and not side[s]:
            came, queue, end = {s: s}, deque([s]), -1
            while queue:
                v = queue.popleft()
                if rest[v] < -eps:
                    end = v
                    break
                for w, c in arcs[v].items():
                    if c > eps and w not in came and not side[w]:
                        came[w] = v
                        queue.append(w)
            if end < 0:
                for v in came:
                    side[v] = True
                break
            flow, v = min(rest[s], -rest[end]), end
            while v != s:
                flow, v = min(flow, arcs[came[v]][v]), came[v]
            v = end
            while v != s:
                u = came[v]
                arcs[u][v] -= flow
                arcs[v][u] += flow
                v = u
            rest[s] -= flow
            rest[end] += flow
    return side


def training_pages(count: int = 400, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1: content) of blocks of generated pages. Content words begin with x, others with y."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]

    def words(c: str, low: int, high: int, stop: bool) -> str:
        return " ".join(c + "a" * int(rng.integers(1, 9)) for _ in range(int(rng.integers(low, high)))) + ("." if stop else "")

    def boiler() -> str:
        kind = int(rng.integers(5))
        links = "".join(f'<li><a href="/u">{words("y", 1, 4, False)}</a></li>' for _ in range(int(rng.integers(2, 7))))
        box = pick(['<nav>{}</nav>', '<footer>{}</footer>', '<aside>{}</aside>', '<header>{}</header>', '<div class="sidebar">{}</div>', '<div id="menu">{}</div>', '<div class="ad-box">{}</div>', '<div class="cookie-notice">{}</div>', '<section class="comments">{}</section>', '<form>{}</form>', '<div>{}</div>'])
        inner = f"<ul>{links}</ul>" if kind < 2 else f"<p>{words('y', 3, 25, bool(rng.integers(2)))}</p>" if kind < 4 else words("y", 2, 15, bool(rng.integers(2)))
        return (f"<div><ul>{links}</ul></div>" if box == "<div>{}</div>" else box.format(inner))

    xs, ys = [], []
    for _ in range(count):
        box = pick(["<article>{}</article>", "<main>{}</main>", '<div class="post-content">{}</div>', '<div id="story">{}</div>', "<div>{}</div>", "<main><article>{}</article></main>"])
        inner = "".join(pick([f"<p>{words('x', 8, 60, True)}</p>"] * 6 + [f"<h2>{words('x', 2, 8, False)}</h2>", f"<p>{words('x', 1, 4, True)}</p>", f"<ul><li>{words('x', 2, 12, bool(rng.integers(2)))}</li></ul>"]) for _ in range(int(rng.integers(2, 12))))
        inner = f"<h1>{words('x', 2, 10, bool(rng.integers(2)))}</h1>" + inner
        page = "".join(boiler() for _ in range(int(rng.integers(1, 4)))) + box.format(inner) + "".join(boiler() for _ in range(int(rng.integers(1, 4))))
        for text, _, f in Page(f"<html><body>{page}</body></html>").blocks:
            xs.append(f)
            ys.append(text[0] == "x")
    return np.array(xs), np.array(ys, float)


def train(steps: int = 400, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic model by gradient descent."""
    x, y = training_pages()
    w = np.zeros(FEATURES)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (p - y) / len(y) + ridge * w)
    return w.tolist()


def main_text(source: str, weights: list[float]) -> str:
    blocks = Page(source).blocks
    if not blocks:
        return ""
    z = (np.array([f for _, _, f in blocks]) @ np.array(weights)).tolist()
    # -log(1 - p) less -log p of a logistic chance p is its logit
    gain = [max(-CLAMP, min(CLAMP, v)) for v in z]
    edges, last = [], {}
    for i, (_, c, _) in enumerate(blocks):
        if i:
            edges.append((i - 1, i, NEXT if blocks[i - 1][1] == c else ACROSS))
        if c in last and last[c] != i - 1:
            edges.append((last[c], i, SIBLING))
        last[c] = i
    return "\n".join(b[0] for b, keep in zip(blocks, min_cut(gain, edges), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of pages (page_id, url, html)."""
    weights = train()

    def run(batches):
        for b in batches:
            texts = [main_text(h or "", weights) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
