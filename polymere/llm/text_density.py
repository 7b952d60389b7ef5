"""Main text of HTML pages by composite text density.

For every node of the DOM, C is the characters of its subtree's text, T its
tags, LC and LT the characters and tags within links; b is the body. Its density

    C / T * log_{ln(C / (C - LC) * LC + LC_b / C_b * C + e)} (C / LC * T / LT)

adjusts characters per tag for links, zero denominators counting as 1. A node's
density sum is the sum of its children's densities. The least density on the
path from the body to the node of the greatest density sum is the threshold:
going down from the body, of every topmost node of at least that density the
descendant (or itself) with the greatest density sum is taken, and its text is
the page's, in order.

Characters are counted after character references are resolved and runs of white
space made one. Comments, scripts, styles, templates, titles and the head have no
text. The time is in proportion to the page's length, whatever its tags: a tag
that isn't closed by `>` goes to the page's end and is dropped, an end tag finds
its start by name, and a node's texts are a stretch of the page's.

Nodes taken are given as their tag and their number in document order, `p#12`.

Defined results: a null page has null text and numbers; a page without any
character has empty text and no node. Of equal sums the node that comes first
wins. End tags without a start are skipped, missing ones are made up: by the
parent's, and by the start of another of the kind for p, li, dt, dd, option, tr,
td and th. Quotes hold `>` only after `=`. A null page_id or url is carried as it
is, a page_id that is no whole number is null, and a repeated row gives its text
again.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
_RAW = {"script", "style", "template", "title", "textarea"}
_SILENT = {"script", "style", "template", "title"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_SCOPE = {"ul", "ol", "dl", "select", "table", "tbody", "thead", "body", "html", "div", "article"}
_STOPS = {t: re.compile(rf"</{t}\s*+>", re.I) for t in _RAW}
_SPACE = re.compile(r"[ \t\r\n\f ]+")


class Dom:
    """Nodes in document order: tag, parent, end of the subtree, and the stretch of its texts; texts (node, text) in order."""

    def __init__(self, page: str) -> None:
        self.tag, self.parent, self.end = ["#root"], [-1], [0]
        self.first_text, self.last_text = [0], [0]
        self.texts: list[tuple[int, str]] = []
        stack, at, skip_head = [0], 0, False
        #: depths at which elements of a tag are open, ascending
        depths: dict[str, list[int]] = {}

        def close(depth: int) -> None:
            while len(stack) > depth:
                node = stack.pop()
                self.end[node], self.last_text[node] = len(self.tag), len(self.texts)
                if node:
                    depths[self.tag[node]].pop()

        def deepest(tags: set[str]) -> int:
            return max((depths[t][-1] for t in tags if depths.get(t)), default=0)

        def text(s: str) -> None:
            if s and not skip_head:
                s = _SPACE.sub(" ", entities.unescape(s))
                if s.strip(" "):
                    self.texts.append((stack[-1], s))

        while True:
            m = _TOKEN.search(page, at)
            if m is None:
                text(page[at:])
                break
            text(page[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if depths.get(tag):
                    close(depths[tag][-1])
                if tag == "head":
                    skip_head = False
                continue
            if page[at - 1] != ">":
                break
            if tag == "body":
                skip_head = False
            depth = deepest(_CLOSES.get(tag, {"p"} if tag in _BLOCK else set()))
            if depth > deepest(_SCOPE):
                close(depth)
            node = len(self.tag)
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.end.append(node + 1)
            self.first_text.append(len(self.texts))
            self.last_text.append(len(self.texts))
            if tag == "head":
                skip_head = True
            if tag in _RAW:
                stop = _STOPS[tag].search(page, at)
                inner, at = page[at : stop.start() if stop else len(page)], stop.end() if stop else len(page)
                if tag not in _SILENT:
                    stack.append(node)
                    depths.setdefault(tag, []).append(len(stack) - 1)
                    text(inner)
                    close(len(stack) - 1)
            elif tag not in _VOID and not m[3].endswith("/"):
                stack.append(node)
                depths.setdefault(tag, []).append(len(stack) - 1)
        close(0)


def measure(dom: Dom) -> tuple[list[float], list[float], list[int], int]:
    """Density, density sum and characters of each node, and the body."""
    n = len(dom.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[dom.parent[i]] or dom.tag[i] == "a"
    for node, s in dom.texts:
        size = len(s.strip(" "))
        chars[node] += size
        if linked[node]:
            link_chars[node] += size
    for i in range(n - 1, 0, -1):
        p = dom.parent[i]
        chars[p] += chars[i]
        tags[p] += tags[i] + 1
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i] + (dom.tag[i] == "a")
    body = next((i for i, t in enumerate(dom.tag) if t == "body"), 0)
    ratio = link_chars[body] / max(1, chars[body])
    density, sums = [0.0] * n, [0.0] * n
    for i in range(n):
        c = chars[i]
        if c:
            t, lc, lt = max(1, tags[i]), link_chars[i], link_tags[i]
            # the logarithm's base is ln(e) = 1 for a node without any link on a page without any: then it is e
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            density[i] = c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / (math.log(base) if base > 1 else 1.0)
    for i in range(1, n):
        sums[dom.parent[i]] += density[i]
    return density, sums, chars, body


def extract(page: str) -> tuple[str, list[str], float, float]:
    """Text, the nodes taken, threshold, and the greatest density sum."""
    dom = Dom(page)
    density, sums, chars, body = measure(dom)
    if not chars[body]:
        return "", [], 0.0, 0.0
    inside = range(body, dom.end[body])
    top = max(inside, key=lambda i: (sums[i], -i))
    threshold, i = density[top], top
    while i != body:
        i = dom.parent[i]
        threshold = min(threshold, density[i])
    taken, i = [], body
    while i < dom.end[body]:
        if chars[i] and density[i] >= threshold:
            # a leaf has no children's densities: its own text is all there is
            taken.append(max(range(i, dom.end[i]), key=lambda j: (sums[j], chars[j] if not sums[i] else 0, -j)))
            i = dom.end[i]
        else:
            i += 1
    pieces = [s.strip(" ") for i in taken for _, s in dom.texts[dom.first_text[i] : dom.last_text[i]]]
    return "\n".join(pieces), [f"{dom.tag[i]}#{i}" for i in taken], threshold, sums[top]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, nodes, threshold, density_sum) of every row of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256].copy()
                found = [None if h is None else extract(h) for h in part.pop("html")]
                part["text"] = [None if f is None else f[0] for f in found]
                part["n_chars"] = pd.array([None if f is None else len(f[0]) for f in found], "Int64")
                part["nodes"] = [None if f is None else f[1] for f in found]
                part["threshold"] = pd.array([None if f is None else f[2] for f in found], "Float64")
                part["density_sum"] = pd.array([None if f is None else f[3] for f in found], "Float64")
                yield part

    rows = pages.select(F.col("page_id").try_cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(run, "page_id bigint, url string, text string, n_chars bigint, nodes array<string>, threshold double, density_sum double")
