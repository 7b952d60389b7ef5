"""Main text: choice of nodes against brute force over trees built on their own, hostile pages in linear time, text of rarer tags."""

from __future__ import annotations

import math
import random
import time
from html.parser import HTMLParser

import pytest

from polymere.llm import text_density

from .data import prose


class Node:
    def __init__(self, tag, parent):
        self.tag, self.parent, self.parts = tag, parent, []

    def below(self):
        for x in self.parts:
            if isinstance(x, Node):
                yield x
                yield from x.below()

    def strings(self, linked=False):
        linked = linked or self.tag == "a"
        for x in self.parts:
            if isinstance(x, Node):
                yield from x.strings(linked)
            elif x.strip():
                yield " ".join(x.split()), linked

    def in_link(self):
        return self.parent is not None and (self.parent.tag == "a" or self.parent.in_link())


class Builder(HTMLParser):
    """Of well-formed pages only."""

    def __init__(self):
        super().__init__()
        self.root = self.now = Node("#root", None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, self.now)
        self.now.parts.append(node)
        self.now = node

    def handle_endtag(self, tag):
        self.now = self.now.parent

    def handle_data(self, data):
        self.now.parts.append(data)


def brute_force(page: str) -> str:
    builder = Builder()
    builder.feed(page)
    body = next(n for n in builder.root.below() if n.tag == "body")
    nodes = [body, *body.below()]
    ratio = sum(len(s) for s, linked in body.strings() if linked) / max(1, sum(len(s) for s, _ in body.strings()))

    def density(n):
        strings = list(n.strings(n.in_link()))
        c, lc = sum(len(s) for s, _ in strings), sum(len(s) for s, linked in strings if linked)
        if not c:
            return 0.0
        t, lt = max(1, len(list(n.below()))), sum(x.tag == "a" for x in n.below())
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt))) / (math.log(base) if base > 1 else 1.0)

    d = {n: density(n) for n in nodes}
    total = {n: sum(d[x] for x in n.parts if isinstance(x, Node)) for n in nodes}
    best = max(nodes, key=lambda n: total[n])  # the first of equal ones
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    least = min(d[n] for n in path)
    out = []

    def visit(n):
        if any(n.strings()) and d[n] >= least:
            inner = [n, *n.below()]
            pick = max(inner, key=lambda x: (total[x], sum(len(s) for s, _ in x.strings()) if not total[n] else 0))
            out.extend(s for s, _ in pick.strings())
        else:
            for x in n.parts:
                if isinstance(x, Node):
                    visit(x)

    visit(body)
    return "\n".join(out)


def random_page(rng: random.Random) -> str:
    def tree(depth):
        tag = rng.choice(["div", "span", "a", "section", "b", "article"])
        if tag == "a":
            return f"<a href='x'>{prose(rng.randint(1, 4), rng.randrange(10**6))}</a>"
        inner = "".join(tree(depth - 1) if depth and rng.random() < 0.7 else " " + prose(rng.randint(1, 40), rng.randrange(10**6)) + " " for _ in range(rng.randint(1, 4)))
        return f"<{tag}>{inner}</{tag}>"

    return f"<html><body>{''.join(tree(4) for _ in range(rng.randint(1, 4)))}</body></html>"


def test_chosen_nodes_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        page = random_page(rng)
        assert text_density.extract(page)[0] == brute_force(page)


@pytest.mark.parametrize("make", [
    lambda n: "<a " * n, lambda n: "<b>" * n + "x" + "</i>" * n, lambda n: "<div>" * n + "<p>x" * n, lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: "<a b=\"" * n, lambda n: "<a b='" + "='x" * n,
    lambda n: "<!" * n, lambda n: "<script>" * n, lambda n: "<p>x" * n, lambda n: "&" * n + "<", lambda n: "<a =" + " =" * n, lambda n: "</" * n, lambda n: "<textarea>" * n + "</textarea" * n,
])
def test_hostile_pages_take_time_in_proportion(make):
    def seconds(n):
        page, times = make(n), []
        for _ in range(3):
            began = time.process_time()
            text_density.extract(page)
            times.append(time.process_time() - began)
        return min(times)

    seconds(1000)
    # 8 times as long a page; by the square of its length it would take 64 times as long
    assert seconds(80_000) < 24 * max(seconds(10_000), 0.05)


def test_text_of_rarer_tags():
    page = "<title>T</title><noscript>turn it on</noscript><svg><text>drawn</text></svg><textarea>a <b> c</textarea><script>no()</script><style>no</style><template>no</template>"
    assert text_density.extract(page)[0].split("\n") == ["turn it on", "drawn", "a <b> c"]
    assert text_density.extract("<noscript>only</noscript>")[0] == "only"
    assert text_density.extract('<a title="a > b" href=x>in</a>')[0] == "in"
    assert text_density.extract("a <b")[0] == "a"
