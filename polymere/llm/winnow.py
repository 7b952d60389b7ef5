"""Benchmark decontamination by winnowing.

Words of lowered texts are hashed in grams of `k`; of each `window` consecutive
grams the least hash is a fingerprint, on both sides. Equal fingerprints of a
training text and a test text are joined, and each hit's diagonal is compared
word by word, which extends hits to the longest equal spans. Any shared span of
k + window - 1 words or more has a fingerprint in common, so every one is found;
spans of `min_span` words or more are reported.

The test side is held by every task. Its size is checked: beyond `held_bytes`
of text it is dealt by hash into as many passes as it takes, with equal result.
Passes run one after the other: what one found is written, and its test side is
let go before the next is built, so that driver and tasks hold one at a time.

Defined results: null and empty texts share nothing; a null doc_id or item_id, or
one that is no whole number, is null; a repeated document gives its spans again,
a repeated test row counts once. A text of fewer grams than a window has all its
grams as fingerprints. Other columns aren't touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, persist_table, text_slices
from .words import Words, find_words, mix

K = 5
WINDOW = 4
MIN_SPAN = K + WINDOW - 1
HELD_BYTES = 64 << 20
_C = 0xD6E8FEB86659FD93


def fingerprints(w: Words, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (numbers of words) and hashes of the fingerprints of all texts in w."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram = np.zeros(n, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(_C) + w.hash[j : j + n]
    gram = mix(gram)
    whole = w.text[:n] == w.text[k - 1 :]
    chosen = np.zeros(n, bool)
    if n >= window:
        least, at = gram[: n - window + 1].copy(), np.arange(n - window + 1)
        for j in range(1, window):
            here = gram[j : n - window + 1 + j]
            less = here <= least
            least = np.where(less, here, least)
            at[less] = np.flatnonzero(less) + j
        chosen[at[w.text[: n - window + 1] == w.text[k + window - 2 :]]] = True
    grams = np.diff(w.first) - k + 1
    few = (grams > 0) & (grams < window)
    if few.any():
        chosen |= few[w.text[:n]]
    at = np.flatnonzero(chosen & whole)
    return at, gram[at]


class TestSide:
    """Words and sorted fingerprints of test texts."""

    __test__ = False  # not a pytest class

    def __init__(self, ids: list[int | None], texts: list[str], k: int, window: int, min_span: int) -> None:
        if min_span < k + window - 1:
            raise ValueError("winnowing guarantees spans of k + window - 1 words or more only")
        self.k, self.window, self.min_span = k, window, min_span
        self.ids = pa.array(ids, pa.int64())
        hashes, firsts, self.fp, self.item, self.at, base = [], [0], [], [], [], 0
        for first, end, data, offsets in text_slices(pc.utf8_lower(pa.array(texts, pa.string()))):
            w = find_words(data, offsets)
            at, fp = fingerprints(w, k, window)
            self.fp.append(fp)
            self.item.append(w.text[at] + first)
            self.at.append(at - w.first[w.text[at]])
            hashes.append(w.hash)
            firsts.extend((w.first[1:] + base).tolist())
            base += len(w.hash)
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.hash, self.first = join(hashes, np.uint64), np.array(firsts)
        self.fp, self.item, self.at = join(self.fp, np.uint64), join(self.item, np.int64), join(self.at, np.int64)
        order = np.argsort(self.fp, kind="stable")
        self.fp, self.item, self.at = self.fp[order], self.item[order], self.at[order]

    def spans(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, number of the test text, word in the row, word in the test text, words) of each longest equal span."""
        if not len(self.fp):
            return
        for base, _, data, offsets in text_slices(pc.utf8_lower(texts)):
            w = find_words(data, offsets)
            at, fp = fingerprints(w, self.k, self.window)
            low = np.searchsorted(self.fp, fp, "left")
            hit = np.flatnonzero(self.fp[np.minimum(low, len(self.fp) - 1)] == fp)
            if not len(hit):
                continue
            low = low[hit]
            n = np.searchsorted(self.fp, fp[hit], "right") - low
            which = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at[hit], n)
            text = w.text[at]
            diagonals = np.unique(np.stack([text, self.item[which], at - w.first[text] - self.at[which]], axis=1), axis=0)
            for t, item, shift in diagonals.tolist():
                d, q = w.hash[w.first[t] : w.first[t + 1]], self.hash[self.first[item] : self.first[item + 1]]
                lo, hi = max(0, shift), min(len(d), len(q) + shift)
                same = np.zeros(hi - lo + 2, np.int8)
                same[1:-1] = d[lo:hi] == q[lo - shift : hi - shift]
                turn = np.diff(same)
                for s, e in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
                    if e - s >= self.min_span:
                        yield base + t, item, lo + s, lo + s - shift, e - s


class _Sides:
    """The test side in passes of about held_bytes of text, built one at a time."""

    def __init__(self, benchmark: DataFrame, k: int, window: int, min_span: int, held_bytes: int) -> None:
        self.rows = benchmark.select(F.col("item_id").try_cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
        self.passes = max(1, math.ceil((self.rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / held_bytes))
        self.how = k, window, min_span

    def side(self, i: int) -> TestSide:
        part = self.rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(self.passes)) == i).collect()
        part.sort(key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
        return TestSide([r.item_id for r in part], [r.text for r in part], *self.how)

    def each(self, docs: DataFrame, work: Callable[[Broadcast], DataFrame], label: str) -> DataFrame:
        """What `work` makes of all passes."""
        context = docs.sparkSession.sparkContext
        if self.passes == 1:
            return work(context.broadcast(self.side(0)))
        found = []
        for i in range(self.passes):
            held = context.broadcast(self.side(i))
            found.append(persist_table(work(held), label)[0])
            held.destroy()
        return reduce(DataFrame.unionByName, found)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, min_span: int = MIN_SPAN, held_bytes: int = HELD_BYTES) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, n_words) of each longest span of words that a document shares with a test text."""
    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def spans(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            side = held.value
            for b in batches:
                found = np.array(list(side.spans(b.column("text"))), np.int64).reshape(-1, 5)
                if len(found):
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(found[:, 0].copy())), side.ids.take(pa.array(found[:, 1].copy())), *(pa.array(found[:, c].copy()) for c in (2, 3, 4))], ["doc_id", "item_id", "doc_start", "item_start", "n_words"])

        return rows.mapInArrow(run, "doc_id bigint, item_id bigint, doc_start bigint, item_start bigint, n_words bigint")

    return _Sides(benchmark, k, window, min_span, held_bytes).each(docs, spans, "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, window: int = WINDOW, min_span: int = MIN_SPAN, held_bytes: int = HELD_BYTES) -> DataFrame:
    """docs without those that share a span of min_span words or more with a test text; all columns as they are."""
    sides = _Sides(benchmark, k, window, min_span, held_bytes)

    def rest(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[s[0] for s in held.value.spans(b.column("text"))]] = False
                yield b.filter(pa.array(keep))

        return map_rows(docs, run, docs.schema)

    if sides.passes == 1:
        return sides.each(docs, rest, "clean")
    # beyond one pass each finds texts, by two hashes, and what all found goes at the end
    hashed = [F.xxhash64("text").alias("__x"), F.xxhash64(F.lit(K), "text").alias("__y")]
    texts = docs.select(F.col("text").cast("string").alias("text")).select(*hashed, "text")

    def leaks(held: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = sorted({s[0] for s in held.value.spans(b.column("text"))})
                yield b.select(["__x", "__y"]).take(pa.array(hit, pa.int64()))

        return texts.mapInArrow(run, "__x bigint, __y bigint")

    gone = sides.each(docs, leaks, "leaks").distinct()
    mine = [F.xxhash64(docs["text"].cast("string")), F.xxhash64(F.lit(K), docs["text"].cast("string"))]
    return docs.join(gone, (mine[0] == gone["__x"]) & (mine[1] == gone["__y"]), "left_anti")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM documents
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark
), dp AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM d WHERE len(w) >= 8
), bp AS (
  SELECT item_id, w, unnest(range(1, len(w) - 6)) AS q FROM b WHERE len(w) >= 8
), hits AS (
  SELECT x.doc_id, y.item_id, x.p, y.q
  FROM (SELECT doc_id, p, array_to_string(w[p:p+7], ' ') AS g FROM dp) x
  JOIN (SELECT item_id, q, array_to_string(w[q:q+7], ' ') AS g FROM bp) y USING (g)
), runs AS (
  SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS run FROM hits
)
SELECT doc_id, item_id, min(p) - 1 AS doc_start, min(q) - 1 AS item_start, count(*) + 7 AS n_words
FROM runs GROUP BY doc_id, item_id, p - q, run
"""
