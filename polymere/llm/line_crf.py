"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The weight of a line's label comes from features of
the line, of the line before and of the line after; a 2 x 2 matrix weighs the
labels of neighbouring lines. The field is fitted in numpy on a bounded sample
of labelled documents, all lines of a document carrying its label, by gradient
ascent on the penalised conditional likelihood. For every document, forward and
backward passes over all its lines give each line's marginal probability of
being good; their mean, weighted by the lines' lengths in bytes, is its quality.
Documents of at least `threshold` are kept.

Defined results: a null text has no lines and quality null, a text without any
byte but line ends has quality 0; both are rejected. Labels that are null count
as absent. Without labels every quality is 0.5, and is kept. A line is labelled
good if its marginal is 0.5 or more. A doc_id that is no whole number counts as
null; a repeated row is sampled once and scored each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_rows, persist_table, sample_rows, text_slices
from .words import find_words

TRAIN_DOCS = 2000
#: Bytes of the sampled texts at most.
TRAIN_BYTES = 32 << 20
THRESHOLD = 0.5
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)),
    "digit": b"0123456789",
    "space": b" \t\r\f\v",
    "stop": b".,;:?'\"()-",
    "shout": b"!",
    "symbol": b"*#%$&@<>{}[]^~=_+\\/`|",
}
_TABLES = []
for _chars in _CLASSES.values():
    _t = np.zeros(256, np.uint8)
    _t[list(_chars)] = 1
    _TABLES.append(_t)
OWN = 22
FEATURES = 3 * OWN + 3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines, FEATURES), bytes of each line, and first[i]:first[i + 1], the lines of text i."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    lines = len(start)
    end = np.append(start[1:], n)
    ended = np.ones(lines, bool)
    ended[first[1:] - 1] = False
    size = end - start - ended
    at = np.minimum(start, max(n - 1, 0))
    counts = np.zeros((len(_TABLES), lines))
    some = size > 0
    if some.any():
        for i, t in enumerate(_TABLES):
            counts[i] = np.where(some, np.add.reduceat(t[data], at, dtype=np.int32), 0)
    upper, lower, digit, space, stop, shout, symbol = counts
    w = find_words(data, offsets)
    line = np.searchsorted(start, w.start, "right") - 1
    words = np.bincount(line, minlength=lines)
    again = np.bincount(line[1:][(w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])], minlength=lines)
    length = np.bincount(line, weights=w.end - w.start, minlength=lines)
    chars, many = np.maximum(size - space, 1), np.maximum(words, 1)
    letters = np.maximum(upper + lower, 1)
    head = data[at] if n else np.zeros(lines, np.uint8)
    tail = data[np.clip(start + size - 1, 0, max(n - 1, 0))] if n else np.zeros(lines, np.uint8)
    f = np.zeros((lines, OWN), np.float32)
    columns = [
        upper / letters, upper / letters > 0.5, upper / letters > 0.2,
        symbol / chars, symbol / chars > 0.05, symbol / chars > 0.15, symbol > 0,
        digit / chars, digit / chars > 0.2,
        shout / chars, shout > 1,
        again / many, again / many > 0.3, again > 1,
        length / many / 12, np.minimum(words, 60) / 60, words < 3, size == 0,
        (tail == 46) | (tail == 63), (head >= 65) & (head <= 90), stop / chars, np.log1p(size) / 8,
    ]
    for i, c in enumerate(columns):
        f[:, i] = c
    x = np.zeros((lines, FEATURES), np.float32)
    x[:, :OWN] = f
    x[1:, OWN : 2 * OWN] = f[:-1]
    x[:-1, 2 * OWN : 3 * OWN] = f[1:]
    x[first[:-1], OWN : 2 * OWN] = 0
    x[first[1:] - 1, 2 * OWN : 3 * OWN] = 0
    x[:, -3] = 1
    x[first[:-1], -2] = 1
    x[first[1:] - 1, -1] = 1
    return x, size, first


def forward_backward(unary: np.ndarray, first: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of good from the left (with the line itself) and from the right (without it), for each line.

    All sequences advance together, longest first, so that those still running are a prefix.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    starts, n = first[:-1][order], n[order]
    left, right = np.zeros(len(unary)), np.zeros(len(unary))
    running = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    for t, k in enumerate(running):
        i = starts[:k] + t
        r = left[i - 1] if t else None
        left[i] = unary[i] + (0 if r is None else np.logaddexp(r + step[1, 1], step[0, 1]) - np.logaddexp(r + step[1, 0], step[0, 0]))
    for t in range(1, len(running)):
        k = running[t]
        i = starts[:k] + n[:k] - t
        m = unary[i] + right[i]
        right[i - 1] = np.logaddexp(step[1, 1] + m, step[1, 0]) - np.logaddexp(step[0, 1] + m, step[0, 0])
    return left, right


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(texts: list[str], labels: list[int], rounds: int = 200, rate: float = 0.1, penalty: float = 2e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the features, and the matrix of transitions, by Adam on the mean log-likelihood of a line."""
    weights, step = np.zeros(FEATURES), np.zeros((2, 2))
    if not texts:
        return weights, step
    parts = [(line_features(data, offsets), np.array(labels[a:b])) for a, b, data, offsets in text_slices(pa.array(texts, pa.string()))]
    x = np.concatenate([p[0][0] for p in parts]).astype(np.float64)
    n = np.concatenate([np.diff(p[0][2]) for p in parts])
    y = np.repeat(np.concatenate([p[1] for p in parts]), n).astype(np.float64)
    first = np.concatenate([[0], np.cumsum(n)])
    pair = np.ones(len(y), bool)
    pair[first[1:] - 1] = False
    pair = np.flatnonzero(pair)
    seen = np.array([[np.sum((y[pair] == i) & (y[pair + 1] == j)) for j in (0, 1)] for i in (0, 1)])
    moments = [np.zeros(FEATURES + 4), np.zeros(FEATURES + 4)]
    for k in range(1, rounds + 1):
        unary = x @ weights
        left, right = forward_backward(unary, first, step)
        p = _sigmoid(left + right)
        m = unary[pair + 1] + right[pair + 1]
        joint = np.stack([np.full(len(pair), step[0, 0]), step[0, 1] + m, left[pair] + step[1, 0], left[pair] + step[1, 1] + m])
        joint = np.exp(joint - joint.max(axis=0))
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        g = np.concatenate([x.T @ (y - p), (seen - joint).ravel()]) / len(y) - penalty * np.concatenate([weights, step.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        d = rate * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-9)
        weights = weights + d[:FEATURES]
        step = step + d[FEATURES:].reshape(2, 2)
    return weights, step


def quality_of(texts: pa.Array, weights: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Quality, number of lines and their labels, a 1 for each good and a 0 for each bad one, of each text; NaN, 0 and null for a null one."""
    out, lines, labels = np.zeros(len(texts)), np.zeros(len(texts), np.int64), [np.zeros(0, np.uint8)]
    for a, b, data, offsets in text_slices(texts):
        x, size, first = line_features(data, offsets)
        left, right = forward_backward((x @ weights.astype(np.float32)).astype(np.float64), first, step)
        good = _sigmoid(left + right)
        total = np.add.reduceat(size, first[:-1])
        out[a:b] = np.where(total > 0, np.add.reduceat(size * good, first[:-1]) / np.maximum(total, 1), 0)
        lines[a:b] = np.diff(first)
        labels.append(np.where(good >= 0.5, ord("1"), ord("0")).astype(np.uint8))
    gone = texts.is_null().to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lines)]).astype(np.int64)
    held = pa.py_buffer(np.packbits(~gone, bitorder="little"))
    line_labels = pa.Array.from_buffers(pa.large_string(), len(texts), [held, pa.py_buffer(ends), pa.py_buffer(np.concatenate(labels))])
    out[gone], lines[gone] = np.nan, 0
    return out, lines, line_labels


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, train_bytes: int = TRAIN_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Fit on at most `train_docs` labelled documents of `train_bytes` in all."""
    known = labels.select(F.col("doc_id").try_cast("bigint").alias("__id"), F.col("quality").cast("int").alias("__quality"), F.lit("").alias("__none")).filter("__id is not null and __quality in (0, 1)")
    # twice as many labels as documents, since not every label has one
    ids = [(r["__id"], r["__quality"]) for r in sample_rows(known, 2 * train_docs, "__quality", "__none", 1)]
    held = F.broadcast(docs.sparkSession.createDataFrame(ids, "__id bigint, __quality int"))
    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null").join(held, F.col("doc_id") == F.col("__id")).select("doc_id", "text", "__quality")
    labelled, path = persist_table(rows, "labelled")
    picked = sample_rows(labelled, train_docs, "__quality", "text", train_bytes)
    drop_table(docs.sparkSession, path)
    return fit([r["text"] for r in picked], [r["__quality"] for r in picked])


def score(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_lines, line_labels, quality, keep) of every row of docs; line_labels has a 1 for each good line and a 0 for each bad one."""
    weights, step = train(docs, labels, train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, n, lines = quality_of(b.column("text"), weights, step)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n), lines.cast(b.column("text").type), pa.array(q, mask=np.isnan(q)), pa.array(q >= threshold)], ["doc_id", "n_lines", "line_labels", "quality", "keep"])

    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_lines bigint, line_labels string, quality double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose quality is at least the threshold; all columns as they are."""
    weights, step = train(docs, labels, train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(quality_of(b.column("text"), weights, step)[0] >= threshold))

    return map_rows(docs, run, docs.schema)
