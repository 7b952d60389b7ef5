"""Language identification by a convolutional network over bytes.

Bytes are embedded; filters of widths 2, 3 and 4 run over a window of 256 bytes,
their rectified maxima over the window go through one layer and a softmax. The
network is trained in numpy on windows of a bounded sample of labelled
documents. A document is cut into windows without a gap or an overlap, all of
them are classified in batches, and the windows' probabilities, weighted by
their bytes, make the document's.

Defined results: a null or empty text has no window, and predicted and
confidence are null. A null declared language is predicted, but not trained on.
Without labelled rows nothing is predicted. Equal probabilities go to the
language that sorts first. A doc_id that is no whole number counts as null, a
repeated row is sampled once and predicted each time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sample_rows, text_slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
TRAIN_DOCS = 600
#: Bytes of the sampled texts at most.
TRAIN_BYTES = 16 << 20
#: Languages at most, the most frequent.
LANGUAGES = 500
#: Documents sampled of a language at least, if it has them.
LANGUAGE_DOCS = 20
_WIDEST = max(WIDTHS)


class Network:
    """Weights: embedding e, filters f[w] (w * EMBEDDING, FILTERS), their biases b[w], and the layer o with its bias c."""

    def __init__(self, languages: list[str], seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.e = rng.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32)
        self.e[0] = 0
        self.f = {w: rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.b = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.o = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
        self.c = np.zeros(len(languages), np.float32)

    def pooled(self, windows: np.ndarray, where: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Maxima (windows, filters) of all widths, and their positions if asked for."""
        x = self.e[windows]
        n, length = windows.shape
        out, places = [], []
        for w in WIDTHS:
            spots = length - w + 1
            view = np.lib.stride_tricks.as_strided(x, (n, spots, w * EMBEDDING), (*x.strides[:2], x.strides[2]))
            y = np.ascontiguousarray(view).reshape(-1, w * EMBEDDING) @ self.f[w]
            y = y.reshape(n, spots, FILTERS)
            if where:
                at = y.argmax(axis=1)
                places.append(at)
                top = np.take_along_axis(y, at[:, None, :], axis=1)[:, 0]
            else:
                top = y.max(axis=1)
            out.append(np.maximum(top + self.b[w], 0))
        return np.concatenate(out, axis=1), places

    def probabilities(self, windows: np.ndarray, batch: int = 192) -> np.ndarray:
        """Of each language, for each window.

        All widths share one product for each place: narrow filters have zeros
        below, and the embedded batch is read in place, by strides.
        """
        wide = np.zeros((_WIDEST * EMBEDDING, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            wide[: w * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = self.f[w]
        bias = np.concatenate([self.b[w] for w in WIDTHS])
        parts = []
        for i in range(0, len(windows), batch):
            some = windows[i : i + batch]
            n, length = some.shape
            x = self.e[some].reshape(n, length * EMBEDDING)
            top = x[:, : _WIDEST * EMBEDDING] @ wide
            y = np.empty_like(top)
            for t in range(1, length - _WIDEST + 1):
                np.matmul(x[:, t * EMBEDDING : (t + _WIDEST) * EMBEDDING], wide, out=y)
                np.maximum(top, y, out=top)
            for k, w in enumerate(WIDTHS):
                own = top[:, k * FILTERS : (k + 1) * FILTERS]
                for t in range(length - _WIDEST + 1, length - w + 1):
                    np.maximum(own, x[:, t * EMBEDDING : (t + w) * EMBEDDING] @ self.f[w], out=own)
            z = np.maximum(top + bias, 0) @ self.o + self.c
            z = np.exp(z - z.max(axis=1, keepdims=True))
            parts.append(z / z.sum(axis=1, keepdims=True))
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.e, self.o, self.c, *self.f.values(), *self.b.values()]

    def gradients(self, windows: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross-entropy, in the order of parameters()."""
        n = len(windows)
        h, places = self.pooled(windows, where=True)
        z = h @ self.o + self.c
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), label] -= 1
        p /= n
        back = (p @ self.o.T) * (h > 0)
        de = np.zeros_like(self.e)
        df, db = [], []
        for k, w in enumerate(WIDTHS):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            bytes_ = windows[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]
            df.append(np.einsum("nf,nfwd->wdf", g, self.e[bytes_]).reshape(w * EMBEDDING, FILTERS))
            db.append(g.sum(axis=0))
            share = np.einsum("nf,wdf->nfwd", g, self.f[w].reshape(w, EMBEDDING, FILTERS)).reshape(-1, EMBEDDING)
            flat = bytes_.reshape(-1)
            for d in range(EMBEDDING):
                de[:, d] += np.bincount(flat, weights=share[:, d], minlength=256).astype(np.float32)
        de[0] = 0
        return [de, h.T @ p, p.sum(axis=0), *df, *db]


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n, WINDOW), padded with zeros, the number of each one's text, and its bytes."""
    length = np.diff(offsets)
    n = -(-length // WINDOW)
    text = np.repeat(np.arange(len(length)), n)
    begin = np.repeat(offsets[:-1], n) + WINDOW * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    have = np.minimum(WINDOW, np.repeat(offsets[1:], n) - begin)
    grid = begin[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < have[:, None]
    return np.where(inside, data[np.minimum(grid, max(len(data) - 1, 0))], 0) if len(data) else np.zeros((0, WINDOW), np.uint8), text, have


def fit(texts: list[str], languages: list[str], epochs: int = 4, batch: int = 96, rate: float = 4e-3, seed: int = 5) -> Network:
    net = Network(sorted(set(languages)))
    number = {x: i for i, x in enumerate(net.languages)}
    parts = [(windows_of(data, offsets), a) for a, _, data, offsets in text_slices(pa.array(texts, pa.string()))]
    if not parts:
        return net
    x = np.concatenate([p[0][0] for p in parts])
    y = np.array([number[v] for v in languages])[np.concatenate([p[0][1] + p[1] for p in parts])]
    rng = np.random.default_rng(seed)
    # a language's windows are drawn as often as any other's
    weight = 1 / np.bincount(y, minlength=len(number))[y]
    values = net.parameters()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    k = 0
    for _ in range(epochs):
        order = rng.choice(len(x), len(x), p=weight / weight.sum())
        for i in range(0, len(x), batch):
            k += 1
            pick = order[i : i + batch]
            for v, g, m, s in zip(values, net.gradients(x[pick], y[pick]), first, second):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.99**k)) + 1e-8)).astype(v.dtype)
    return net


def classify(net: Network, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities (texts, languages) and windows of each text; all zero without a window."""
    p = np.zeros((len(texts), len(net.languages)))
    n = np.zeros(len(texts), np.int64)
    for a, b, data, offsets in text_slices(texts, 1 << 19):
        w, text, have = windows_of(data, offsets)
        n[a:b] = np.bincount(text, minlength=b - a)
        if not net.languages:
            continue
        q = net.probabilities(w) * have[:, None]
        for c in range(q.shape[1]):
            p[a:b, c] = np.bincount(text, weights=q[:, c], minlength=b - a)
        p[a:b] /= np.maximum(np.diff(offsets), 1)[:, None]
    return p, n


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Network:
    known = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("lang is not null and text <> ''")
    rows = sample_rows(known, train_docs, "lang", "text", TRAIN_BYTES, LANGUAGE_DOCS, LANGUAGES)
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(doc_id, lang, predicted, confidence, n_windows) of every row of docs."""
    net = train(docs, train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, n = classify(net, b.column("text"))
            none = (n == 0) | (not net.languages)
            best = p.argmax(axis=1) if net.languages else np.zeros(len(n), np.int64)
            names = pa.array([None if z else net.languages[i] for i, z in zip(best.tolist(), none.tolist())], pa.string())
            top = p.max(axis=1) if net.languages else np.zeros(len(n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), names, pa.array(top, mask=none), pa.array(n)], ["doc_id", "lang", "predicted", "confidence", "n_windows"])

    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang string, predicted string, confidence double, n_windows bigint")
