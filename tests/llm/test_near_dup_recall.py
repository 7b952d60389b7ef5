"""Near-duplicates against unfiltered brute force: every distance, heavier edits, bits that touch every byte."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from polymere.llm import simhash_index

from .data import prose
from .test_corpus_operators import edited, groups_of, near_by_brute_force, table_of


def heavier() -> list[str]:
    rng = random.Random(5)
    texts = [prose(60 + 4 * i, 3000 + i) for i in range(80)]
    return texts + [edited(t, share, rng) for t in texts for share in (0.03, 0.06, 0.1)]


def flipped(rng: np.random.Generator, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    a = rng.integers(0, 2, (n, 128), dtype=np.uint8)
    b = a.copy()
    for row in b:
        row[rng.choice(128, bits, replace=False)] ^= 1
    return np.packbits(a, axis=1).view(np.int64), np.packbits(b, axis=1).view(np.int64)


@pytest.mark.parametrize("distance", [0, 1, 2, 5, 12, 21])
def test_every_pair_within_the_distance_is_equal_under_a_mask(distance):
    a, b = flipped(np.random.default_rng(distance), distance, 2000)
    same = np.zeros(2000, bool)
    for block, mask in simhash_index.masks(distance):
        x, y = (simhash_index._block(p[:, 0].copy(), p[:, 1].copy(), block) for p in (a, b))
        same |= (x ^ y) & np.uint64(mask) == 0
    assert same.all()


def test_recall_at_each_distance():
    for distance in (12, 15, 16, 19, 20, 21, 22):
        a, b = flipped(np.random.default_rng(distance), distance, 100)
        p = [simhash_index.entry_links(np.arange(200), *np.concatenate([a, b]).T.copy(), g, 4, 21) for g in range(4)]
        assert set(map(tuple, np.sort(np.concatenate(p), axis=1).tolist())) == ({(i, 100 + i) for i in range(100)} if distance <= 21 else set())


@pytest.mark.parametrize("chunk", [simhash_index.CHUNK, 120])
def test_groups_of_heavier_edits_against_unfiltered_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash_index, "CHUNK", chunk)
    texts = heavier()
    pairs = near_by_brute_force(simhash_index.fingerprints_of(pa.array(texts)), simhash_index.DISTANCE)
    want = {a: r for a, r in groups_of(pairs).items() if a != r}
    got = {r.doc_id: r.kept_id for r in simhash_index.near_duplicates(table_of(spark, texts)).collect()}
    assert got == want
