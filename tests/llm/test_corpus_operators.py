"""Operators that compare or arrange rows: near-duplicates, winnowing, curriculum, shards, capture merge, pipeline."""

from __future__ import annotations

import itertools
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from polymere.llm import capture_merge, common, curriculum, shard, simhash_index, winnow
from polymere.llm.words import find_words

from .data import SAMPLE, SCHEMA, awkward, prose, with_clashes


def table_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


# -- words

def test_words_against_regular_expression():
    rng = random.Random(3)
    texts = ["", "a", " ", "ab c", "é,x9", "end", "日本 z"] + ["".join(rng.choice("ab é.\n") for _ in range(rng.randint(0, 30))) for _ in range(50)]
    for size in (5, 1 << 20):
        hashes: dict[str, int] = {}
        for first, end, data, offsets in common.text_slices(pa.array(texts), size):
            w = find_words(data, offsets)
            for i in range(first, end):
                span = slice(w.first[i - first], w.first[i - first + 1])
                found = [bytes(data[a:b]).decode() for a, b in zip(w.start[span], w.end[span])]
                assert found == re.findall("[0-9a-zA-Z\x80-\U0010ffff]+", texts[i])
                assert set(w.text[span].tolist()) <= {i - first}
                for word, h in zip(found, w.hash[span].tolist()):
                    assert hashes.setdefault(word, h) == h
        assert len(set(hashes.values())) == len(hashes)


# -- near-duplicates

def edited(text: str, share: float, rng: random.Random) -> str:
    return " ".join(prose(1, rng.randrange(10**9)) if rng.random() < share else w for w in text.split())


def groups_of(pairs) -> dict[int, int]:
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def near_by_brute_force(prints: np.ndarray, distance: int) -> set[tuple[int, int]]:
    bits = np.unpackbits(prints, axis=1).astype(int)
    return {(i, j) for i, j in itertools.combinations(range(len(prints)), 2) if (bits[i] != bits[j]).sum() <= distance}


def corpus() -> list[str]:
    rng = random.Random(11)
    texts = [prose(120, 1000 + i) for i in range(120)]
    for i in range(40):
        texts += [texts[i], edited(texts[i], 0.01 + 0.04 * rng.random(), rng), edited(texts[i], 0.01 + 0.04 * rng.random(), rng)]
    return texts


def test_fingerprint_against_plain_sum():
    texts = ["One two one", "two ONE", "", " .", "x" * 3000]
    got = simhash_index.fingerprints_of(pa.array(texts))
    assert (got[0] == got[1]).all()
    words = find_words(np.frombuffer(b"one two", np.uint8), np.array([0, 7]))
    bits = [np.unpackbits(np.array([h, simhash_index.mix(np.array([h ^ np.uint64(0x5851F42D4C957F2D)]))[0]]).view(np.uint8)).astype(int) for h in words.hash]
    assert np.unpackbits(got[0]).tolist() == (2 * sum(bits) > 2).astype(int).tolist()
    assert len({bytes(x) for x in got[1:]}) == 4


@pytest.mark.parametrize("distance", [0, 3, 11, 15, 16, 21, 40])
def test_tally_of_pairs_within_the_distance_reaches_the_minimum(distance):
    rng = np.random.default_rng(distance)
    x = np.zeros((2000, 128), np.uint8)
    for row in x:
        row[rng.choice(128, rng.integers(0, distance + 1), replace=False)] = 1
    got = simhash_index.tally(np.packbits(x, axis=1).view(np.int64), distance // 16)
    # by bytes, one at a time
    want = [sum(max(0, distance // 16 + 1 - int(row[8 * k : 8 * k + 8].sum())) for k in range(16)) for row in x]
    assert got.tolist() == want and min(want) >= simhash_index.guaranteed(distance) > 0


def test_the_filter_rejects_what_meets_by_chance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 256, (2, 20_000, 16), dtype=np.uint8)
    b[:, [1, 4, 6]] = a[:, [1, 4, 6]]  # an entry in common
    counts = simhash_index.tally((a ^ b).view(np.int64), 1)
    assert counts.min() >= 6 and (counts >= simhash_index.guaranteed(21)).mean() < 0.001


def test_groups_against_brute_force(spark):
    texts = corpus()
    want = {a: r for a, r in groups_of(near_by_brute_force(simhash_index.fingerprints_of(pa.array(texts)), simhash_index.DISTANCE)).items() if a != r}
    got = {r.doc_id: (r.kept_id, r.group_size) for r in simhash_index.near_duplicates(with_clashes(table_of(spark, texts))).collect()}
    assert {a: k for a, (k, _) in got.items()} == want
    sizes = Counter(want.values())
    assert all(n == sizes[k] + 1 for k, n in got.values())
    # what was planted is found, and nothing else
    planted = {120 + 3 * i + k for i in range(40) for k in range(3)}
    assert set(got) <= planted and len(got) >= 0.97 * len(planted)


def test_a_document_of_several_texts_is_one(spark):
    x, y, z = prose(90, 71), prose(90, 72), prose(90, 73)
    rows = [(1, x), (2, x), (2, y), (2, y), (3, y), (4, z), (5, z), (5, z), (6, prose(90, 74)), (6, prose(90, 75))]
    got = simhash_index.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted(map(tuple, got.collect())) == [(2, 1, 3), (3, 1, 3), (5, 4, 2)]


def test_links_of_long_lists_connect_the_same():
    rng = np.random.default_rng(8)
    center = rng.integers(-(2**62), 2**62, (3, 2))
    rows = np.repeat(center, 30, axis=0) ^ (np.int64(1) << rng.integers(0, 60, (90, 2)))
    entry, node = np.full(90, 5, np.int32), rng.permutation(90).astype(np.int64)
    short = simhash_index.links(entry, node, rows[:, 0], rows[:, 1], 21, short=100)
    forest = simhash_index.links(entry, node, rows[:, 0], rows[:, 1], 21)
    assert groups_of(short.tolist()) == groups_of(forest.tolist())
    assert len(forest) < len(short)


@pytest.mark.parametrize("held", [-1, simhash_index.HELD_EDGES])
def test_components_of_a_chain_and_a_star(spark, held):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in simhash_index.components(spark.createDataFrame(edges, "a bigint, b bigint"), held).collect()}
    assert got == {a: r for a, r in groups_of(edges).items() if a != r}
    assert simhash_index.components(spark.createDataFrame([], "a bigint, b bigint"), held).count() == 0


def test_dedup_on_awkward_rows(spark):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA))
    got = simhash_index.deduplicate(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text is None) for r in got.collect()) == sorted([(False, i, i == 4) for i in (1, 3, 4, 5, 7, 8, 9)] + [(True, 0, False), (True, 0, True)])
    again = simhash_index.deduplicate(spark.createDataFrame([(9, prose(50, 1), "en", "s", 1)] * 3 + [(10, prose(50, 2), "en", "s", 1)], SCHEMA))
    assert sorted(r.doc_id for r in again.collect()) == [9, 10]
    assert simhash_index.deduplicate(df.limit(0)).count() == 0


# -- winnowing

def spans_by_brute_force(d: list[str], q: list[str], least: int) -> set[tuple[int, int, int]]:
    out = set()
    for i in range(len(d)):
        for j in range(len(q)):
            if d[i] == q[j] and not (i and j and d[i - 1] == q[j - 1]):
                n = 0
                while i + n < len(d) and j + n < len(q) and d[i + n] == q[j + n]:
                    n += 1
                if n >= least:
                    out.add((i, j, n))
    return out


@pytest.mark.parametrize(("k", "window"), [(1, 1), (2, 3), (3, 2), (5, 4)])
def test_spans_against_brute_force(k, window):
    rng = random.Random(k)
    tests = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 1, 4, 9, 30)] + [prose(20, 5)]
    docs = [" ".join(rng.choice("abc") for _ in range(n)) for n in (0, 2, 8, 40)] + ["x " + prose(20, 5).upper() + " y"]
    least = k + window - 1
    side = winnow.TestSide(list(range(len(tests))), tests, k, window, least)
    got = defaultdict(set)
    for row, item, i, j, n in side.spans(pa.array(docs)):
        got[row, item].add((i, j, n))
    for row, item in itertools.product(range(len(docs)), range(len(tests))):
        assert got[row, item] == spans_by_brute_force(docs[row].lower().split(), tests[item].lower().split(), least), (row, item)


def test_passes_give_the_same_and_awkward_rows(spark):
    bench = [(1, prose(30, 41)), (2, prose(25, 42)), (2, prose(25, 42)), (None, prose(20, 43)), (4, None), (5, ""), (6, "too short")]
    b = with_clashes(spark.createDataFrame(bench, "id_ bigint, text string").withColumnRenamed("id_", "item_id_")).drop("item_id").withColumnRenamed("item_id_", "item_id")
    leak = "start here " + prose(30, 41)[20:] + " and " + prose(20, 43) + " end"
    df = with_clashes(spark.createDataFrame([*awkward(), (20, leak, "en", "x", 1), (20, leak, "en", "x", 1), (None, leak, None, None, None)], SCHEMA))
    one = sorted(map(str, winnow.contaminated_spans(df, b).collect()))
    many = sorted(map(str, winnow.contaminated_spans(df, b, held_bytes=60).collect()))
    assert one == many and len(one) == 6
    for held in (60, winnow.HELD_BYTES):
        kept = winnow.decontaminate(df, b, held_bytes=held)
        assert kept.columns == df.columns and kept.count() == len(awkward())
    assert winnow.contaminated_spans(df, b.limit(0)).count() == 0 and winnow.contaminated_spans(df.limit(0), b).count() == 0
    with pytest.raises(ValueError):
        winnow.contaminated_spans(df, b, min_span=7)


# -- curriculum

def test_tokens_are_words(spark):
    texts = ["", " ", "a", " a", "a ", "a  b\n\tc", "\n", "é ü"]
    docs = table_of(spark, texts)
    rows = docs.select("text", curriculum.n_tokens(docs["text"]).alias("n"))
    assert {r.text: r.n for r in rows.collect()} == {t: len(t.split()) for t in texts}


def test_positions_invert_the_demand(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * rng.randint(1, 9)), "en", rng.choice("aab"), 0) for i in range(400)]
    plan = {"a": [(0, 3), (0.5, 1), (1, 0)], "b": [(0, 1), (1, 4)]}
    got = curriculum.mix(spark.createDataFrame(rows, SCHEMA), plan, budget=1500).collect()
    assert [r["__position"] for r in got] == sorted(r["__position"] for r in got)

    def weight(s, t):
        a = 3 - 4 * t if t <= 0.5 else 2 - 2 * t
        # the sum of weights is scaled to one at the knots 0, 0.5 and 1, linear between
        at = {0: (3 / 4, 1 / 4), 0.5: (1 / 3.5, 2.5 / 3.5), 1: (0, 1)}
        lo = 0 if t <= 0.5 else 0.5
        f = (t - lo) / 0.5
        k = "ab".index(s)
        return at[lo][k] + (at[lo + 0.5][k] - at[lo][k]) * f

    grid = np.linspace(0, 1, 20001)
    for s in "ab":
        demand = np.concatenate([[0], np.cumsum([(weight(s, x) + weight(s, y)) / 2 * (y - x) for x, y in zip(grid, grid[1:])])]) * 1500
        mine = [r for r in got if r.source == s]
        before = 0
        for r in mine:
            assert r["__position"] == pytest.approx(np.interp(before, demand, grid), abs=2e-3)
            before += r["__tokens"]
        supply = sum(len(t.split()) for _, t, _, x, _ in rows if x == s)
        assert before >= min(supply, demand[-1]) - 1e-6


def test_shares_follow_the_schedule(spark):
    rows = [(i, "one two three", "en", "a" if i % 2 else "b", 0) for i in range(4000)]
    got = curriculum.mix(spark.createDataFrame(rows, SCHEMA), {"a": [(0, 1), (1, 3)], "b": [(0, 3), (1, 1)]}, budget=8000).collect()
    for lo in (0.0, 0.25, 0.5, 0.75):
        part = [r.source for r in got if lo <= r["__position"] < lo + 0.25]
        assert part.count("a") / len(part) == pytest.approx(0.25 + 0.5 * (lo + 0.125), abs=0.01)


@pytest.mark.parametrize("step", [2, 100])
def test_texts_go_straight_to_their_stretch(spark, monkeypatch, step):
    """The same order and positions as from narrow rows, with repeated ids to both sides of an edge, and a plan of one exchange of the text."""
    monkeypatch.setattr(curriculum, "_STEP", step)
    rng = random.Random(4)
    rows = [(i // 3 if i % 7 else 5, f"t{i} " + " ".join("w" * rng.randint(0, 9)), "en", rng.choice([None, "a", "a", "b"]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        mixed = curriculum.mix(df, budget=1700)
        got = mixed.collect()
        ordered = curriculum.training_order(df, budget=1700).collect()
        assert mixed.rdd.getNumPartitions() == 9
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert 300 < len(got) < 900
    assert [(r.doc_id, r.source, r["__tokens"], round(r["__position"], 6)) for r in got] == [tuple(r) for r in ordered]
    plan = mixed._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_NUM") == 1 and "rangepartitioning" not in plan


def test_curriculum_on_awkward_rows(spark):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA))
    got = curriculum.mix(df, budget=10**9).select(*df.columns)
    assert got.count() == len(awkward())
    assert curriculum.mix(df.limit(0)).count() == 0
    assert curriculum.mix(df.filter("text = ''")).count() == 0


# -- shards

def test_matrix_rows_agree_and_are_hypergeometric():
    parts, shards = np.array([5, 0, 9, 6]), np.array([8, 8, 4])
    cells = []
    for seed in range(3000):
        m = np.array([shard.matrix_row(i, parts, shards, seed) for i in range(4)])
        assert (m >= 0).all() and m.sum(axis=1).tolist() == parts.tolist() and m.sum(axis=0).tolist() == shards.tolist()
        cells.append(m)
    cells = np.array(cells)
    assert cells.mean(axis=0) == pytest.approx(np.outer(parts, shards) / 20, abs=0.12)
    n, k, total = 9, 8, 20
    assert cells[:, 2, 0].var() == pytest.approx(n * k / total * (1 - k / total) * (total - n) / (total - 1), rel=0.12)


def test_draws_against_exact_probabilities():
    rng = np.random.default_rng(4)
    for good, bad, n in ((7, 13, 8), (1, 40, 3), (300, 20, 19), (60, 90, 75)):
        total = math.comb(good + bad, n)
        exact = {x: math.comb(good, x) * math.comb(bad, n - x) / total for x in range(max(0, n - bad), min(n, good) + 1)}
        assert all(math.exp(shard.log_probability(x, good, bad, n)) == pytest.approx(p, rel=1e-10) for x, p in exact.items())
        seen = Counter(shard.draw(rng, good, bad, n) for _ in range(8000))
        often = {x: p for x, p in exact.items() if p * 8000 >= 5}
        chi = sum((seen[x] - 8000 * p) ** 2 / (8000 * p) for x, p in often.items())
        assert set(seen) <= set(exact) and chi < len(often) + 5 * math.sqrt(2 * len(often)) + 5
    # the same by multivariate sampling
    sizes = np.array([3, 0, 9, 4, 14])
    a = np.array([shard.split(rng, sizes, 11) for _ in range(6000)])
    b = rng.multivariate_hypergeometric(sizes, 11, 6000)
    assert (a.sum(axis=1) == 11).all() and (a <= sizes).all()
    for j in range(5):
        both = [np.bincount(m[:, j], minlength=15) for m in (a, b)]
        assert ((both[0] - both[1]) ** 2 / np.maximum(both[0] + both[1], 1)).sum() < 45


def test_large_draws_have_the_right_moments():
    rng = np.random.default_rng(4)
    for good, bad, n in ((3_000_000_000, 7_000_000_000, 10_000), (10**11, 10**11, 10**11), (5, 10**12, 10**11)):
        x = np.array([shard.draw(rng, good, bad, n) for _ in range(2000)])
        mean, total = n * good / (good + bad), good + bad
        sd = math.sqrt(mean * (bad / total) * (total - n) / (total - 1))
        assert x.mean() == pytest.approx(mean, abs=5 * sd / 2000**0.5) and x.std() == pytest.approx(sd, rel=0.1)
    assert shard.draw(rng, 2_000_000_000, 0, 5) == 5 and shard.draw(rng, 0, 2_000_000_000, 5) == 0


def test_a_row_of_a_large_matrix_is_quick():
    """10^11 rows in 100,000 partitions for 763,000 receivers."""
    parts, takes = np.full(100_000, 10**6), np.full(762_940, 131_072)
    takes[-1] -= int(takes.sum()) - 10**11
    began = time.process_time()
    row = shard.matrix_row(77_777, parts, takes, 29)
    assert row.sum() == 10**6 and time.process_time() - began < 20
    assert row.std() == pytest.approx(1.31**0.5, rel=0.05)


def test_shards_are_exact_and_uniform(spark, tmp_path):
    spark.range(4000).selectExpr("id as doc_id", "concat('t', id) as text").repartition(5).write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    got = shard.shuffle_into_shards(df, rows_per_shard=500).collect()
    assert sorted(r.doc_id for r in got) == list(range(4000))
    assert Counter(r.shard for r in got) == dict.fromkeys(range(8), 500)
    assert {(r.shard, r.shard_position) for r in got} == {(s, p) for s in range(8) for p in range(500)}
    grid = np.zeros((8, 8))
    for r in got:
        grid[r.doc_id // 500, r.shard] += 1
    assert ((grid - 62.5) ** 2 / 62.5).sum() < 95  # chi-squared of 49 degrees: p < 0.0001 beyond
    again = shard.shuffle_into_shards(df, rows_per_shard=500).collect()
    assert {(r.doc_id, r.shard, r.shard_position) for r in got} == {(r.doc_id, r.shard, r.shard_position) for r in again}


def test_shards_of_awkward_rows(spark):
    df = with_clashes(spark.createDataFrame(awkward(), SCHEMA))
    got = shard.shuffle_into_shards(df, rows_per_shard=5)
    assert got.columns == [*df.columns, "shard_", "shard_position_"]
    rows = got.collect()
    assert Counter(r["shard_"] for r in rows) == {0: 4, 1: 4, 2: 4}
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    assert sorted(map(key, rows)) == sorted(map(key, awkward()))
    assert shard.shuffle_into_shards(df.limit(0)).count() == 0


# -- capture merge

def test_loser_tree_against_sorting():
    rng = random.Random(2)
    for k in range(8):
        streams = [sorted((rng.randrange(20), i) for _ in range(rng.randrange(9))) for i in range(k)]
        assert list(capture_merge.LoserTree([iter(s) for s in streams])) == sorted(x for s in streams for x in s)


@pytest.mark.parametrize("range_bytes", [90, 700, 10**6])
def test_merge_against_sorting(spark, range_bytes):
    rng = random.Random(3)
    urls = [None, "", "http://www.B.com/x?b=2&a=1#f", "https://b.com:443/X/?a=1&b=2", "https://u@sub.b.com/p/", "a.org", "http://a.org/é"]
    pages = [(rng.choice([None, i]), rng.choice(urls), rng.choice(["h1", "h2", None]), rng.choice([None, *range(9)])) for i in range(120)]
    # a third of all are captures of one key; and a very long key
    pages += [(1000 + i, "http://hot.org/", rng.choice(["h1", "h2"]), i // 2) for i in range(60)] + [(7, "http://long.org/" + "x" * 50_000, "h1", 1)] * 2
    pages += pages[:5]
    df = with_clashes(spark.createDataFrame(pages, "page_id bigint, url string, html string, t bigint").repartition(4)).drop("position")
    captures = capture_merge.captures_of(df, df["t"])
    if range_bytes == 90:
        bounds = capture_merge.range_bounds(captures, range_bytes, 100)
        assert bounds == sorted(bounds) and sum(k == "org,hot)/" for k, _ in bounds) > 3
    got = sorted(capture_merge.merge_runs(captures, range_bytes, 100).collect(), key=lambda r: r.position)
    low = lambda v: -1 if v is None else v
    keys = [(r.urlkey.encode(), low(r.ts), low(r.page_id), r.digest or "") for r in got]
    assert keys == sorted(keys) and [r.position for r in got] == list(range(len(pages)))
    assert Counter((r.url, r.ts, r.page_id) for r in got) == Counter((u, t, i) for i, u, _, t in pages)
    history = defaultdict(list)
    for r in got:
        history[r.urlkey].append(r)
    assert set(history) == {")/", "com,b)/x?a=1&b=2", "com,b,sub)/p", "org,a)/", "org,a)/é", "org,hot)/", "org,long)/" + "x" * 50_000}
    for rows in history.values():
        assert [r.capture_no for r in rows] == list(range(1, len(rows) + 1))
        assert [r.revisit for r in rows] == [False] + [b.digest is not None and a.digest == b.digest for a, b in zip(rows, rows[1:])]
    assert any(r.revisit for r in history["org,hot)/"])
    assert capture_merge.merge_runs(capture_merge.captures_of(df.limit(0), df["t"])).count() == 0


# -- pipeline

def test_stages_keep_columns_and_take_effect(spark):
    docs = common.table(spark, SAMPLE, "documents")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out, _ = common.persist_table(stage(spark, docs, SAMPLE), f"test-{name}")
        assert set(docs.columns) <= set(out.columns)
        assert name == "shards" or out.columns == docs.columns
        assert out.join(docs, "doc_id", "left_anti").count() == 0
        counts.append(out.count())
        docs = out
    assert counts[0] > counts[1] > counts[2] > counts[3] >= counts[4] == counts[5] > 0.5 * counts[0]
    ran = corpus_pipeline.run(spark, SAMPLE)
    assert sorted((r.doc_id, r.shard, r.shard_position) for r in ran.collect()) == sorted((r.doc_id, r.shard, r.shard_position) for r in docs.collect())


def test_pipeline_on_awkward_rows(spark):
    docs = with_clashes(spark.createDataFrame(awkward() * 2, SCHEMA)).drop("__again")
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = common.persist_table(stage(spark, docs, SAMPLE), f"test-{name}")
        empty, _ = common.persist_table(stage(spark, docs.limit(0).drop("shard_", "shard_position_"), SAMPLE), f"test-{name}")
        assert empty.count() == 0
