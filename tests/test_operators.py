"""Operators beside the language, on small tables with known answers."""

from __future__ import annotations

import bisect
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polymere.functions import geometry as G
from polymere.functions import text as T
from polymere.operators import graph, kv, rdf, search, security, series, spatial, statistics, vector
from polymere.operators import relational as R
from polymere.queries import models
from polymere.sources import files
from polymere.streaming import windows as stream


# -- relational


def test_salted_and_range_joins_equal_plain_ones(spark):
    rng = random.Random(1)
    a = spark.createDataFrame([(i, rng.choice([1, 1, 1, 2, 3, None]), rng.uniform(0, 20)) for i in range(300)], "id bigint, k bigint, x double")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (2, "r"), (None, "s")], "kk bigint, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(R.salted_join(a, b, "k", "kk", 4)) == rows(a.join(b, a.k == b.kk))
    bands = spark.createDataFrame([(0.0, 5.0, "lo"), (4.0, 11.5, "mid"), (7.0, 7.0, "none")], "l double, h double, name string")
    assert rows(R.range_join(a, bands, "x", "l", "h", 3.0)) == rows(a.join(bands, (a.x >= bands.l) & (a.x < bands.h)))


# -- key-value


def test_live_pairs_follow_a_plain_dictionary(spark):
    rng = random.Random(3)
    log = [(rng.choice("abcde"), rng.choice(["", None, "1", "2", "3"]), i) for i in range(60)]
    held: dict = {}
    for k, v, _ in log:
        held[k] = v
        if not v:
            del held[k]
    df = spark.createDataFrame(log, "key string, value string, seq int")
    assert dict(map(tuple, kv.live(df).collect())) == held
    assert dict(map(tuple, kv.range_scan(df, "b", "d").collect())) == {k: v for k, v in held.items() if "b" <= k < "d"}
    assert kv.live(df.limit(0)).count() == 0
    s = kv.compaction_stats(df).first()
    assert (s.rows_before, s.rows_after) == (60, len(held))


def test_versions_conflicts_and_recovery(spark):
    v = kv.versions(spark.createDataFrame([("a", 1, 10), ("a", 2, 20), ("b", 5, 15)], "k string, v int, ts int"), "k", "ts")
    assert {(r.k, r.v) for r in kv.read_at(v, 19).collect()} == {("a", 1), ("b", 5)}
    assert {(r.k, r.v) for r in kv.collect_garbage(v, 20).collect()} == {("a", 2), ("b", 5)}
    w = spark.createDataFrame([(1, "x", 0, 5), (2, "x", 3, 9), (3, "x", 9, 12), (3, "y", 9, 12)], "txn int, key string, read_ts int, commit_ts int")
    assert dict(map(tuple, kv.conflicts(w).collect())) == {1: False, 2: True, 3: False}
    log = [(1, 1, "write", "a", "1"), (2, 2, "write", "a", "2"), (3, 1, "commit", None, None), (4, 3, "write", "b", "3"), (5, 3, "abort", None, None)]
    assert [tuple(r) for r in kv.recover(spark.createDataFrame(log, "lsn int, txn int, kind string, key string, value string")).collect()] == [("a", "1")]


# -- series


def test_gaps_are_interpolated_and_as_of_reads_the_last(spark):
    w = spark.createDataFrame([(0, 0.0), (3, 6.0)], "h int, v double").select(F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,h)").alias("window_start"), "v")
    w = w.select("window_start", (F.col("window_start") + F.expr("INTERVAL 1 HOUR")).alias("window_end"), "v")
    assert [r.v for r in series.fill_gaps(w, 3_600_000, []).orderBy("window_start").collect()] == [0.0, 2.0, 4.0, 6.0]
    assert [r.v for r in series.fill_gaps(w, 3_600_000, [], "previous").orderBy("window_start").collect()] == [0.0, 0.0, 0.0, 6.0]
    a = spark.createDataFrame([("x", 5), ("x", 1), ("y", 9)], "k string, t int")
    b = spark.createDataFrame([("x", 2, "old"), ("x", 5, "new")], "k string, u int, v string")
    assert {tuple(r) for r in series.as_of_join(a, b, ["k"], "t", "u", ["v"]).collect()} == {("x", 5, "new"), ("x", 1, None), ("y", 9, None)}


# -- graphs


def test_breadth_first_search_against_a_queue(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(45)]
    depth = {0: 0}
    queue = [0]
    for n in queue:
        for a, b in pairs:
            if a == n and b not in depth and depth[n] < 4:
                depth[b] = depth[n] + 1
                queue.append(b)
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    assert {r.id: r.depth for r in graph.bfs(edges, 0, 4).collect()} == depth
    assert [tuple(r) for r in graph.bfs(edges, 99, 3).collect()] == [(0, 99)]


# -- search


@pytest.mark.parametrize(
    "word, stem",
    [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopeful", "hope"), ("adjustment", "adjust"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("roll", "roll"), ("is", "is")],
)
def test_stems(word, stem):
    assert T.stem(word) == stem


def test_search_ranks_and_marks(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog"), (2, "Dogs running, running dogs"), (3, "quick quick foxes"), (4, ""), (5, None)], "doc_id bigint, text string")
    ix = search.index(docs)
    assert [r.doc_id for r in search.tf_idf(ix, "quick fox").collect()] == [3, 1]
    assert {r.doc_id for r in search.tf_idf(ix, "fox dog", "or").collect()} == {1, 2, 3}
    assert search.tf_idf(ix, "the of").count() == 0
    assert [r.doc_id for r in search.bm25(ix, "dog").collect()] == [2, 1]
    assert [r.doc_id for r in search.phrase(search.index(docs, positions=True), "brown fox").collect()] == [1]
    assert [r.doc_id for r in search.fuzzy_search(ix, "quack", 1).orderBy("doc_id").collect()] == [1, 3]
    top = search.ranked(ix, docs, "foxes", 0, 5).collect()
    assert {r.doc_id: r.snippet for r in top}[3] == "...<mark>foxes</mark>"
    assert T.snippet("a dog and a cat and a cat", ["cat"], 9) == "...<mark>cat</mark> and a..."
    assert T.snippet("none", ["cat"]) is None


def test_salted_join_sends_no_repeated_side_to_all_tasks(spark, tmp_path):
    spark.range(500).write.parquet(str(tmp_path / "small"))
    left = spark.range(4000).select((F.col("id") % 7).alias("k"), "id")
    joined = R.salted_join(left, spark.read.parquet(str(tmp_path / "small")).withColumnRenamed("id", "key"), "k", "key", 8)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and joined.count() == 4000


# -- vectors


def test_nearest_to_all_against_one_by_one(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4), (41, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return sum(x * y for x, y in zip(a, b)) / n if n else 0.0

    want = {i: [j for j, _ in sorted(((j, round(cos(v, u), 9)) for j, u in rows if u), key=lambda p: (-p[1], p[0]))[:3]] for i, v in rows if v}
    for held in (1 << 20, 200):
        got: dict = {}
        for r in vector.nearest_to_all(df, df, 3, held_bytes=held).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        assert got == want


def test_a_task_holds_and_sends_its_best_only(spark, monkeypatch):
    """Ties go to the least ids across blocks and batches, and a task sends k rows for a query however many batches it has."""
    rng = random.Random(9)
    s = np.array([[rng.choice([0.1, 0.5, 0.9]) for _ in range(30)] for _ in range(7)])
    row, ids, value = vector._best(s, np.arange(30) * 3, 4)
    want = [(i, j * 3, v) for i in range(7) for j, v in sorted(enumerate(s[i]), key=lambda p: (-p[1], p[0]))[:4]]
    assert list(zip(row.tolist(), ids.tolist(), value.tolist())) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        df = spark.createDataFrame([(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(200)], "vec_id bigint, embedding array<float>").coalesce(1)
        q = df.filter("vec_id % 20 = 0")
        got = vector.nearest_to_all(q, df, 3)
        wider = vector.nearest_to_all(q, df, 200).filter("rank <= 3")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wider.collect()))
        # what is exchanged, before it is ranked
        monkeypatch.setattr(type(df), "withColumn", lambda self, *a: self.withColumns({"rank": F.lit(1)}))
        assert vector.nearest_to_all(q, df, 3).count() == 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_queries_of_cells_are_passed_by_what_they_look_into(spark, monkeypatch):
    rng = random.Random(10)
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(400)], "vec_id bigint, embedding array<float>")
    ix, held = vector.build_cells(df), []
    want = sorted(map(tuple, vector.search_cells(ix, df, 5, probes=20).collect()))
    # all cells are looked into, so the best are those of all rows; a task sends its own only
    assert want == sorted(map(tuple, vector.nearest_to_all(df, df, 5).collect()))
    with monkeypatch.context() as m:
        m.setattr(type(df), "withColumn", lambda self, *a: self.withColumns({"rank": F.lit(1)}))
        tasks = vector.CellIndex(ix.rows.coalesce(1), ix.centers, ix.probes)
        assert vector.search_cells(tasks, df, 5, probes=20).count() == 400 * 5
    real = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda v: held.append(v[1].nbytes + v[2].nbytes) or real(v))
    assert sorted(map(tuple, vector.search_cells(ix, df, 5, probes=20, held_bytes=60_000).collect())) == want
    assert len(held) == 4 and max(held) < 24_000


# -- space

SQUARE, INNER, APART = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON ((1 1, 2 1, 2 2, 1 2, 1 1))", "POLYGON ((9 9, 10 9, 10 10, 9 10, 9 9))"
NEXT, OVER = "POLYGON ((4 0, 8 0, 8 4, 4 4, 4 0))", "POLYGON ((2 2, 6 2, 6 6, 2 6, 2 2))"
RING = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"


@pytest.mark.parametrize(
    "name, a, b, want",
    [
        ("contains", SQUARE, INNER, True), ("contains", INNER, SQUARE, False), ("contains", SQUARE, "POINT (1 1)", True), ("contains", SQUARE, "POINT (0 1)", False), ("contains", SQUARE, OVER, False),
        ("contains", RING, "POINT (4 4)", False), ("contains", RING, "POINT (1 1)", True), ("contains", "LINESTRING (0 0, 4 0)", "POINT (2 0)", True), ("intersects", SQUARE, NEXT, True), ("intersects", SQUARE, APART, False),
        ("intersects", "LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", True), ("intersects", "MULTIPOINT ((9 9), (1 1))", SQUARE, True), ("intersects", "POINT EMPTY", SQUARE, False), ("touches", SQUARE, NEXT, True), ("touches", SQUARE, OVER, False),
        ("touches", SQUARE, "POINT (0 1)", True), ("touches", "LINESTRING (0 0, 1 1)", "LINESTRING (1 1, 2 0)", True), ("crosses", "LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)", True), ("crosses", "LINESTRING (-1 1, 5 1)", SQUARE, True), ("crosses", "LINESTRING (1 1, 2 2)", SQUARE, False),
        ("overlaps", SQUARE, OVER, True), ("overlaps", SQUARE, INNER, False), ("overlaps", SQUARE, NEXT, False), ("equals", SQUARE, "POLYGON ((4 4, 0 4, 0 0, 4 0, 4 4))", True), ("equals", SQUARE, INNER, False),
    ],
)
def test_predicates(name, a, b, want):
    assert getattr(G, name)(G.parse(a), G.parse(b)) is want


def test_distances_and_buffers():
    d = lambda a, b: G.distance(G.parse(a), G.parse(b))
    assert d("POINT (0 0)", "POINT (3 4)") == 5 and d("POINT (6 2)", SQUARE) == 2 and d("POINT (1 1)", SQUARE) == 0
    assert d("LINESTRING (0 0, 2 2)", "LINESTRING (0 2, 2 0)") == 0 and d("POINT EMPTY", SQUARE) == math.inf
    assert G.bounds(G.parse(G.buffer(SQUARE, 1))) == (-1, -1, 5, 5) and G.buffer(SQUARE, 0) == SQUARE
    assert len(G.vertices(G.parse(G.buffer("POINT (0 0)", 2))[0])) == 17
    with pytest.raises(G.GeometryError):
        G.parse("CIRCLE (1 1)")


def test_geohash_projection_and_joins(spark):
    row = spark.range(1).select(spatial.encode_geohash(F.lit(57.64911), F.lit(10.40744), 11).alias("g")).first()
    assert row.g == "u4pruydqqvj"
    x, y = spatial.to_web_mercator(F.lit(12.5), F.lit(-33.25))
    lon, lat = spatial.from_web_mercator(x, y)
    back = spark.range(1).select(lon.alias("lon"), lat.alias("lat")).first()
    assert back.lon == pytest.approx(12.5) and back.lat == pytest.approx(-33.25)
    rng = random.Random(6)
    p = [(i, rng.uniform(-9, 9), rng.uniform(-9, 9)) for i in range(120)]
    a, b = (spark.createDataFrame(p, f"{n} int, {n}x double, {n}y double") for n in "ab")
    want = {(i, j) for i, u, v in p for j, s, t in p if math.hypot(u - s, v - t) <= 1.5}
    assert {(r.a, r.b) for r in spatial.distance_join(a, b, "ax", "ay", "bx", "by", 1.5).collect()} == want
    shapes = spark.createDataFrame([(1, SQUARE), (2, OVER), (3, APART), (4, None)], "id int, g string")
    met = spatial.geometry_join(shapes, shapes.toDF("id2", "g2"), "g", "g2", spatial.st_intersects, 1.5).collect()
    assert sorted((r.id, r.id2) for r in met) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]


def test_joins_of_classes_lose_no_pair(spark, tmp_path):
    """All pairs of ids come back from pairs of classes and members, and rows at a place make no pairs."""
    spark.range(1500).select((F.col("id") % 50 * 6120 + F.col("id") / 50 % 30 * 97).cast("bigint").alias("c_custkey")).distinct().write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(600).select((F.col("id") % 20 * 5100 + F.col("id") / 20 % 30 * 61).cast("bigint").alias("s_suppkey")).distinct().write.parquet(f"{tmp_path}/supplier.parquet")
    at = {k: (k * 37 % 360 - 180, k * 17 % 170 - 85) for (k,) in spark.read.parquet(f"{tmp_path}/customer.parquet").collect()}
    boxes = {k: (k * 53 % 340 - 170, k * 29 % 150 - 75) for (k,) in spark.read.parquet(f"{tmp_path}/supplier.parquet").collect()}

    def members(rows, kind):
        held: dict = {}
        for r in rows:
            if r.kind == kind:
                held.setdefault(r.a, []).append(r.b)
        return held

    got = models.spatial_distance_join(spark, str(tmp_path)).collect()
    same = members(got, "member")
    assert sum(map(len, same.values())) == len(at) and len(got) < 5 * len(at)
    pairs = {(min(i, j), max(i, j)) for r in got if r.kind == "pair" for i in same[r.a] for j in same[r.b]} | {(i, j) for m in same.values() for i in m for j in m if i < j}
    assert pairs == {(i, j) for i, (x, y) in at.items() for j, (u, v) in at.items() if i < j and math.hypot(x - u, y - v) <= 5}
    got = models.spatial_geometry_join(spark, str(tmp_path)).collect()
    left, right = members(got, "box"), members(got, "point")
    assert sum(map(len, left.values())) == len(boxes) and sum(map(len, right.values())) == len(at) and len(got) < 5 * len(at)
    assert {(i, j) for r in got if r.kind == "pair" for i in left[r.a] for j in right[r.b]} == {(i, j) for i, (u, v) in boxes.items() for j, (x, y) in at.items() if u < x < u + 9 and v < y < v + 6}


# -- triples


def test_sparql_joins_and_filters(spark):
    t = spark.createDataFrame([("<a>", "<knows>", "<b>"), ("<b>", "<knows>", "<c>"), ("<a>", "<age>", '"30"^^<int>'), ("<b>", "<age>", '"25"^^<int>'), ("<c>", "<age>", '"old"'), ("<a>", "<knows>", "<a>")], "s string, p string, o string")
    q = lambda text: sorted(map(tuple, rdf.select(t, text).collect()), key=str)
    assert q("SELECT ?x ?z WHERE { ?x <knows> ?y . ?y <knows> ?z . }") == [("<a>", "<a>"), ("<a>", "<b>"), ("<a>", "<c>")]
    assert q("select ?x where { ?x <age> ?n FILTER(?n > 26) }") == [("<a>",)]
    assert q('SELECT ?x WHERE { ?x <age> ?n . FILTER(?n = "old") }') == [("<c>",)]
    assert q("SELECT ?x WHERE { ?x <knows> ?x }") == [("<a>",)]
    assert q("SELECT ?x ?no WHERE { ?x <age> ?n } LIMIT 1")[0][1] is None
    assert rdf.remove(rdf.insert(t, t), t.limit(0)).count() == 6
    with pytest.raises(rdf.SparqlError):
        rdf.parse("SELECT WHERE { }")


# -- security


def test_masks_chains_and_roots(spark):
    df = spark.createDataFrame([(1, "secret", "d"), (2, "", "d"), (3, None, "d")], "i int, v string, day string")
    m = [tuple(r) for r in df.orderBy("i").select(security.mask_full(F.col("v")), security.mask_partial(F.col("v"), 1, 2), security.mask_hash(F.col("v"))).collect()]
    assert m[0][:2] == ("******", "s***et") and m[1][:2] == ("*", "*") and m[2] == (None, None, None)
    made = security.chain(df, "i", ["v"], "day")
    assert security.broken_links(made, "i", ["v"], "day").count() == 0
    forged = made.withColumn("v", F.when(F.col("i") == 2, "changed").otherwise(F.col("v")))
    assert [r.i for r in security.broken_links(forged, "i", ["v"], "day").collect()] == [2]
    import hashlib

    h = [hashlib.sha256(x.encode()).hexdigest() for x in "abc"]
    top = hashlib.sha256((hashlib.sha256((h[0] + h[1]).encode()).hexdigest() + h[2]).encode()).hexdigest()
    leaves = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i int, v string")
    assert tuple(security.merkle_root(leaves, "i", "v").first()) == (top, 3)
    held = df.select("i", security.encrypt(F.col("v"), "0123456789abcdef").alias("e"))
    assert [r[0] for r in held.orderBy("i").select(security.decrypt(F.col("e"), "0123456789abcdef")).collect()] == ["secret", "", None]
    assert [r[0] for r in held.orderBy("i").select(security.decrypt(F.col("e"), "another-key-1234")).collect()] == [None, None, None]


# -- statistics, files, streams


def test_cuts_of_histograms_are_exact(spark):
    rng = random.Random(8)
    for values, buckets in (([rng.gauss(0, 1) for _ in range(60_000)], 20), ([rng.choice([1.0, 2.0, 2.5]) for _ in range(900)] + [None] * 7, 8), ([4.0], 5)):
        held = sorted(v for v in values if v is not None)
        cuts = sorted({held[math.ceil(i / buckets * len(held)) - 1] for i in range(1, buckets + 1)})
        want: dict = {}
        for v in held:
            want.setdefault(bisect.bisect_left(cuts, v), []).append(v)
        df = spark.createDataFrame([(v,) for v in values], "v double")
        assert sorted(map(tuple, statistics.histogram(df, "v", buckets).collect())) == [(b, vs[0], vs[-1], len(vs)) for b, vs in sorted(want.items())]
    assert statistics.histogram(df.filter("v < 0"), "v", 3).collect() == []


def test_sketches_and_histograms(spark):
    df = spark.range(20_000).withColumn("g", F.col("id") % 4)
    assert abs(statistics.distinct_estimate(df, "id", by="g").first()[0] - 20_000) < 600
    rows = statistics.histogram(df, "id", 10).collect()
    assert sum(r.n for r in rows) == 20_000 and all(abs(r.n - 2000) < 50 for r in rows)
    assert statistics.encoding_advice(df.withColumn("v", F.col("id") * 1000), "v", "id").first()[0] == "delta_of_delta"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,f,b,s,m,q\n1,1.5,true,x,1,"a, b"\n-2,2,False,,true,"line\nend"\n,,,,,\n')
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert [f.dataType.simpleString() for f in df.schema] == ["bigint", "double", "boolean", "string", "string", "string"]
    assert [tuple(r) for r in df.collect()][1] == (-2, 2.0, False, None, "true", "line\nend")
    t = pa.table({"x": [1, 2], "y": ["a", None], "z": [0, 0]})
    with pa.OSFile(str(tmp_path / "t.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert sorted(map(tuple, files.read_arrow(spark, str(tmp_path / "t.arrow"), "y string, x bigint").collect()), key=str) == [("a", 1), (None, 2)]
    files.write_parquet(spark.range(10).withColumn("p", F.col("id") % 2), str(tmp_path / "out"), ["p"], ["id"])
    assert files.read_parquet(spark, str(tmp_path / "out"), ["id"]).count() == 10


def test_stream_gives_the_batch_windows(spark, tmp_path):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b"), ("2024-01-01 01:10:00", "b")], "t string, k string").select(F.col("t").cast("timestamp_ntz").alias("ts"), "k")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = stream.read_files(spark, str(tmp_path / "in"), e)
    w = stream.windowed(s, "tumbling", [3_600_000], "ts", ["k"], [F.count("*").alias("n")], "1 hour")
    stream.run_available(w, "windows_test", str(tmp_path / "c1"), "complete")
    batch = series.windowed(e, "tumbling", [3_600_000], F.col("ts"), [F.col("k")], [F.count("*").alias("n")])
    assert sorted((r.k, r.n) for r in spark.table("windows_test").collect()) == sorted((r.k, r.n) for r in batch.collect())
    stream.run_available(stream.distinct_events(s, "ts", ["k", "ts"], "1 hour"), "distinct_test", str(tmp_path / "c2"))
    assert spark.table("distinct_test").count() == 3
