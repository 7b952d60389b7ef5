"""Formats, proofs, chains, indexes and geometry on small tables with known answers, beside the registered queries."""

from __future__ import annotations

import hashlib
import json
import math
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polymere.engine import Engine
from polymere.functions import geometry as G
from polymere.functions.hashes import fnv1a
from polymere.operators import documents, graph, kv, rdf, search, security, spatial, vector
from polymere.queries import more
from polymere.sources import files, triples

SHAPES = [
    "POINT (1 2)", "MULTIPOINT ((1 2), (3 4))", "LINESTRING (0 0, 1.5 2)", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
    "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))", "GEOMETRYCOLLECTION EMPTY",
]


@pytest.mark.parametrize("text", SHAPES)
def test_shapes_by_bytes_and_json(text):
    parts = G.parse(text)
    assert G.to_wkt(parts) == text
    assert G.from_wkb(G.to_wkb(parts)) == parts and G.from_geojson(G.to_geojson(parts)) == parts
    big = bytes.fromhex("0000000001" + "3ff0000000000000" + "4000000000000000")
    assert G.from_wkb(big) == G.parse("POINT (1 2)")


def test_what_is_no_shape(spark):
    for bad in (b"", b"\x01\x09\x00\x00\x00", G.to_wkb(G.parse("POINT (1 2)")) + b"x", G.to_wkb(G.parse("LINESTRING (0 0, 1 1)"))[:-1]):
        with pytest.raises(G.GeometryError):
            G.from_wkb(bad)
    for bad in ("", "[]", '{"type": "Circle"}', '{"type": "Point", "coordinates": ["x", 1]}'):
        with pytest.raises(G.GeometryError):
            G.from_geojson(bad)
    row = spark.createDataFrame([("POINT (1 2)",), ("nothing",), (None,)], "g string").select(spatial.wkt_to_geojson("g").alias("j")).collect()
    assert [r.j and json.loads(r.j)["type"] for r in row] == ["Point", None, None]


@pytest.mark.parametrize("turn", [lambda x, y: (x, y), lambda x, y: (y, x), lambda x, y: (x + y, y - x)])
def test_lines_in_every_direction(turn):
    line = lambda *p: G.parse("LINESTRING (" + ", ".join("{} {}".format(*turn(*q)) for q in p) + ")")
    a, b, c, d = line((0, 0), (2, 0)), line((1, 0), (3, 0)), line((2, 0), (4, 0)), line((1, -1), (1, 1))
    assert (G.crosses(a, b), G.overlaps(a, b), G.touches(a, b)) == (False, True, False)
    assert (G.crosses(a, c), G.overlaps(a, c), G.touches(a, c)) == (False, False, True)
    assert (G.crosses(a, d), G.overlaps(a, d), G.touches(a, d)) == (True, False, False)


def test_boxes_and_geohash_bounds(spark):
    b = lambda *v: spatial.box(*[F.lit(float(x)) for x in v])
    p, q = b(0, 0, 2, 2), b(5, 6, 7, 8)
    r = spark.range(1).select(spatial.box_contains(p, b(0, 0, 1, 2)).alias("c"), spatial.box_intersects(p, q).alias("i"), spatial.box_area(spatial.box_union(p, q)).alias("u"), spatial.box_distance(p, q).alias("d"), spatial.geohash_bounds(F.lit("u4pruydqqvj")).alias("g")).first()
    assert (r.c, r.i, r.u, r.d) == (True, False, 56.0, 5.0)
    assert r.g.min_lat <= 57.64911 <= r.g.max_lat and r.g.min_lon <= 10.40744 <= r.g.max_lon
    assert spark.range(1).select(spatial.decode_geohash(F.lit(None).cast("string")).alias("g")).first().g is None


def test_hash_of_bytes(spark):
    def plain(data: bytes) -> int:
        h = 0xCBF29CE484222325
        for x in data:
            h = (h ^ x) * 0x100000001B3 % 2**64
        return h - 2**64 if h >= 2**63 else h

    texts = ["", "a", "foobar", "é 日本", "x" * 500, None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fnv1a(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [None if t is None else plain(t.encode()) for t in texts]


def test_turtle_and_lines(spark, tmp_path):
    text = """@prefix ex: <http://e/> . PREFIX : <http://d/>
@base <http://b/> .
ex:a a ex:B ; :p 1 , 2.5, -3e4, true, "x"@en-GB, "y"^^ex:t ; ex:q [ ex:r 'it''s' ] .  # a comment
<u> ex:s \"\"\"l"q
\"\"\", _:b1 ."""
    with pytest.raises(triples.TurtleError):
        list(triples.parse_turtle(text))  # two quotes together are two texts
    got = list(triples.parse_turtle(text.replace("'it''s'", "'its'")))
    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert got[0] == ("<http://e/a>", "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://e/B>")
    assert [o for s, p, o in got if p == "<http://d/p>"] == [f'"1"^^<{xsd}integer>', f'"2.5"^^<{xsd}decimal>', f'"-3e4"^^<{xsd}double>', f'"true"^^<{xsd}boolean>', '"x"@en-GB', '"y"^^<http://e/t>']
    assert ("_:anon1", "<http://e/r>", '"its"') in got and ("<http://b/u>", "<http://e/s>", '"l\\"q\\n"') in got and got[-1][2] == "_:b1"
    for bad in ("ex:a ex:b ex:c .", "<a> <b> .", "<a> <b> <c>", "<a> <b> (1 2) ."):
        with pytest.raises(triples.TurtleError):
            list(triples.parse_turtle(bad))
    lines = spark.createDataFrame([('<a> <b> "c d"@en .',), ("# note",), ("",), ("_:x <b> <c> . # end",), ("no triple",), ('<a> <b> "open .',)], "value string")
    assert {tuple(r) for r in triples.parse_ntriples(lines).collect()} == {("<a>", "<b>", '"c d"@en'), ("_:x", "<b>", "<c>")}
    assert triples.bad_lines(lines).count() == 2
    t = spark.createDataFrame([("<a>", "<b>", f'"{i}"') for i in range(5)] + [("_:n", "<b>", "<c>"), ("<a>", "<z>", "<c>")], "s string, p string, o string")
    triples.write_turtle(t.coalesce(1), str(tmp_path / "t"))
    back = triples.read_turtle(spark, str(tmp_path / "t")).collect()
    assert sorted((r.p, r.o) for r in back) == sorted((r.p, r.o) for r in t.collect())


def test_sparql_numbers_names_and_order(spark):
    t = spark.createDataFrame([("<a>", "<n>", '"9007199254740993"'), ("<b>", "<n>", '"9007199254740992"'), ("<a>", "<q>", "<c>"), ("<c>", "<r>", "<b>")], "s string, p string, o string")
    q = lambda text: sorted(map(tuple, rdf.select(t, text).collect()))
    assert q("SELECT ?x WHERE { ?x <n> ?v FILTER(?v > 9007199254740992) }") == [("<a>",)]
    assert q("SELECT ?x ?X WHERE { ?x <q> ?X }") == [("<a>", "<c>")]
    with pytest.raises(rdf.SparqlError):
        q("SELECT ?x WHERE { ?x <n> ?v FILTER(?v > many) }")
    patterns = rdf.parse("SELECT * WHERE { ?a <p> ?b . ?c <q> ?d . ?b <r> ?c }").patterns
    bound: set = set()
    for i, p in enumerate(rdf.joined_order(patterns)):
        names = {x for x in p if x[:1] == "?"}
        assert not i or names & bound
        bound |= names


def test_chains_can_be_pruned_and_consistent_forgeries_show(spark):
    log = spark.createDataFrame([(i, f"v{i}", "ab"[i % 2]) for i in range(12)], "i int, v string, w string")
    made = security.chain(log, "i", ["v"], "w")
    want, last = {}, {"a": "", "b": ""}
    for i in range(12):
        w = "ab"[i % 2]
        content = hashlib.sha256(f"{len(str(i))}:{i}{len(f'v{i}')}:v{i}".encode()).hexdigest()
        want[i] = (last[w], hashlib.sha256((last[w] + content).encode()).hexdigest())
        last[w] = want[i][1]
    assert {r.i: (r.prev_hash, r.entry_hash) for r in made.collect()} == want
    assert {(r.w, r["head"], r.entries) for r in security.heads(made, "i", "w").collect()} == {("a", last["a"], 6), ("b", last["b"], 6)}
    # the forger makes entry 4's hash anew and mends entry 6's link
    content = security._entry_hash(F.col("prev_hash"), "i", ["v"])
    forged = made.withColumn("v", F.when(F.col("i") == 4, "x").otherwise(F.col("v"))).withColumn("entry_hash", F.when(F.col("i") == 4, content).otherwise(F.col("entry_hash")))
    new = forged.filter("i = 4").first().entry_hash
    mended = forged.withColumn("prev_hash", F.when(F.col("i") == 6, new).otherwise(F.col("prev_hash")))
    assert [r.i for r in security.broken_links(mended, "i", ["v"], "w").collect()] == [6]
    kept, anchors = security.prune(made, "i", "w", 5)
    assert security.broken_links(kept, "i", ["v"], "w", anchors).count() == 0
    assert security.broken_links(kept, "i", ["v"], "w").count() == 2
    assert security.broken_links(made.filter("i <> 6"), "i", ["v"], "w").count() == 1
    assert {r.i for r in security.entries(made, "a", "v4", "w", "v").collect()} == {4}
    two = spark.createDataFrame([(1, "a:", "b", "s"), (2, None, "", "s"), (3, "", None, "s")], "i int, x string, y string, s string")
    assert len({r.h for r in two.select(security._content_hash("i", ["x", "y"]).alias("h")).collect()}) == 3


@pytest.mark.parametrize("n", [1, 2, 3, 7, 1024, 1025])
def test_proofs(spark, n):
    leaves = spark.range(n).selectExpr("id", "concat('v', id) as v")
    h = [hashlib.sha256(f"v{i}".encode()).hexdigest() for i in range(n)]
    while len(h) > 1:
        h = [hashlib.sha256("".join(h[k : k + 2]).encode()).hexdigest() if k + 1 < len(h) else h[k] for k in range(0, len(h), 2)]
    assert security.merkle_root(leaves, "id", "v").first().root == h[0]
    for leaf in {0, n - 1}:
        proof = security.merkle_proof(leaves, "id", "v", leaf)
        assert security.merkle_verify(F.lit(f"v{leaf}"), proof).first().root == h[0]
        assert security.merkle_verify(F.lit("other"), proof).first().root != h[0]
    with pytest.raises(ValueError):
        security.merkle_proof(leaves, "id", "v", n)


def test_json_arrays_and_footers(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 'a"b'), (2, 0.5, None)], "i int, x double, s string").coalesce(1)
    files.write_json_array(df, str(tmp_path / "a"))
    text = next((tmp_path / "a").glob("*.txt")).read_text()
    assert json.loads(text) == [{"i": 1, "x": None, "s": 'a"b'}, {"i": 2, "x": 0.5, "s": None}]
    files.write_json_array(df.limit(0), str(tmp_path / "b"))
    assert "[]" in {p.read_text().strip() for p in (tmp_path / "b").glob("*.txt")} and files.read_json_array(spark, str(tmp_path / "b"), "i int").count() == 0
    files.write_ndjson(df, str(tmp_path / "c"))
    assert [json.loads(line) for line in next((tmp_path / "c").glob("*.json")).read_text().splitlines()][0]["x"] is None
    files.write_csv(df, str(tmp_path / "d"))
    assert next((tmp_path / "d").glob("*.csv")).read_text().splitlines()[1] == '1,NaN,"a""b"'
    files.write_parquet(spark.range(1000).coalesce(1), str(tmp_path / "p"), compression="snappy")
    m = files.parquet_metadata(spark, str(tmp_path / "p")).first()
    assert (m.rows, m.columns, m.codec, m.has_statistics) == (1000, 1, "SNAPPY", True) and m.row_groups == 1


def test_blobs_are_kept_while_something_refers_to_them(spark):
    empty = spark.createDataFrame([], "digest string, content binary, refs bigint")
    store, first = documents.put(empty, spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "k int, c string"), "k", "c")
    assert {(r.key, r.was_new) for r in first.collect()} == {(1, True), (2, False), (3, True)}
    store, second = documents.put(store, spark.createDataFrame([(5, "y"), (6, "z")], "k int, c string"), "k", "c")
    assert {(r.key, r.was_new) for r in second.collect()} == {(5, False), (6, True)}
    assert tuple(documents.blob_stats(store).first()) == (3, 5, 3, 2)
    gone = store.filter("refs = 1").select("digest", F.lit(-1).alias("by"))
    assert tuple(documents.blob_stats(documents.count_references(store, gone)).first()) == (2, 4, 2, 2)


def test_secondary_index(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 5), ("b", "x", 3), ("c", None, 2)], "k string, v string, t int")
    ix = kv.secondary_index(log, "k", "v", "t")
    keys = lambda df: sorted(r.key for r in df.collect())
    assert keys(kv.lookup(ix, 4, "x")) == ["a", "b"] and keys(kv.lookup(ix, 5, "x")) == ["b"] and keys(kv.lookup(ix, 0, "x")) == []
    assert keys(kv.lookup(ix, 9, "x", "y")) == ["a", "b"]
    ended = kv.supersede(ix, "x", "b", 7)
    assert keys(kv.lookup(ended, 7, "x")) == [] and keys(kv.lookup(ended, 6, "x")) == ["b"]
    assert kv.collect_garbage(ended, 7).count() == 1
    moved = kv.relocate(ix, spark.createDataFrame([("b", "bb")], "old_key string, new_key string"))
    assert keys(kv.lookup(moved, 9, "x")) == ["bb"]
    assert sorted(map(tuple, kv.compact(spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "", 3)], "key string, value string, seq int")).collect())) == [("a", "2", 2)]


def test_saved_index_and_many_queries(spark, tmp_path):
    docs = spark.createDataFrame([(1, "quick brown fox"), (2, "lazy dogs and a fox"), (3, "quick quick dogs"), (4, None)], "doc_id bigint, text string")
    ix = search.index(docs)
    search.save(ix, str(tmp_path / "ix"))
    again = search.load(spark, str(tmp_path / "ix"))
    assert (again.n, again.mean, again.stemmed) == (4, ix.mean, True)
    asked = spark.createDataFrame([(10, "Quick dog"), (11, "nothing here"), (12, "fox")], "item_id bigint, text string")
    got = search.bm25_all(again, asked, 2).collect()
    for q, text in ((10, "Quick dog"), (12, "fox")):
        one = [(r.doc_id, round(r.score, 9)) for r in search.bm25(ix, text).collect()][:2]
        assert [(r.doc_id, round(r.score, 9)) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == one
    assert not [r for r in got if r.query_id == 11]
    assert [r.doc_id for r in search.rank(ix, "fox", docs.filter("doc_id >= 2")).collect()] == [2, 3, 4]


def test_postings_are_counted_where_documents_are_read(spark, monkeypatch):
    lists = pa.array([["b", "the", "b"], None, [], ["b", "c"], ["c", "b", "a", "c", "c", "d"], ["b"]])
    counted = lambda: sorted(((r["doc_id"], r["term"], r["positions"]) for b in search._counted(pa.array(range(6)), lists, False, True, {}) for r in b.to_pylist()), key=str)
    whole = counted()
    monkeypatch.setattr(search, "_WORDS_HELD", 4)
    assert counted() == whole == [(0, "b", [0, 2]), (3, "b", [0]), (3, "c", [1]), (4, "b", [1]), (4, "c", [0, 3, 4]), (4, "d", [5]), (5, "b", [0])]
    docs = spark.createDataFrame([(1, "Fox, the fox; ran RUNNING"), (2, None), (3, "a b-c b"), (3, "b a fox"), (4, ""), (5, "the"), (6, "dogs dog " * 4)], "doc_id bigint, text string")
    for stemmed in (False, True):
        words = search._with_terms(search.words_of(docs, "doc_id", "text"), stemmed)
        want = sorted((r.doc_id, r.term, r.tf, r.at) for r in words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("position")).alias("at")).collect())
        made = search._postings(docs, "doc_id", "text", stemmed, True)
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
        ix = search.index(docs, stemmed=stemmed)
        assert sorted((r.doc_id, r.term, r.tf, r.positions) for r in ix.postings.collect()) == want
        assert {r.doc_id: r.length for r in ix.docs.collect()} == {1: 4, 2: 0, 3: 5, 4: 0, 5: 0, 6: 8} and ix.n == 6
        assert sorted(map(tuple, search.index(docs, stemmed=stemmed, positions=False).postings.collect())) == [r[:3] for r in want]


def test_many_queries_exchange_postings_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 17}" for j in range(i % 9))) for i in range(300)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 3} w{i * 5 % 17}") for i in range(12)], "item_id bigint, text string")
    ix = search.index(docs, stemmed=False)
    found = search.bm25_all(ix, asked, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # counts of terms, and no postings
    assert plan.count("Exchange hashpartitioning(term") == 1 and not re.search(r"hashpartitioning\(query_id#\w+, doc_id", plan)
    monkeypatch.setattr(search, "is_small", lambda df: False)
    many = search.bm25_all(ix, asked, 4)
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, round(r.score, 9)) for r in df.collect())
    assert rows(found) == rows(many) and len(rows(found)) > 40


def test_forged_chain_is_made_once_and_exchanged_twice(spark):
    plan = more.audit_forged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("MapInArrow") == 1 and "Join" not in plan
    # hashes are made after the chain's rows are exchanged
    assert "sha2(" in plan and plan.index("sha2(") < plan.rindex("Exchange hashpartitioning")


def test_recall_of_cells(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    ix = vector.build_cells(e)
    assert ix.rows.count() == e.count()
    q = e.filter("vec_id % 20 = 0")
    near = {(r.query_id, r.id) for r in vector.search_cells(ix, q, 10).collect()}
    exact = {(r.query_id, r.id) for r in vector.nearest_to_all(q, e, 10).collect()}
    assert len(near & exact) >= 0.9 * len(exact) and len(near) == len(exact)
    assert {(r.query_id, r.id) for r in vector.search_cells(ix, q, 10, held_bytes=4096).collect()} == near
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (3, [0.0, 0.0])], "vec_id bigint, embedding array<float>")
    # an id that repeats among the queries is one query, of its rows' best
    assert vector.search_cells(vector.build_cells(some), some.dropDuplicates(["vec_id"]), 5).count() == 6
    assert vector.search_cells(vector.build_cells(some.limit(0)), some.limit(0), 5).count() == 0


def test_graphs_grow_and_errors_tell_where(spark):
    g = graph.Graph(spark.createDataFrame([(1, "A", "x")], "id int, label string, name string"), spark.createDataFrame([(1, 1, "e")], "src int, dst int, type string"))
    more = graph.add_edges(graph.add_nodes(g, spark.createDataFrame([(1, "B", "y"), (2, "B", "z")], "id int, label string, name string")), spark.createDataFrame([(1, 2, "f")], "src int, dst int, type string"))
    assert tuple(graph.counts(more).first()) == (2, 2) and more.nodes.filter("id = 1").first().label == "B"
    assert [r.id for r in graph.bfs_ids(more.edges, 1, 3).collect()] == [1, 2]
    with pytest.raises(ValueError, match="[0-9]"):
        Engine(spark).query("from t | take 'x' 'y'")
    assert math.isinf(G.distance(G.parse("POINT EMPTY"), G.parse("POINT (0 0)")))


def test_filters_and_columns_reach_the_scan(spark):
    from polymere.queries import queries

    sample = "/root/testdata/sf0.001"
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = lambda name: queries()[name](spark, sample)._jdf.queryExecution().executedPlan().toString()
    text = plan("ts_range_scan")
    pushed = text[text.index("PushedFilters") :].splitlines()[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThanOrEqual(ts" in pushed and "EqualTo(user_id,3)" in pushed
    assert "props" not in text[text.index("ReadSchema") :].splitlines()[0]
    text = plan("kv_get")
    assert "EqualTo(user_id,7)" in text[text.index("PushedFilters") :].splitlines()[0]
    text = plan("pipe_filter_project")
    assert "GreaterThanOrEqual(c_acctbal,5000" in text[text.index("PushedFilters") :].splitlines()[0]
    assert "c_nationkey" not in text[text.index("ReadSchema") :].splitlines()[0]
