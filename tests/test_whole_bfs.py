"""Queries over whole tables against plain loops."""

from __future__ import annotations

from collections import defaultdict

from polymere import queries

SAMPLE = "/root/testdata/sf0.001"
QUERIES = queries.queries()


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/{name}.parquet").select(*columns).collect()]


def test_search_passes_every_edge(spark):
    near = defaultdict(set)
    for t, a, x, b, y in (("customer", "c", "c_custkey", "n", "c_nationkey"), ("supplier", "s", "s_suppkey", "n", "s_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey"), ("orders", "c", "o_custkey", "o", "o_orderkey")):
        for p, q in rows(spark, t, x, y):
            near[f"{a}{p}"].add(f"{b}{q}")
            near[f"{b}{q}"].add(f"{a}{p}")
    depth, now = {"r0": 0}, ["r0"]
    for d in (1, 2, 3):
        now = sorted({y for x in now for y in near[x]} - set(depth))
        depth |= dict.fromkeys(now, d)
    got = QUERIES["graph_bfs_all"](spark, SAMPLE).collect()
    assert {r.id: r.depth for r in got} == depth and len(got) == len(depth)
    assert 3 in depth.values()
