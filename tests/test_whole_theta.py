"""Queries over whole tables against plain loops."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from polymere import queries
from polymere.operators import relational as R

SAMPLE = "/root/testdata/sf0.001"
QUERIES = queries.queries()


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SAMPLE}/{name}.parquet").select(*columns).collect()]


def test_theta_join_pairs_every_part(spark):
    want = Counter()
    parts = rows(spark, "part", "p_retailprice")
    for k, balance in rows(spark, "supplier", "s_suppkey", "s_acctbal"):
        want[k] += sum(price < balance for (price,) in parts)
    got = {r.s_suppkey: r.n for r in QUERIES["join_theta_whole"](spark, SAMPLE).collect()}
    assert got == {k: n for k, n in want.items() if n}
    assert 0 < sum(got.values()) < len(parts) * len(want)


def test_totals_below_are_those_of_the_pairs_without_making_them(spark):
    low = [(i, float(i * 7919 % 400) if i % 50 else None, i % 9 if i % 4 else None) for i in range(1500)] + [(1500, float("nan"), 5), (1501, -0.0, 6)]
    high = [(i % 300, float(i * 31 % 410 - 3) if i % 40 else None) for i in range(500)] + [(300, float("nan")), (301, -3.0), (302, 0.0)]
    a, b = spark.createDataFrame(low, "k int, v double, size int"), spark.createDataFrame(high, "id int, cap double")
    pairs = a.join(b, a.v < b.cap).groupBy("id").agg(F.count("*").alias("n"), F.sum("size").alias("sizes"), F.min("k").alias("first"), F.max("k").alias("last"))
    for parts in (1, 2, 16, 256):
        got = R.totals_below(a, b, "v", "cap", "id", [("sizes", "sum", "size"), ("first", "min", "k"), ("last", "max", "k")], parts)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.collect()))


def test_whole_theta_join_makes_no_pairs(spark):
    plan = QUERIES["join_theta_whole"](spark, SAMPLE)._jdf.queryExecution().optimizedPlan().toString()
    assert "s_acctbal" in plan and not any("Join" in line and "p_retailprice" in line and "<" in line for line in plan.splitlines())
