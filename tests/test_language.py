"""The language: what it reads, writes back, and refuses; statements."""

from __future__ import annotations

import pytest

from polymere.engine import Engine
from polymere.lang import parse_statement, unparse
from polymere.plans.compile import BindError

TEXTS = [
    "from users",
    'from users | filter age >= 18 and (country == "IE" or not active) | sort name desc | take 5',
    "from a | join left b x on a.k == x.k | select { a.k, x.v as w }",
    "from t | group_by k { n: count(), p: percentile(v, 95) }",
    "from e | window tumbling(5m) on ts { n: count() }",
    "from e | window hopping(10m, 5m) on ts { n: count() }",
    "from e | window session(30m) on ts group_by u { n: count() }",
    'from graph g | match (a:Person)-[:knows*1..3]->(b:Person) | return distinct b.name as name',
    "with x as (from a | filter k > 1) from x | take 1",
    "from a union all from b except from c",
    "distinct from a | select { k }",
    "create view v as from a",
    "create table t { id: i64 not null, name: string, primary_key: id }",
    "drop table t",
    'insert into t { id: 1, name: "x" }',
    'update t set name = "y" where id == 1',
    "delete from t where id < 3",
    'upsert into t { id: 1, name: "z" }',
    "begin",
    "explain from a",
]


@pytest.mark.parametrize("text", TEXTS)
def test_what_is_written_back_reads_the_same(text):
    tree = parse_statement(text)
    assert parse_statement(unparse(tree)) == tree


@pytest.mark.parametrize("text", ["", "from", "from t | filter", "from t | take x", "from t |", "select a", "from t | sort", "insert into t", 'from t | filter a == "open'])
def test_what_is_refused(text):
    with pytest.raises(ValueError):
        parse_statement(text)


def test_statements_change_tables_and_roll_back(spark):
    e = Engine(spark)
    e.run("create table t { id: i64 not null, name: string, primary_key: id }")
    e.run('insert into t { id: 1, name: "a" }')
    e.run("begin")
    e.run('upsert into t { id: 1, name: "b" }')
    e.run('insert into t { id: 2 }')
    assert {tuple(r) for r in e.query("from t").collect()} == {(1, "b"), (2, None)}
    e.run("rollback")
    assert [tuple(r) for r in e.query("from t").collect()] == [(1, "a")]
    e.run('update t set name = "c" where name == "a"')
    e.run("delete from t where name == null")
    assert [tuple(r) for r in e.query("from t").collect()] == [(1, "c")]
    with pytest.raises(BindError):
        e.run('insert into t { name: "x" }')
    with pytest.raises(BindError):
        e.run("rollback")
    with pytest.raises(BindError):
        e.query("from nothing")


def test_nulls_and_odd_arithmetic(spark):
    e = Engine(spark).register("t", spark.createDataFrame([(1, None, 7), (2, 0, -7), (3, 2, 9223372036854775807)], "id bigint, d bigint, v bigint"))
    rows = {r.id: r for r in e.query("from t | select { id, v / d as q, v + 1 as up }").collect()}
    assert (rows[1].q, rows[2].q, rows[3].q) == (None, None, 4611686018427387903)
    assert (rows[1].up, rows[3].up) == (8, None)
    assert [r.id for r in e.query("from t | sort d").collect()] == [1, 2, 3]
    assert [r.id for r in e.query("from t | sort d desc").collect()] == [3, 2, 1]
    assert {r.id for r in e.query("from t | filter d == 0 or v > 100").collect()} == {2, 3}


def test_match_by_hops_and_direction(spark):
    nodes = spark.createDataFrame([(i, "A" if i < 3 else "B", f"n{i}") for i in range(5)], "id bigint, label string, name string")
    edges = spark.createDataFrame([(0, 1, "x"), (1, 2, "x"), (2, 3, "y"), (3, 4, "x"), (4, 0, "x")], "src bigint, dst bigint, type string")
    e = Engine(spark).register_graph("g", nodes, edges)
    q = lambda p: sorted(tuple(r) for r in e.query(f"from graph g | match {p} | select {{ a.id as a, b.id as b }}").collect())
    assert q("(a:A)-[:x]->(b:A)") == [(0, 1), (1, 2)]
    assert q('(a {name: "n0"})-[*1..2]->(b)') == [(0, 1), (0, 2)]
    assert q("(a:A)<-[:x]-(b:B)") == [(0, 4)]
