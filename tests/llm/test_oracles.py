"""Queries of the subpackage that have SQL against it, and near-duplicates against SQL over their fingerprints."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from polymere.llm import queries, simhash_index
from polymere.llm.common import table

from ..oracle import connection, differs
from .data import SAMPLE


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_rows_equal_those_of_sql(spark, name):
    assert differs(queries.QUERIES[name](spark, SAMPLE), queries.ORACLE_SQL[name], connection(SAMPLE)) == ""


def test_near_duplicates_against_sql_over_the_fingerprints(spark):
    """SQL takes all pairs of distinct fingerprints within the distance, and walks them."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    t = docs.select("doc_id", "text").toArrow()
    words = simhash_index.fingerprints_of(t.column("text").combine_chunks()).view(np.int64)
    prints = pa.table({"doc_id": t.column("doc_id"), "hi": words[:, 0].copy(), "lo": words[:, 1].copy()})  # noqa: F841
    sql = f"""
    WITH RECURSIVE n AS (SELECT hi, lo, min(doc_id) AS node FROM prints GROUP BY ALL),
    e AS (SELECT a.node AS a, b.node AS b FROM n a JOIN n b ON bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {simhash_index.DISTANCE}),
    w AS (SELECT node AS a, node AS b FROM n UNION SELECT w.a, e.b FROM w JOIN e ON w.b = e.a),
    r AS (SELECT a AS node, min(b) AS kept_id FROM w GROUP BY a),
    d AS (SELECT doc_id, kept_id, count(*) OVER (PARTITION BY kept_id) AS group_size FROM prints JOIN n USING (hi, lo) JOIN r USING (node))
    SELECT doc_id, kept_id, group_size FROM d WHERE doc_id <> kept_id"""
    want = sorted(duckdb.sql(sql).fetchall())
    assert len(want) > 50 and sorted(map(tuple, simhash_index.near_duplicates(docs).collect())) == want
