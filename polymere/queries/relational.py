"""Scans, filters, projections, joins, aggregates, order, set operations and statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from .book import Book, engine, table

book = Book()

book.pipe(
    "pipe_min_slice",
    """from lineitem | filter l_quantity > 10.0 and l_discount <= 0.05
    | group_by l_returnflag { n: count(), revenue: sum(l_extendedprice * (1 - l_discount)), avg_qty: mean(l_quantity) }
    | sort revenue desc | take 3 | select { l_returnflag, n, round(revenue, 2) as revenue, round(avg_qty, 6) as avg_qty }""",
    """SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty
    FROM lineitem WHERE l_quantity > 10 AND l_discount <= 0.05 GROUP BY 1 ORDER BY revenue DESC LIMIT 3""",
    "lineitem",
)
book.pipe(
    "pipe_filter_project",
    'from customer | filter c_acctbal >= 5000 and not (c_mktsegment == "BUILDING" or c_mktsegment == "MACHINERY") | select { c_custkey, c_name, c_acctbal }',
    "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND NOT (c_mktsegment = 'BUILDING' OR c_mktsegment = 'MACHINERY')",
    "customer",
)
book.pipe("scan_table", "from nation", "SELECT * FROM nation", "nation")
book.pipe("scan_subquery", "from (from part | filter p_size > 40 | select { p_partkey, p_size }) | filter p_size < 45", "SELECT p_partkey, p_size FROM part WHERE p_size > 40 AND p_size < 45", "part")
book.pipe(
    "expr_arithmetic",
    "from lineitem | select { l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey / l_linenumber as int_div, -7 / l_linenumber as neg_div, l_linenumber / (l_linenumber - 1) as by_zero, l_orderkey * 3 - l_linenumber + 1 as mixed, l_quantity / (l_linenumber - 1) as float_div, l_quantity * 2 + l_linenumber as widened }",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey // l_linenumber AS int_div, (-7)::BIGINT // l_linenumber AS neg_div,
    (l_linenumber::BIGINT // nullif(l_linenumber - 1, 0))::BIGINT AS by_zero, l_orderkey * 3 - l_linenumber + 1 AS mixed,
    l_quantity / nullif(l_linenumber - 1, 0) AS float_div, l_quantity * 2 + l_linenumber AS widened FROM lineitem""",
    "lineitem",
)
book.pipe(
    "filter_three_valued",
    "from orders | select { o_orderkey, nullif(o_orderstatus, \"F\") as s, o_totalprice } | filter s == \"O\" or o_totalprice > 200000.0 | filter not (s == \"P\") or o_totalprice > 300000.0",
    "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, o_totalprice FROM orders WHERE (nullif(o_orderstatus, 'F') = 'O' OR o_totalprice > 200000) AND (NOT (nullif(o_orderstatus, 'F') = 'P') OR o_totalprice > 300000)",
    "orders",
)
book.pipe("filter_compare_ops", "from part | filter p_size >= 10 and p_size <= 20 and p_size != 15 and p_retailprice < 1500.5 and p_partkey > 3", "SELECT * FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_size <> 15 AND p_retailprice < 1500.5 AND p_partkey > 3", "part")
book.pipe("filter_sum_i64", "from lineitem | filter l_linenumber > 3 | group_by l_linestatus { total: sum(l_orderkey), n: count() }", "SELECT l_linestatus, sum(l_orderkey)::BIGINT AS total, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1", "lineitem")
book.pipe("return_distinct", "from orders | return distinct o_orderstatus as status, o_orderpriority", "SELECT DISTINCT o_orderstatus AS status, o_orderpriority FROM orders", "orders")
book.pipe(
    "agg_sum_count_mean",
    "from orders | group_by o_orderpriority { n: count(), total: sum(o_custkey), avg_price: mean(o_totalprice) } | select { o_orderpriority, n, total, round(avg_price, 4) as avg_price }",
    "SELECT o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS total, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY 1",
    "orders",
)
book.pipe("agg_min_max", "from part | group_by p_brand { lo: min(p_retailprice), hi: max(p_retailprice), first_name: min(p_name) }", "SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS hi, min(p_name) AS first_name FROM part GROUP BY 1", "part")
book.pipe(
    "agg_percentile",
    "from events | group_by event_type { p50: percentile(value, 50), p99: percentile(value, 99) } | select { event_type, round(p50, 6) as p50, round(p99, 6) as p99 }",
    "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1",
    "events",
)
book.pipe("agg_count_distinct", "from lineitem | group_by l_shipdate { parts: count_distinct(l_partkey), flags: count_distinct(l_returnflag) }", "SELECT l_shipdate, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags FROM lineitem GROUP BY 1", "lineitem")
book.pipe("group_by_many_keys", "from lineitem | group_by l_returnflag, l_linestatus { n: count(), qty: sum(l_quantity) }", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1, 2", "lineitem")
book.pipe(
    "sort_nulls_take",
    'from orders | select { o_orderkey, nullif(o_orderpriority, "1-URGENT") as p } | sort o_orderkey desc | sort p | take 50',
    "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p ASC NULLS FIRST, o_orderkey DESC LIMIT 50",
    "orders",
)
book.pipe("topk", "from orders | sort o_orderkey | sort o_totalprice desc | take 20 | select { o_orderkey, o_totalprice }", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", "orders")
book.pipe("join_inner_equi", "from orders | join customer c on orders.o_custkey == c.c_custkey | select { o_orderkey, c.c_name as name, o_totalprice }", "SELECT o_orderkey, c_name AS name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey", "orders customer")
book.pipe(
    "join_left",
    "from documents | join left labels on documents.doc_id == labels.doc_id | select { documents.doc_id as doc_id, lang, quality, toxic }",
    "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "documents labels",
)
book.pipe(
    "join_right",
    "from labels | join right documents on documents.doc_id == labels.doc_id and labels.quality == 1 | select { documents.doc_id as doc_id, quality, source }",
    "SELECT d.doc_id, quality, source FROM labels l RIGHT JOIN documents d ON d.doc_id = l.doc_id AND l.quality = 1",
    "documents labels",
)
book.pipe(
    "join_full",
    "from nation | join full supplier s on nation.n_nationkey == s.s_nationkey and s.s_acctbal > 5000.0 | select { n_name, s_suppkey, s_acctbal }",
    "SELECT n_name, s_suppkey, s_acctbal FROM nation FULL JOIN supplier ON n_nationkey = s_nationkey AND s_acctbal > 5000",
    "nation supplier",
)
book.pipe(
    "join_chain_star",
    """from lineitem | join orders o on lineitem.l_orderkey == o.o_orderkey | join customer c on o.o_custkey == c.c_custkey
    | join nation n on c.c_nationkey == n.n_nationkey | join region r on n.n_regionkey == r.r_regionkey
    | group_by r.r_name { lines: count(), qty: sum(l_quantity) } | select { r.r_name as region, lines, qty }""",
    """SELECT r_name AS region, count(*) AS lines, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""",
    "lineitem orders customer nation region",
)
book.pipe(
    "semi_in_subquery",
    "from customer | filter c_custkey in (from orders | filter o_totalprice > 250000.0 | select { o_custkey }) and c_acctbal > 0.0 | select { c_custkey }",
    "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) AND c_acctbal > 0",
    "customer orders",
)
book.pipe(
    "anti_not_in_subquery",
    "from part | filter not (p_partkey in (from lineitem | filter l_quantity > 49.0 | select { l_partkey })) | select { p_partkey, p_name }",
    "SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "part lineitem",
)
book.pipe("set_union", "from customer | select { c_nationkey } union from supplier | select { s_nationkey }", "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier", "customer supplier")
book.pipe("set_union_all", "from customer | select { c_nationkey } union all from supplier | select { s_nationkey }", "SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier", "customer supplier")
book.pipe("set_intersect", "from orders | filter o_totalprice > 200000.0 | select { o_custkey } intersect from customer | filter c_acctbal > 3000.0 | select { c_custkey }", "SELECT o_custkey FROM orders WHERE o_totalprice > 200000 INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 3000", "orders customer")
book.pipe("set_except", "from customer | select { c_custkey } except from orders | filter o_orderstatus == \"F\" | select { o_custkey }", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'", "orders customer")
book.pipe("set_chain", "from nation | select { n_regionkey } union all from region | select { r_regionkey } except from nation | filter n_nationkey < 3 | select { n_regionkey }", "(SELECT n_regionkey FROM nation UNION ALL SELECT r_regionkey FROM region) EXCEPT SELECT n_regionkey FROM nation WHERE n_nationkey < 3", "nation region")
book.pipe("distinct_rows", "distinct from lineitem | select { l_returnflag, l_linestatus, l_linenumber }", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", "lineitem")
book.pipe("cte", "with big as (from orders | filter o_totalprice > 200000.0) from big | group_by o_custkey { n: count() } | filter n > 1", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000) SELECT o_custkey, count(*) AS n FROM big GROUP BY 1 HAVING count(*) > 1", "orders")
book.pipe("param_filter", "from orders | filter o_custkey == $who | select { o_orderkey, o_custkey }", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7", "orders", who=7)


@book.add("SELECT p_partkey, p_size, s_suppkey FROM part JOIN supplier ON p_size = 50 AND p_partkey % 10 > s_suppkey % 10 + 7")
def join_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.theta_join(table(spark, sf_dir, "part").filter("p_size = 50"), table(spark, sf_dir, "supplier"), F.expr("p_partkey % 10 > s_suppkey % 10 + 7")).select("p_partkey", "p_size", "s_suppkey")


@book.add("SELECT s_suppkey, count(*) AS n, sum(p_size)::BIGINT AS sizes, min(p_partkey) AS first_part FROM part JOIN supplier ON p_retailprice < s_acctbal GROUP BY 1")
def join_theta_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's parts that its balance can buy, over the whole tables."""
    return R.totals_below(table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier"), "p_retailprice", "s_acctbal", "s_suppkey", [("sizes", "sum", "p_size"), ("first_part", "min", "p_partkey")])


def _hinted(method: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        joined = R.equi_join(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", method=method)
        return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))

    run.__name__ = f"join_{method}_method"
    return run


for _m in ("hash", "merge", "auto"):
    book.add("SELECT o_orderpriority, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")(_hinted(_m))


@book.add("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_broadcast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.equi_join(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), "s_nationkey", "n_nationkey", method="broadcast").select("s_suppkey", "n_name")


@book.add("SELECT l_partkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size > 10 GROUP BY 1")
def join_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.salted_join(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").filter("p_size > 10"), "l_partkey", "p_partkey", salts=8)
    return joined.groupBy("l_partkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@book.add("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@book.add("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < 2")
def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").filter("r_regionkey < 2").crossJoin(table(spark, sf_dir, "nation")).select("r_name", "n_name")


@book.add("SELECT o.o_orderkey, b.label FROM orders o JOIN (VALUES (0, 50000, 'low'), (50000, 150000, 'mid'), (150000, 300000, 'high')) b(lo, hi, label) ON o_totalprice >= lo AND o_totalprice < hi")
def join_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = spark.createDataFrame([(0, 50000, "low"), (50000, 150000, "mid"), (150000, 300000, "high")], "lo int, hi int, label string")
    return R.range_join(table(spark, sf_dir, "orders"), bands, "o_totalprice", "lo", "hi", width=50_000).select("o_orderkey", "label")


@book.add("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"), F.count("*").alias("n"))


@book.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@book.add("SELECT c_custkey, c_mktsegment, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 5")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_per_group(table(spark, sf_dir, "customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 5).select("c_custkey", "c_mktsegment", "c_acctbal")


@book.add("SELECT sum(l_orderkey)::BIGINT AS total, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem")
def vector_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").agg(F.sum("l_orderkey").alias("total"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("n"))


@book.add("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.find_by_key(table(spark, sf_dir, "customer"), "c_custkey", 42).select("c_custkey", "c_name", "c_acctbal")


# -- statements: each gives the table after the change

@book.add("SELECT s_suppkey AS k, s_name AS name, s_acctbal AS bal FROM supplier UNION ALL SELECT 1000001, 'new', 12.5 UNION ALL SELECT 1000002, 'bare', NULL")
def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "supplier")
    e.register("s", e.query("from supplier | select { s_suppkey as k, s_name as name, s_acctbal as bal }"), "k")
    e.run('insert into s { k: 1000001, name: "new", bal: 12.5 }')
    e.run('insert into s { k: 1000002, name: "bare" }')
    return e.query("from s")


@book.add("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal * 2 + 1 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "customer")
    e.run('update customer set c_acctbal = c_acctbal * 2 + 1, c_mktsegment = "DEBT" where c_acctbal < 0.0')
    return e.query("from customer")


@book.add("SELECT * FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000)")
def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "orders")
    e.run('delete from orders where o_orderstatus == "F" or o_totalprice < 1000.0')
    return e.query("from orders")


@book.add("SELECT * FROM nation WHERE n_nationkey <> 3 UNION ALL SELECT 3, 'ATLANTIS', 1 UNION ALL SELECT 99, 'LEMURIA', 2")
def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir).register("nation", table(spark, sf_dir, "nation"), "n_nationkey")
    e.run('upsert into nation { n_nationkey: 3, n_name: "ATLANTIS", n_regionkey: 1 }')
    e.run('upsert into nation { n_nationkey: 99, n_name: "LEMURIA", n_regionkey: 2 }')
    return e.query("from nation")


@book.add("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def transaction_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.run("begin")
    e.run("delete from nation where n_regionkey != 1")
    e.run("commit")
    e.run("begin")
    e.run("delete from nation")
    e.run("rollback")
    return e.query("from nation | select { n_nationkey, n_name }")


@book.add("SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 1000 GROUP BY 1")
def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "customer")
    e.run("create view rich as from customer | filter c_acctbal > 1000.0")
    return e.query("from rich | group_by c_mktsegment { n: count() }")


@book.add("SELECT * FROM (VALUES (1, 'a', 1.5::DOUBLE), (2, NULL, NULL)) t(id, name, score)")
def create_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir)
    e.run("create table t { id: i64 not null, name: string, score: f64, primary_key: id }")
    e.run('insert into t { id: 1, name: "a", score: 1.5 }')
    e.run("insert into t { id: 2 }")
    return e.query("from t")


@book.add("SELECT 'table' AS kind, 'nation' AS name UNION ALL SELECT 'view', 'v' UNION ALL SELECT 'index', 'i'")
def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation")
    e.run("create view v as from nation")
    e.run("create index i on nation(n_name)")
    return e.catalog().select("kind", "name")


@book.add()
def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "orders").run("explain from orders | filter o_custkey == 7 | group_by o_orderstatus { n: count() }")
