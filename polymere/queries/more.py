"""The language's rarer parts, formats, indexes, predicates, proofs, and what else has an operator of its own."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.hashes import fnv1a
from ..lang import parse_statement, unparse
from ..operators import documents as D
from ..operators import graph as G
from ..operators import kv as K
from ..operators import rdf, search, security, spatial, statistics, vector
from ..plans.scratch import folder
from ..sources import files, triples
from ..streaming import windows as stream
from .book import Book, engine, table
from .models import _EDGES, _WORDS, _edges, _index, _log, _nodes, _triples

book = Book()


def _at(spark: SparkSession, kind: str) -> str:
    return folder(spark, f"{kind}-{uuid.uuid4().hex}")


# -- language

book.pipe("lang_comments", "-- all of them\nfrom nation -- by region\n| filter n_regionkey == 1 -- one\n| select { n_name }", "SELECT n_name FROM nation WHERE n_regionkey = 1", "nation")
book.pipe(
    "lang_literals",
    'from nation | select { n_nationkey, true as yes, not false as also, null as none, -n_nationkey as less, 0.5 as half, "a \\"b\\"" as quoted }',
    "SELECT n_nationkey, true AS yes, true AS also, NULL::VARCHAR AS none, -n_nationkey AS less, 0.5 AS half, 'a \"b\"' AS quoted FROM nation",
    "nation",
)
book.pipe(
    "lang_in_last", "from events | filter ts in last(7d) and not (ts in last(2d)) | select { event_id }",
    "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY AND ts < TIMESTAMP '2024-01-25' - INTERVAL 2 DAY", "events", now=datetime.datetime(2024, 1, 25),
)
_UNPARSED = 'from lineitem | filter (l_quantity > 45 or l_discount == 0.1) and not l_returnflag == "R" | group_by l_linestatus { n: count(), top: max(l_quantity) } | sort n desc | take 5'


@book.add("SELECT l_linestatus, count(*) AS n, max(l_quantity) AS top FROM lineitem WHERE (l_quantity > 45 OR l_discount = 0.1) AND l_returnflag <> 'R' GROUP BY 1 ORDER BY n DESC LIMIT 5")
def lang_unparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a query is written back as gives its rows."""
    return engine(spark, sf_dir, "lineitem").query(unparse(parse_statement(_UNPARSED)))


@book.add("SELECT p_partkey, [p_size, p_size + 1] AS sizes, p_brand AS first_brand FROM part")
def lang_array_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    item = lambda n: F.struct((F.col("p_size") + n).cast("bigint").alias("sku"), F.col("p_brand").alias("brand"))
    e = engine(spark, sf_dir).register("t", p.select("p_partkey", F.array(item(0), item(1)).alias("items"), F.struct(F.col("p_brand").alias("brand")).alias("first")))
    return e.query("from t | select { p_partkey, items[*].sku as sizes, first.brand as first_brand }")


book.pipe(
    "lang_in_under_or", "from lineitem | filter l_quantity > 49 or l_suppkey in (from supplier | filter s_acctbal > 9000 | select { s_suppkey }) and not l_partkey in (from part | filter p_size < 10 | select { p_partkey }) | select { l_orderkey, l_linenumber, l_suppkey in (from supplier | filter s_nationkey == 3 | select { s_suppkey }) as home }",
    "SELECT l_orderkey, l_linenumber, l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3) AS home FROM lineitem WHERE l_quantity > 49 OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000) AND NOT l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)",
    "lineitem supplier part",
)


@book.add("SELECT l_returnflag, max(l_quantity) - min(l_quantity) AS spread, sum(l_quantity * l_quantity) AS squares FROM lineitem GROUP BY 1")
def registered_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "lineitem").register_aggregate("spread", lambda c: F.max(c) - F.min(c)).register_aggregate("squares", lambda c: F.sum(c * c))
    return e.query("from lineitem | group_by l_returnflag { spread: spread(l_quantity), squares: squares(l_quantity) }")


@book.add("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
def procedure_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "nation", "region")
    e.register_procedure("of_region", "create view chosen as from region | filter r_name == \"EUROPE\";\nfrom nation | join chosen c on nation.n_regionkey == c.r_regionkey | select { n_name, c.r_name as r_name }")
    return e.call("of_region")


@book.add("SELECT i AS n, i * i AS square FROM range(1, 101) t(i)")
def registered_table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir).register_table_function("squares", lambda n: spark.range(1, n + 1).select(F.col("id").alias("n"), (F.col("id") * F.col("id")).alias("square")))
    return e.register("s", e.table_function("squares", 100)).query("from s")


@book.add("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT % 2 = 0")
def promoted_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine(spark, sf_dir, "events").promote("events", "k", "bigint", "props.k")
    return e.query("from events | filter k - k / 2 * 2 == 0 | select { event_id, k }")


@book.add("SELECT 'nation' AS name, count(*) AS rows FROM nation UNION ALL SELECT 'orders', count(*) FROM orders")
def catalog_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "nation", "orders").counts()


def _world(spark: SparkSession, sf_dir: str):
    return engine(spark, sf_dir).register_graph("world", _nodes(spark, sf_dir), _edges(spark, sf_dir))


@book.add(f"WITH {_EDGES} SELECT 'r' || r_regionkey AS region, src AS nation FROM region JOIN e ON dst = 'r' || r_regionkey WHERE r_name = 'ASIA'")
def graph_match_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's property, and an edge against its direction."""
    return _world(spark, sf_dir).query('from graph world | match (a:Region {name: "ASIA"})<-[:within]-(b:Nation) | select { a.id as region, b.id as nation }')


@book.add(f"WITH {_EDGES}, b AS (SELECT src AS x, dst AS y FROM e WHERE type IN ('within') UNION SELECT dst, src FROM e WHERE type IN ('within')) SELECT p.x AS one, q.y AS other FROM b p JOIN b q ON p.y = q.x WHERE p.x LIKE 'n%' GROUP BY ALL")
def graph_match_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _world(spark, sf_dir).query("from graph world | match (a:Nation)-[:within*2]-(b) | select { a.id as one, b.id as other }")


@book.add(f"WITH {_EDGES} SELECT src, list_sort(list(dst)) AS dsts FROM e WHERE type <> 'placed' GROUP BY src")
def graph_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.adjacency(_edges(spark, sf_dir).filter("type <> 'placed'"))


@book.add(f"WITH RECURSIVE {_EDGES}, w(id, depth) AS (SELECT 'c7', 0 UNION SELECT dst, depth + 1 FROM w JOIN e ON id = src WHERE depth < 3) SELECT id FROM w GROUP BY id ORDER BY min(depth), id")
def graph_bfs_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bfs_ids(_edges(spark, sf_dir), "c7", 3)


@book.add(f"WITH {_EDGES}, m AS (SELECT * FROM e UNION ALL SELECT 'r' || r_regionkey, 'world', 'of' FROM region), s AS (SELECT 1 FROM customer UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM region UNION ALL SELECT 1 FROM orders) SELECT (SELECT count(*) FROM s) + 1 AS nodes, (SELECT count(*) FROM m) AS edges")
def graph_grown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and edges after some were added."""
    g = G.Graph(_nodes(spark, sf_dir), _edges(spark, sf_dir))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("src"), F.lit("world").alias("dst"), F.lit("of").alias("type"))
    return G.counts(G.add_edges(G.add_nodes(g, spark.createDataFrame([("world", "World", "all")], "id string, label string, name string")), regions))


# -- key-value


@book.add("WITH log AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN '' ELSE event_id::VARCHAR END AS value, event_id AS seq FROM events) SELECT key, arg_max(value, seq) AS value, max(seq) AS seq FROM log GROUP BY key HAVING arg_max(value, seq) <> ''")
def kv_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.compact(_log(spark, sf_dir))


_SECOND = "WITH c AS (SELECT user_id AS key, event_type AS value, event_id AS begin_ts, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS end_ts FROM events)"


def _second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.secondary_index(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@book.add(f"{_SECOND} SELECT value, key, begin_ts, end_ts FROM c WHERE value = 'click' AND begin_ts <= 600 AND (end_ts IS NULL OR end_ts > 600)")
def kv_secondary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.lookup(_second(spark, sf_dir), 600, "click")


@book.add(f"{_SECOND} SELECT value, key, begin_ts, end_ts FROM c WHERE value BETWEEN 'error' AND 'signup' AND begin_ts <= 900 AND (end_ts IS NULL OR end_ts > 900)")
def kv_secondary_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.lookup(_second(spark, sf_dir), 900, "error", "signup")


@book.add(f"{_SECOND}, s AS (SELECT value, key, begin_ts, CASE WHEN key = 3 AND end_ts IS NULL AND value = (SELECT arg_max(event_type, event_id) FROM events WHERE user_id = 3) THEN 999999999 ELSE end_ts END AS end_ts FROM c) SELECT value, CASE WHEN key <= 5 THEN key + 1000 ELSE key END AS key, begin_ts, end_ts FROM s WHERE end_ts IS NULL OR end_ts > 800")
def kv_secondary_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry ended, keys moved, and what no reader from 800 on sees dropped."""
    ix = _second(spark, sf_dir)
    last = table(spark, sf_dir, "events").filter("user_id = 3").agg(F.max_by("event_type", "event_id")).first()[0]
    moved = table(spark, sf_dir, "events").filter("user_id <= 5").select(F.col("user_id").alias("old_key"), (F.col("user_id") + 1000).alias("new_key")).distinct()
    return K.collect_garbage(K.relocate(K.supersede(ix, last, 3, 999999999), moved), 800)


@book.add("""WITH l AS (SELECT event_id AS lsn, user_id AS txn, CASE event_type WHEN 'purchase' THEN 'commit' ELSE 'write' END AS kind, event_id % 97 AS key, event_id::VARCHAR AS value FROM events WHERE user_id % 2 = 0 OR event_type <> 'purchase'),
d AS (SELECT DISTINCT txn FROM l WHERE kind = 'commit'), w AS (SELECT l.*, txn IN (SELECT txn FROM d) AS done FROM l WHERE kind = 'write')
SELECT lsn, txn, key, (SELECT arg_max(x.value, x.lsn) FROM w x WHERE x.key = w.key AND x.done AND x.lsn < w.lsn) AS before FROM w WHERE NOT done""")
def log_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes to take back of users that never commit: those of odd ids, whose purchases aren't read as commits."""
    e = table(spark, sf_dir, "events").filter("user_id % 2 = 0 or event_type <> 'purchase'")
    kind = F.when(F.col("event_type") == "purchase", "commit").otherwise("write")
    return K.undo(e.select(F.col("event_id").alias("lsn"), F.col("user_id").alias("txn"), kind.alias("kind"), (F.col("event_id") % 97).alias("key"), F.col("event_id").cast("string").alias("value")))


# -- documents, blobs, hashes


@book.add("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def doc_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents to text and back."""
    e = table(spark, sf_dir, "events").select("event_id", D.encode(D.parse(F.col("props"))).alias("text"))
    return e.select("event_id", D.field(D.parse(F.col("text")), "k", "bigint").alias("k"))


@book.add("""WITH b AS (SELECT text, count(*) AS refs, bool_or(doc_id % 2 = 0) AS old, min(CASE WHEN doc_id % 2 = 1 THEN doc_id END) AS first_new FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT doc_id, sha256(text) AS digest, NOT old AND doc_id = first_new AS was_new FROM documents JOIN b USING (text) WHERE doc_id % 2 = 1""")
def blob_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of even ids are in the store; those of odd ids are put."""
    return _blobs(spark, sf_dir)[1].select(F.col("key").alias("doc_id"), "digest", "was_new")


def _blobs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    empty = spark.createDataFrame([], "digest string, content binary, refs bigint")
    store, _ = D.put(empty, d.filter("doc_id % 2 = 0"), "doc_id", "text")
    return D.put(store, d.filter("doc_id % 2 = 1"), "doc_id", "text")


@book.add("""WITH s AS (SELECT text, count(*) + 1 - count(*) FILTER (lang = 'en') AS refs FROM documents WHERE text IS NOT NULL GROUP BY text)
SELECT count(*) AS blobs, sum(refs)::BIGINT AS refs, sum(strlen(text))::BIGINT AS bytes, sum(strlen(text) * (refs - 1))::BIGINT AS bytes_saved FROM s WHERE refs > 0""")
def blob_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every blob is retained once more, and released for each English document."""
    store, _ = _blobs(spark, sf_dir)
    english = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.lit(-1).alias("by"))
    return D.blob_stats(D.count_references(store, english.unionByName(store.select("digest", F.lit(1).alias("by")))))


@book.add("""SELECT c_custkey, CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END::BIGINT AS hash FROM (SELECT c_custkey,
list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])::HUGEINT)), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h FROM customer)""")
def hash_fnv1a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", fnv1a(F.col("c_name")).alias("hash"))


# -- formats


@book.add("SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'a, \"b\"' || chr(10) || s_suppkey END AS note FROM supplier")
def csv_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "csv")
    note = F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit('a, "b"\n'), F.col("s_suppkey").cast("string")))
    files.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal", note.alias("note")), at)
    return files.read_csv(spark, at)


@book.add("SELECT event_id, event_type, epoch_us(ts) AS ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def ndjson_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "ndjson")
    files.write_ndjson(_with_odd_values(spark, sf_dir), at)
    return files.read_json(spark, at)


def _with_odd_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", "ts", F.when(F.col("event_id") % 5 == 0, float("inf")).otherwise(F.col("value")).alias("value"))


@book.add("SELECT event_id, event_type, epoch_us(ts) AS ts, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value FROM events")
def json_array_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "json-array")
    files.write_json_array(_with_odd_values(spark, sf_dir), at)
    return files.read_json_array(spark, at)


@book.add("SELECT count(*) AS n, 4 AS columns, 'GZIP' AS codec, false AS dictionary FROM orders")
def parquet_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the footers say of a table that was written with options."""
    at = _at(spark, "parquet")
    files.write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), at, sort_by=["o_orderkey"], compression="gzip", dictionary=False)
    m = files.parquet_metadata(spark, at)
    return m.agg(F.sum("rows").alias("n"), F.max("columns").alias("columns"), F.min("codec").alias("codec"), F.bool_or("dictionary").alias("dictionary"))


@book.add("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def arrow_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    return files.from_ipc(files.to_ipc(o), o.schema)


@book.add("WITH log AS (SELECT user_id AS key, CASE WHEN event_type = 'error' THEN '' ELSE event_id::VARCHAR END AS value, event_id AS seq FROM events) SELECT key, arg_max(value, seq) AS value FROM log WHERE key >= 20 GROUP BY key HAVING arg_max(value, seq) <> ''")
def segment_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written as segments sorted by key, loaded and scanned."""
    at = _at(spark, "segments")
    files.write_parquet(_log(spark, sf_dir), at, sort_by=["key", "seq"])
    return K.range_scan(files.read_parquet(spark, at), 20)


# -- time


@book.add("""WITH m AS (SELECT median(epoch_us(ts)) AS m, max(ts) AS last FROM events), w AS (SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events, m WHERE epoch_us(ts) >= m GROUP BY 1)
SELECT window_start, n FROM w, m WHERE window_start + INTERVAL 1 DAY <= last - INTERVAL 1 DAY""")
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of the events comes first, so the earlier half is late and dropped; windows come out once they are closed."""
    e = table(spark, sf_dir, "events").select("ts", "event_type")
    middle = e.agg(F.median(F.unix_micros(F.col("ts").cast("timestamp")))).first()[0]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    at, name = _at(spark, "late"), f"late_{uuid.uuid4().hex}"
    for part in (micros >= middle, micros < middle):
        e.filter(part).coalesce(1).write.mode("append").parquet(at)
        s = stream.read_files(spark, at, e, files_per_trigger=1)
        w = stream.windowed(s, "tumbling", [86_400_000], "ts", [], [F.count("*").alias("n")], "1 day")
        stream.write_files(w.select("window_start", "n"), f"{at}-out", folder(spark, name)).awaitTermination()
    return files.read_parquet(spark, f"{at}-out").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


# -- search

_PAIR = "eriner thanea"


@book.add(f"WITH {_WORDS} SELECT term, count(*) AS postings, sum(tf)::BIGINT AS words FROM p GROUP BY term")
def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index built anew, with a position for each word."""
    postings = search.index(table(spark, sf_dir, "documents"), stemmed=False).postings
    return postings.groupBy("term").agg(F.count("*").alias("postings"), F.sum(F.size("positions")).cast("bigint").alias("words"))


@book.add(f"WITH {_WORDS}, o AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents) SELECT doc_id FROM o WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'eriner' AND w[i + 1] = 'thanea')) > 0")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.phrase(_index(spark, sf_dir), _PAIR)


_BM25 = f"""{_WORDS}, len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS len FROM documents d LEFT JOIN p ON d.doc_id = p.doc_id GROUP BY 1), m AS (SELECT avg(len) AS m FROM len),
x AS (SELECT doc_id, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / m)) AS s FROM p JOIN df USING (term) JOIN len USING (doc_id), n, m)"""


@book.add(f"WITH {_BM25}, s AS (SELECT doc_id, sum(s) AS s FROM x WHERE term IN ('eriner', 'thanea') GROUP BY 1) SELECT doc_id, round(coalesce(s, 0), 6) AS score FROM documents LEFT JOIN s USING (doc_id) WHERE doc_id % 20 = 0")
def search_rank_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the documents asked for."""
    ids = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select("doc_id")
    return search.rank(_index(spark, sf_dir), _PAIR, ids).select("doc_id", F.round("score", 6).alias("score"))


@book.add(f"""WITH {_BM25}, q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) WHERE term <> ''),
s AS (SELECT item_id AS query_id, doc_id, sum(s) AS score FROM x JOIN q USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, round(score, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id))::INT AS rank FROM s QUALIFY rank <= 5""")
def search_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best documents for every benchmark text."""
    return search.bm25_all(_index(spark, sf_dir), table(spark, sf_dir, "benchmark"), 5).withColumn("score", F.round("score", 6))


@book.add(f"""WITH {_BM25}, t AS (SELECT DISTINCT term FROM p WHERE levenshtein(term, 'eriner') <= 1 OR levenshtein(term, 'thanea') <= 1)
SELECT doc_id, round(sum(s), 6) AS score, true AS marked FROM x JOIN t USING (term) GROUP BY 1 ORDER BY sum(s) DESC, doc_id LIMIT 20""")
def search_ranked_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best by the query's terms and those near to one, each with a mark in its snippet."""
    r = search.ranked(_index(spark, sf_dir), table(spark, sf_dir, "documents"), _PAIR, 1, 20)
    return r.select("doc_id", F.round("score", 6).alias("score"), F.contains("snippet", F.lit("<mark>")).alias("marked"))


_STEMS = [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("triplicate", "triplic"), ("formalize", "formal"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("probate", "probat"), ("controlling", "control")]


@book.add("SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in _STEMS) + ") v(word, stem)")
def search_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the stemmer's publication with their stems."""
    return spark.createDataFrame([(w,) for w, _ in _STEMS], "word string").select("word", search._stem("word").alias("stem"))


@book.add("SELECT * FROM (VALUES ('a dog and a cat and a cat', '...<mark>cat</mark> and a...'), ('none', NULL)) v(text, snippet)")
def search_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, T.snippet(t, ["cat"], 9) if "cat" in t else None) for t in ("a dog and a cat and a cat", "none")], "text string, snippet string")


# -- vectors


@book.add()
def vector_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of all rows, through the index of cells, of every row whose id is divisible by 20."""
    e = table(spark, sf_dir, "embeddings")
    return vector.search_cells(vector.build_cells(e), e.filter("vec_id % 20 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@book.add("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the index gives 0.9 and more of what exact search gives."""
    e = table(spark, sf_dir, "embeddings")
    q = e.filter("vec_id % 20 = 0")
    near = vector.search_cells(vector.build_cells(e), q, 10).select("query_id", "id", F.lit(1).alias("hit"))
    exact = vector.nearest_to_all(q, e, 10)
    return exact.join(near, ["query_id", "id"], "left").agg(F.count_distinct("query_id").alias("queries"), (F.count("hit") >= 0.9 * F.count("*")).alias("enough"))


# -- space

_BOXES = "b AS (SELECT n_nationkey AS k, (n_nationkey * 7) % 11 AS x0, (n_nationkey * 5) % 9 AS y0, (n_nationkey * 7) % 11 + 1 + n_nationkey % 4 AS x1, (n_nationkey * 5) % 9 + 1 + n_nationkey % 3 AS y1 FROM nation)"
_MEET = "(p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1)"
_INSIDE = "(p.x0 < q.x1 AND q.x0 < p.x1 AND p.y0 < q.y1 AND q.y0 < p.y1)"
_P_IN_Q, _Q_IN_P = ("({a}.x0 >= {b}.x0 AND {a}.y0 >= {b}.y0 AND {a}.x1 <= {b}.x1 AND {a}.y1 <= {b}.y1)".format(a=a, b=b) for a, b in ("pq", "qp"))
_GAP = "sqrt(greatest(p.x0 - q.x1, q.x0 - p.x1, 0) ** 2 + greatest(p.y0 - q.y1, q.y0 - p.y1, 0) ** 2)"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    b = table(spark, sf_dir, "nation").select(k.alias("k"), ((k * 7) % 11).alias("x0"), ((k * 5) % 9).alias("y0"), ((k * 7) % 11 + 1 + k % 4).alias("x1"), ((k * 5) % 9 + 1 + k % 3).alias("y1"))
    return b.withColumn("area", F.format_string("POLYGON ((%1$d %2$d, %3$d %2$d, %3$d %4$d, %1$d %4$d, %1$d %2$d))", "x0", "y0", "x1", "y1"))


def _box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the 25 nations' boxes that share a column of cells; the rest are left to spatial_box_relations."""
    b = _boxes(spark, sf_dir)
    cells = F.explode(F.sequence(F.lit(0), F.lit(0)))
    p, q = (b.select(cells.alias(f"c{n}"), F.struct("*").alias(n)) for n in "pq")
    return p.join(q, F.col("cp") == F.col("cq")).select("p", "q")


@book.add(f"""WITH {_BOXES} SELECT p.k AS a, q.k AS b, {_MEET} AS intersects, NOT {_MEET} AS disjoint, {_Q_IN_P} AS contains, {_P_IN_Q} AS within, {_P_IN_Q} AND {_Q_IN_P} AS equals,
{_MEET} AND NOT {_INSIDE} AS touches, false AS crosses, {_INSIDE} AND NOT {_P_IN_Q} AND NOT {_Q_IN_P} AS overlaps, round({_GAP}, 9) AS distance FROM b p, b q""")
def spatial_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All predicates and the distance of every two of the nations' boxes."""
    a, b = F.col("p.area"), F.col("q.area")
    named = {n: getattr(spatial, f"st_{n}")(a, b).alias(n) for n in ("intersects", "disjoint", "contains", "within", "equals", "touches", "crosses", "overlaps")}
    return _box_pairs(spark, sf_dir).select(F.col("p.k").alias("a"), F.col("q.k").alias("b"), *named.values(), F.round(spatial.st_distance(a, b), 9).alias("distance"))


_LINES = "l AS (SELECT n_nationkey AS k, n_nationkey % 2 AS way, (n_nationkey * 7) % 5 AS lo, (n_nationkey * 7) % 5 + 1 + n_nationkey % 3 AS hi FROM nation)"


@book.add(f"""WITH {_LINES}, p AS (SELECT a.k AS a, b.k AS b, a.way = b.way AS along, a.lo, a.hi, b.lo AS lo2, b.hi AS hi2 FROM l a, l b)
SELECT a, b, CASE WHEN along THEN lo <= hi2 AND lo2 <= hi ELSE 2 BETWEEN lo AND hi AND 2 BETWEEN lo2 AND hi2 END AS intersects,
CASE WHEN along THEN false ELSE 2 > lo AND 2 < hi AND 2 > lo2 AND 2 < hi2 END AS crosses,
along AND lo < hi2 AND lo2 < hi AND NOT (lo >= lo2 AND hi <= hi2) AND NOT (lo2 >= lo AND hi2 <= hi) AS overlaps,
CASE WHEN along THEN lo = hi2 OR lo2 = hi ELSE 2 BETWEEN lo AND hi AND 2 BETWEEN lo2 AND hi2 AND NOT (2 > lo AND 2 < hi AND 2 > lo2 AND 2 < hi2) END AS touches FROM p""")
def spatial_line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertical lines at x = 2 and horizontal ones at y = 2, every two of them."""
    k = F.col("n_nationkey")
    lo, hi = (k * 7) % 5, (k * 7) % 5 + 1 + k % 3
    line = F.when(k % 2 == 0, F.format_string("LINESTRING (2 %d, 2 %d)", lo, hi)).otherwise(F.format_string("LINESTRING (%d 2, %d 2)", lo, hi))
    p, q = (table(spark, sf_dir, "nation").select(F.lit(0).alias(f"c{n}"), k.alias(n), line.alias(f"l{n}")) for n in "ab")
    pairs = p.join(q, F.col("ca") == F.col("cb"))
    return pairs.select("a", "b", *[getattr(spatial, f"st_{n}")("la", "lb").alias(n) for n in ("intersects", "crosses", "overlaps", "touches")])


@book.add(f"WITH {_BOXES} SELECT p.k AS a, q.k AS b, {_Q_IN_P} AS contains, {_MEET} AS intersects, ((greatest(p.x1, q.x1) - least(p.x0, q.x0)) * (greatest(p.y1, q.y1) - least(p.y0, q.y0)))::DOUBLE AS union_area, round({_GAP}, 9) AS distance FROM b p, b q")
def spatial_box_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as columns, without geometry."""
    p, q = (spatial.box(*[F.col(f"{n}.{c}").cast("double") for c in ("x0", "y0", "x1", "y1")]) for n in "pq")
    return _box_pairs(spark, sf_dir).select(F.col("p.k").alias("a"), F.col("q.k").alias("b"), spatial.box_contains(p, q).alias("contains"), spatial.box_intersects(p, q).alias("intersects"), spatial.box_area(spatial.box_union(p, q)).alias("union_area"), F.round(spatial.box_distance(p, q), 9).alias("distance"))


@book.add(f"WITH {_BOXES} SELECT k, (x0 - 1.5)::DOUBLE AS x0, (y0 - 1.5)::DOUBLE AS y0, (x1 + 1.5)::DOUBLE AS x1, (y1 + 1.5)::DOUBLE AS y1 FROM b UNION ALL SELECT k + 100, x0 - 2.0, y0 - 2.0, x0 + 2.0, y0 + 2.0 FROM b")
def spatial_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of buffers about boxes and about points."""
    b = _boxes(spark, sf_dir)
    areas = b.select("k", spatial.st_buffer("area", F.lit(1.5)).alias("g"))
    points = b.select((F.col("k") + 100).alias("k"), spatial.st_buffer(F.format_string("POINT (%d %d)", "x0", "y0"), F.lit(2.0)).alias("g"))
    return areas.unionByName(points).select("k", spatial.st_bounds("g").alias("s")).select("k", *[F.round(f"s.{c}", 9).alias(c) for c in ("x0", "y0", "x1", "y1")])


@book.add(f"WITH {_BOXES} SELECT k, 'POLYGON ((' || x0 || ' ' || y0 || ', ' || x1 || ' ' || y0 || ', ' || x1 || ' ' || y1 || ', ' || x0 || ' ' || y1 || ', ' || x0 || ' ' || y0 || '))' AS by_bytes, 'MULTIPOINT ((' || x0 || ' ' || y0 || '), (' || x1 || ' ' || y1 || '))' AS by_json, 93 AS bytes FROM b")
def spatial_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons by way of well-known bytes, and pairs of points by way of GeoJSON."""
    two = F.format_string("MULTIPOINT ((%d %d), (%d %d))", "x0", "y0", "x1", "y1")
    b = _boxes(spark, sf_dir).withColumn("wkb", spatial.wkt_to_wkb("area"))
    return b.select("k", spatial.wkb_to_wkt("wkb").alias("by_bytes"), spatial.geojson_to_wkt(spatial.wkt_to_geojson(two)).alias("by_json"), F.octet_length("wkb").alias("bytes"))


@book.add(f"WITH {_BOXES} SELECT k, round(sqrt(((x0 + x1) / 2.0 - 4) ** 2 + ((y0 + y1) / 2.0 - 3) ** 2), 6) AS distance FROM b ORDER BY sqrt(((x0 + x1) / 2.0 - 4) ** 2 + ((y0 + y1) / 2.0 - 3) ** 2), k LIMIT 7")
def spatial_nearest_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.nearest_boxes(_boxes(spark, sf_dir), "area", 4, 3, 7, "k").select("k", F.round("distance", 6).alias("distance"))


_CELL = """c AS (SELECT c_custkey AS id, ((c_custkey * 37) % 360 - 180)::DOUBLE AS lon, ((c_custkey * 17) % 170 - 85)::DOUBLE AS lat FROM customer),
n AS (SELECT *, floor((lon + 180) / 360 * 8388608)::BIGINT AS x, floor((lat + 90) / 180 * 4194304)::BIGINT AS y FROM c)"""


@book.add(f"""WITH {_CELL} SELECT id, array_to_string(list_transform(range(0, 9), lambda i: substr('0123456789bcdefghjkmnpqrstuvwxyz', (1 + list_sum(list_transform(range(5 * i, 5 * i + 5),
lambda k: (CASE WHEN k % 2 = 0 THEN (x >> (22 - k // 2)) & 1 ELSE (y >> (21 - k // 2)) & 1 END) << (4 - (k - 5 * i)))))::BIGINT, 1)), '') AS geohash FROM n""")
def spatial_geohash_encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("id", spatial.encode_geohash(F.col("y"), F.col("x"), 9).alias("geohash"))


@book.add(f"WITH {_CELL} SELECT id, x * 360 / 8388608 - 180 AS min_lon, (x + 1) * 360 / 8388608 - 180 AS max_lon, y * 180 / 4194304 - 90 AS min_lat, (y + 1) * 180 / 4194304 - 90 AS max_lat, (y + 0.5) * 180 / 4194304 - 90 AS lat, (x + 0.5) * 360 / 8388608 - 180 AS lon FROM n")
def spatial_geohash_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _points(spark, sf_dir).select("id", spatial.decode_geohash(spatial.encode_geohash(F.col("y"), F.col("x"), 9)).alias("d"))
    return d.select("id", "d.*")


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), ((k * 37) % 360 - 180).cast("double").alias("x"), ((k * 17) % 170 - 85).cast("double").alias("y"))


# -- triples


@book.add("SELECT c_custkey AS k, '<customer/' || c_custkey || '>' AS who FROM customer WHERE c_custkey BETWEEN 1 AND 3")
def rdf_whole_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are neighbours beyond what a double can tell apart."""
    c = table(spark, sf_dir, "customer")
    number = F.concat(F.lit('"'), F.lit(9007199254740992) + F.col("c_custkey"), F.lit('"^^<int>'))
    t = c.select(F.concat(F.lit("<customer/"), "c_custkey", F.lit(">")).alias("s"), F.lit("<serial>").alias("p"), number.alias("o"))
    found = rdf.select(t, "SELECT ?who ?N WHERE { ?who <serial> ?N . FILTER(?N < 9007199254740996) FILTER(?N != 9007199254740992) }")
    return found.select((rdf.lexical(F.col("N")).cast("bigint") - 9007199254740992).alias("k"), "who")


@book.add("SELECT '<region/' || n_regionkey || '>' AS region, '<customer/' || a.c_custkey || '>' AS a FROM customer a JOIN nation ON a.c_nationkey = n_nationkey WHERE floor(a.c_acctbal) < 0")
def rdf_pattern_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns whose first two share nothing."""
    return rdf.select(_triples(spark, sf_dir), "SELECT ?region ?a WHERE { ?n <part> ?region . ?a <balance> ?m . ?a <in> ?n . FILTER(?m < 0) }")


@book.add("SELECT least(7, count(*)) AS n, 0::BIGINT AS named FROM customer WHERE c_nationkey = 3")
def rdf_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIMIT, and a variable that nothing binds."""
    return rdf.select(_triples(spark, sf_dir), "SELECT ?who ?other WHERE { ?who <in> <nation/3> } LIMIT 7").agg(F.count("*").alias("n"), F.count("other").alias("named"))


@book.add("SELECT '<customer/' || c_custkey || '>' AS s, '<in>' AS p, '<nation/' || c_nationkey || '>' AS o FROM customer WHERE c_nationkey <> 3 UNION SELECT '<nation/' || n_nationkey || '>', '<part>', '<region/' || n_regionkey || '>' FROM nation UNION SELECT '<new>', '<in>', '<nation/1>'")
def rdf_insert_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _triples(spark, sf_dir).filter("p <> '<balance>'")
    more = spark.createDataFrame([("<new>", "<in>", "<nation/1>")], "s string, p string, o string")
    return rdf.remove(rdf.insert(t, more.unionByName(more).unionByName(t)), rdf.match_pattern(t, p="<in>", o="<nation/3>"))


_ALL_TRIPLES = """SELECT '<customer/' || c_custkey || '>' AS s, '<in>' AS p, '<nation/' || c_nationkey || '>' AS o FROM customer UNION ALL SELECT '<customer/' || c_custkey || '>', '<balance>', '"' || floor(c_acctbal)::BIGINT || '"^^<int>' FROM customer
UNION ALL SELECT '<nation/' || n_nationkey || '>', '<part>', '<region/' || n_regionkey || '>' FROM nation"""


@book.add(_ALL_TRIPLES)
def rdf_ntriples(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "ntriples")
    triples.write_ntriples(_triples(spark, sf_dir), at)
    return triples.read_ntriples(spark, at)


@book.add(_ALL_TRIPLES)
def rdf_turtle(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _at(spark, "turtle")
    triples.write_turtle(_triples(spark, sf_dir), at, {"n": "nation/", "c": "customer/"})
    return triples.read_turtle(spark, at)


# -- security


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.chain(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id", ["event_type", "user_id"], "user_id")


@book.add("SELECT event_id FROM (SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before = 'purchase'")
def audit_forged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases turned into views, with hashes made anew and the next entries' links mended: the next entries give it away."""
    bought = F.col("event_type") == "purchase"
    # an entry that was not forged keeps its hash, whatever its link says
    forged = _chained(spark, sf_dir).select("event_id", F.when(bought, "view").otherwise(F.col("event_type")).alias("event_type"), "user_id", "prev_hash", F.col("entry_hash").alias("__was"), bought.alias("__forged"))
    made_anew = security._entry_hash(F.col("prev_hash"), "event_id", ["event_type", "user_id"])
    forged = forged.withColumn("entry_hash", F.when(F.col("__forged"), made_anew).otherwise(F.col("__was")))
    # a link is to the entry before, in the order by which links are looked at too: one exchange for both
    before = Window.partitionBy("user_id").orderBy("event_id")
    links = F.when(F.lag("__was").over(before) == F.col("prev_hash"), F.lag("entry_hash").over(before))
    mended = forged.withColumn("prev_hash", F.coalesce(links, "prev_hash")).drop("__was", "__forged")
    return security.broken_links(mended, "event_id", ["event_type", "user_id"], "user_id").select("event_id")


@book.add("SELECT event_id FROM events WHERE user_id = 3 AND event_type = 'click'")
def audit_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.entries(_chained(spark, sf_dir), 3, "click", "user_id", "event_type").select("event_id")


@book.add("SELECT count(*) AS kept, 0::BIGINT AS broken, count(DISTINCT user_id) AS chains FROM events WHERE event_id >= 500")
def audit_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of chains after older entries went is still verified, by the hashes before it."""
    kept, anchors = security.prune(_chained(spark, sf_dir), "event_id", "user_id", 500)
    bad = security.broken_links(kept, "event_id", ["event_type", "user_id"], "user_id", anchors)
    counted = kept.agg(F.count("*").alias("kept"), F.count_distinct("user_id").alias("chains"))
    return counted.crossJoin(F.broadcast(bad.agg(F.count("*").alias("broken")))).select("kept", "broken", "chains")  # one row each


def _merkle_sql(levels: int = 24) -> str:
    out = "WITH l0 AS (SELECT (row_number() OVER (ORDER BY o_orderkey) - 1) AS i, sha256(o_orderpriority || o_orderkey) AS h FROM orders)"
    for k in range(levels):
        out += f", l{k + 1} AS (SELECT i // 2 AS i, CASE WHEN count(*) = 2 THEN sha256(arg_min(h, i) || arg_max(h, i)) ELSE min(h) END AS h FROM l{k} GROUP BY i // 2)"
    return out + f" SELECT h AS root, (SELECT count(*) FROM orders) AS leaves FROM l{levels}"


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by position; their keys are numbered without a gap from the least."""
    o = table(spark, sf_dir, "orders")
    least = o.agg(F.min("o_orderkey")).first()[0]
    return o.select((F.col("o_orderkey") - least).alias("i"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("v"))


@book.add(_merkle_sql())
def merkle_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return security.merkle_root(_leaves(spark, sf_dir), "i", "v")


@book.add(f"WITH t AS ({_merkle_sql()}) SELECT root, ceil(log2(leaves))::INT >= steps AS short FROM t, (SELECT 1 AS steps)")
def merkle_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The root, from one order and the siblings of its path; as many as the tree is high, at most."""
    leaves = _leaves(spark, sf_dir)
    n = leaves.count()
    one = leaves.filter("i = 777").first()
    proof = security.merkle_proof(leaves, "i", "v", 777)
    return security.merkle_verify(F.lit(one.v), proof).crossJoin(F.broadcast(proof.agg((F.count("*") <= (n - 1).bit_length()).alias("short"))))  # one row each


# -- statistics


@book.add("SELECT count(DISTINCT l_orderkey) AS distinct_values, true AS near FROM lineitem")
def stats_sketch_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether merged sketches are within 3 % of the count."""
    li = table(spark, sf_dir, "lineitem")
    exact = li.agg(F.count_distinct("l_orderkey").alias("distinct_values"))
    return exact.crossJoin(F.broadcast(statistics.distinct_estimate(li, "l_orderkey", by="l_returnflag"))).select("distinct_values", (F.abs(F.col("estimate") - F.col("distinct_values")) <= 0.03 * F.col("distinct_values")).alias("near"))  # one row each


_HISTOGRAM = """r AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) AS rn, count(*) OVER () AS m FROM orders), k AS (SELECT DISTINCT v AS c FROM r, (SELECT unnest(range(1, 21)) AS i) WHERE rn = ceil((i::DOUBLE / 20) * m)),
h AS (SELECT (SELECT count(*) FROM k WHERE c < v) AS bucket, v FROM r), b AS (SELECT bucket, min(v) AS lo, max(v) AS hi, count(*) AS n FROM h GROUP BY 1)"""


@book.add(f"WITH {_HISTOGRAM} SELECT bucket::INT AS bucket, lo, hi, n FROM b")
def stats_equi_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram with exact cuts."""
    return statistics.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20)


@book.add(f"WITH {_HISTOGRAM} SELECT round(sum(n * CASE WHEN lo >= 200000 THEN 1 WHEN hi < 200000 THEN 0 WHEN hi > lo THEN (hi - 200000) / (hi - lo) ELSE 1 END) / sum(n), 9) AS selectivity FROM b")
def stats_selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = statistics.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 20)
    return statistics.selectivity_at_least(h, 200_000.0).select(F.round("selectivity", 9).alias("selectivity"))


@book.add("""WITH s AS (SELECT nullif(l_discount, 0) AS v FROM lineitem), a AS (SELECT count(*) AS n, count(v) AS t, count(DISTINCT v) AS d, min(v) AS lo, max(v) AS hi FROM s)
SELECT round(t / n / d, 9) AS equal, round(t / n * (0.06 - 0.03) / (hi - lo), 9) AS "between", round(t / n, 9) AS not_null FROM a""")
def stats_selectivities(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = statistics.selectivities(table(spark, sf_dir, "lineitem").select(F.nullif("l_discount", F.lit(0.0)).alias("v")), "v", 0.03, 0.06)
    return s.select(*[F.round(c, 9).alias(c) for c in s.columns])


_ADVISED = [("lines", "lineitem", "l_linenumber", "l_orderkey"), ("keys", "orders", "o_orderkey", "o_orderkey"), ("spread", "orders", "o_orderkey * 100", "o_orderkey"), ("negative", "orders", "-o_orderkey", "o_orderkey"), ("customers", "orders", "o_custkey", "o_orderkey")]


@book.add(" UNION ALL ".join(f"""SELECT '{n}' AS name, CASE WHEN count(DISTINCT v) <= 4096 AND count(DISTINCT v) <= 0.01 * count(*) THEN 'dictionary' WHEN avg(CASE WHEN up THEN 1.0 WHEN NOT up THEN 0 END) >= 0.8 AND max(v) - min(v) > 65535 THEN 'delta_of_delta'
WHEN min(v) >= 0 AND max(v) < 65536 THEN 'bit_packed' ELSE 'frame_of_reference' END AS encoding FROM (SELECT v, v >= lag(v) OVER (ORDER BY o) AS up FROM (SELECT {v} AS v, {o} AS o FROM {t}))""" for n, t, v, o in _ADVISED))
def stats_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advice for columns of different kinds."""
    out = None
    for n, t, v, o in _ADVISED:
        one = statistics.encoding_advice(table(spark, sf_dir, t).select(F.expr(v).alias("v"), F.col(o).alias("o")), "v", "o").select(F.lit(n).alias("name"), "encoding")
        out = one if out is None else out.unionByName(one)
    return out
