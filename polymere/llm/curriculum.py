"""Mixing sources to target weights along a curriculum.

Each source has a weight schedule over training time t from 0 to 1, linear
between knots; at every t the weights add up to 1. Its integral, times the token
budget, is the source's cumulative token demand. A source's documents are put in
an order by hash, their tokens are summed up, and the demand's inverse at the
tokens before a document is the time at which training reaches it: its position.
Documents are range-sorted by position. Within any stretch of time the sources
then have the shares of tokens that their schedules ask for, until a source's
supply ends; none is repeated. Documents beyond their source's demand are left
out, that being what down-weighting a source means.

Without a schedule, each source goes from its natural share of the tokens to
(1 - flatten) * share + flatten / sources; without a budget, it is all tokens.

Sums run in two levels: buckets of the hash order, which are added up per source
on their own, then within a bucket. So no source, however large, is one task.

All this is done on narrow rows, without texts. Positions are then cut into
stretches, one for each partition of the result. Since a source's positions grow
with its hash order, the stretch of a document follows from its source and hash
and a few cuts of each source, so texts are exchanged once, straight to their
stretch, where the sums are run on and the documents put in order.

Tokens are counted as words between white space. Defined results: a null or
empty text has 0 tokens and its predecessor's position; a null source counts as
the empty name; a null doc_id is ordered by its text; rows of equal doc_id follow
one another by content; a source that the schedule lacks, or without tokens, has
no demand and is left out. Other columns aren't touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import persist_table

FLATTEN = 0.2
SEED = "17"
BUCKET_ROWS = 4096
HELD_SEGMENTS = 50_000
#: Bytes of text of a partition of the result, and cuts of all sources, each of some 80 bytes, that every task holds.
PART_BYTES, HELD_CUTS = 128 << 20, 1_000_000


def n_tokens(text: Column) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r\f]++")), F.lit(0)).cast("bigint")


def default_schedule(totals: DataFrame, flatten: float = FLATTEN) -> DataFrame:
    """(source, t0, w0, t1, w1) from (source, tokens)."""
    both = totals.agg(F.sum("tokens").alias("all"), F.count("*").alias("sources"))
    share = F.try_divide(F.col("tokens").cast("double"), F.col("all").cast("double"))
    rows = totals.crossJoin(F.broadcast(both))  # one row
    return rows.select("source", F.lit(0.0).alias("t0"), share.alias("w0"), F.lit(1.0).alias("t1"), ((1 - F.lit(flatten)) * share + F.lit(flatten) / F.col("sources")).alias("w1"))


def given_schedule(totals: DataFrame, schedule: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """The same from {source: [(t, weight), ...]}; weights are scaled to add up to 1 at every knot."""
    times = sorted({0.0, 1.0} | {float(t) for knots in schedule.values() for t, _ in knots if 0 <= t <= 1})

    def weight(knots: list[tuple[float, float]], t: float) -> float:
        knots = sorted(knots)
        if t <= knots[0][0]:
            return knots[0][1]
        for (a, u), (b, v) in zip(knots, knots[1:]):
            if t <= b:
                return u + (v - u) * (t - a) / (b - a)
        return knots[-1][1]

    at = {s: [weight(k, t) for t in times] for s, k in schedule.items()}
    total = [sum(w[i] for w in at.values()) or 1.0 for i in range(len(times))]
    rows = [(s, times[i], w[i] / total[i], times[i + 1], w[i + 1] / total[i + 1]) for s, w in at.items() for i in range(len(times) - 1)]
    return totals.sparkSession.createDataFrame(rows, "source string, t0 double, w0 double, t1 double, w1 double")


def _ordered(docs: DataFrame, seed: str) -> DataFrame:
    """docs with __source, __tokens, and __key and __tie, in whose order a source is taken."""
    ident = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    return docs.withColumns({
        "__source": F.coalesce(F.col("source").cast("string"), F.lit("")),
        "__tokens": n_tokens(F.col("text").cast("string")),
        "__key": F.md5(F.concat(F.lit(seed + "|"), ident)),
        "__tie": F.xxhash64("text"),
    })


_ORDER = ("__key", "__tokens", "__tie")


def _position(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows that training reaches, with __position, from the tokens __c of their source before them."""
    rows = rows.join(spans, (F.col("__source") == F.col("__of")) & (F.col("__c") >= F.col("__d0")) & (F.col("__c") < F.col("__d1")))
    x = F.col("__c") - F.col("__d0")
    t = F.when(x == 0, F.col("__t0")).otherwise(F.col("__t0") + 2 * x / (F.col("__a") + F.sqrt(F.greatest(F.lit(0.0), F.col("__a") * F.col("__a") + 2 * F.col("__b") * x))))
    return rows.withColumn("__position", t)


def _running(*of: str) -> Column:
    """Tokens before each row within its part of a source."""
    return F.sum("__tokens").over(Window.partitionBy(*of).orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)) - F.col("__tokens")


def _placed(narrow: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None, budget: int | None, flatten: float) -> tuple[DataFrame, DataFrame]:
    """narrow rows that training reaches with __c and __position; and the spans of the demand."""
    digits = max(1, math.ceil(math.log(max(1, narrow.count() / BUCKET_ROWS), 16)))
    rows = narrow.withColumn("__bucket", F.substring("__key", 1, digits))
    sums, _ = persist_table(rows.groupBy("__source", "__bucket").agg(F.sum("__tokens").alias("tokens")), "buckets")
    before = sums.select("__source", "__bucket", (F.sum("tokens").over(Window.partitionBy("__source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")).alias("__before"))

    totals = sums.groupBy(F.col("__source").alias("source")).agg(F.sum("tokens").alias("tokens"))
    spans = default_schedule(totals, flatten) if schedule is None else given_schedule(totals, schedule)
    tokens = F.lit(budget).cast("double") if budget is not None else F.lit(float(totals.agg(F.sum("tokens")).first()[0] or 0))
    spans = spans.withColumn("area", tokens * (F.col("w0") + F.col("w1")) / 2 * (F.col("t1") - F.col("t0")))
    spans = spans.withColumn("end", F.sum("area").over(Window.partitionBy("source").orderBy("t0").rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.select(F.col("source").alias("__of"), F.col("t0").alias("__t0"), (F.col("end") - F.col("area")).alias("__d0"), F.col("end").alias("__d1"), (tokens * F.col("w0")).alias("__a"), (tokens * F.try_divide(F.col("w1") - F.col("w0"), F.col("t1") - F.col("t0"))).alias("__b"))
    spans, _ = persist_table(spans, "segments")
    if spans.count() <= HELD_SEGMENTS:
        spans = F.broadcast(spans)
    rows = rows.withColumn("__inner", _running("__source", "__bucket")).join(before, ["__source", "__bucket"]).withColumn("__c", F.col("__inner") + F.col("__before"))
    return _position(rows.drop("__inner", "__before", "__bucket"), spans), spans


_STEP = 100


def _rank(array: str, heads: str, x: Column) -> Column:
    """How many elements of a sorted array are at most x, by every _STEP-th of them, its heads, first."""
    low = F.greatest(F.size(F.filter(heads, lambda k: k <= x)) - 1, F.lit(0)) * _STEP
    return low + F.size(F.filter(F.slice(array, low + 1, _STEP), lambda k: k <= x))


def _cuts(placed: DataFrame, parts: int) -> DataFrame:
    """(__cut_of, __keys, __heads, __parts, __bases, __stop): for each source the first row, by _ORDER, of each stretch of positions, the tokens before it, and the last row."""
    at = placed.agg(F.percentile_approx("__position", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    edges = sorted(set(at or []))
    held = placed.sparkSession.createDataFrame([(edges, edges[::_STEP])], "__edges array<double>, __heads array<double>")
    placed = placed.withColumn("__at", F.struct(*_ORDER))
    cut = placed.crossJoin(F.broadcast(held)).withColumn("__part", _rank("__edges", "__heads", F.col("__position")))  # one row
    first = cut.groupBy("__source", "__part").agg(F.min("__at").alias("__at"), F.max("__at").alias("__last"))
    first, _ = persist_table(first, "cuts")
    # the base of a stretch is that of its first row; equal rows to both sides of an edge are of the later stretch
    base = placed.join(F.broadcast(first.select("__source", "__at", "__part")), ["__source", "__at"]).groupBy("__source", "__part").agg(F.min("__c").alias("__base"))
    both = first.join(base, ["__source", "__part"]).groupBy("__source")
    made = both.agg(F.array_sort(F.collect_list(F.struct("__at", "__part", "__base"))).alias("__cut"), F.max("__last").alias("__stop"))
    heads = F.transform(F.sequence(F.lit(0), F.floor((F.size("__cut") - 1) / _STEP).cast("int")), lambda i: F.element_at("__cut", i * _STEP + 1)["__at"])
    return made.select(F.col("__source").alias("__cut_of"), F.col("__cut.__at").alias("__keys"), heads.alias("__heads"), F.col("__cut.__part").alias("__parts"), F.col("__cut.__base").alias("__bases"), "__stop")


def mix(docs: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, budget: int | None = None, flatten: float = FLATTEN, seed: str = SEED) -> DataFrame:
    """docs that training reaches, with __tokens, __position and __key, range-sorted by position."""
    spark = docs.sparkSession
    rows = _ordered(docs, seed)
    narrow, _ = persist_table(rows.select("__source", *_ORDER, F.coalesce(F.octet_length("text"), F.lit(0)).alias("__bytes")), "tokens")
    placed, spans = _placed(narrow.drop("__bytes"), schedule, budget, flatten)
    placed, _ = persist_table(placed.select("__source", *_ORDER, "__c", "__position"), "placed")
    size, sources = narrow.agg(F.sum("__bytes"), F.count_distinct("__source")).first()
    # cuts are held by every task: at most HELD_CUTS of them
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil((size or 0) / PART_BYTES))
    parts = max(1, min(wanted, HELD_CUTS // max(1, sources)))
    cuts, _ = persist_table(_cuts(placed, parts), "cut-lists")
    rows = rows.join(F.broadcast(cuts), F.col("__source") == F.col("__cut_of")).filter(F.struct(*_ORDER) <= F.col("__stop"))
    rows = rows.withColumn("__n", _rank("__keys", "__heads", F.struct(*_ORDER)))
    rows = rows.withColumns({"__part": F.element_at("__parts", F.col("__n")), "__base": F.element_at("__bases", F.col("__n"))}).drop("__keys", "__heads", "__parts", "__bases", "__n", "__cut_of", "__stop")
    there = rows.repartitionById(parts, "__part").withColumn("__c", _running("__part", "__source") + F.col("__base"))
    return _position(there, spans).sortWithinPartitions("__position", *_ORDER).select(*[F.col(f"`{c}`") for c in docs.columns], "__tokens", "__position", "__key")


def training_order(docs: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, budget: int | None = None, flatten: float = FLATTEN, seed: str = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, position) of the documents that training reaches, in that order; position to 6 places."""
    narrow, _ = persist_table(_ordered(docs.select("doc_id", "source", "text"), seed).drop("text"), "tokens")
    placed, _ = _placed(narrow, schedule, budget, flatten)
    return placed.orderBy("__position", *_ORDER).select("doc_id", "source", F.col("__tokens").alias("n_tokens"), F.round("__position", 6).alias("position"))


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, md5('17|' || doc_id) AS k,
         len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) AS n
  FROM documents
), tot AS (
  SELECT src, sum(n)::DOUBLE AS s FROM d GROUP BY src
), g AS (
  SELECT sum(s) AS t, count(*) AS m FROM tot
), seg AS (
  SELECT src, t * (s / t) AS a, t * (((1 - 0.2::DOUBLE) * (s / t) + 0.2::DOUBLE / m) - s / t) AS b,
         t * ((s / t) + ((1 - 0.2::DOUBLE) * (s / t) + 0.2::DOUBLE / m)) / 2 AS d1
  FROM tot, g
), c AS (
  SELECT *, (sum(n) OVER (PARTITION BY src ORDER BY k ROWS UNBOUNDED PRECEDING) - n)::DOUBLE AS c FROM d
)
SELECT doc_id, source, n::BIGINT AS n_tokens,
       round(CASE WHEN c = 0 THEN 0 ELSE 2 * c / (a + sqrt(greatest(0, a * a + 2 * b * c))) END, 6) AS position
FROM c JOIN seg USING (src) WHERE c < d1
"""
