"""Column statistics: sketches, exact equi-depth histograms, most common values, encoding advice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def distinct_estimate(df: DataFrame, column: str, precision: int = 14, by: str | None = None) -> DataFrame:
    """(estimate) by a HyperLogLog sketch; with `by`, sketches of its values are made first and then merged."""
    if by is None:
        return df.agg(F.hll_sketch_estimate(F.hll_sketch_agg(column, precision)).alias("estimate"))
    parts = df.groupBy(by).agg(F.hll_sketch_agg(column, precision).alias("__s"))
    return parts.agg(F.hll_sketch_estimate(F.hll_union_agg("__s")).alias("estimate"))


def _cuts(values: DataFrame, column: str, buckets: int) -> DataFrame:
    """(__cuts): one row with the distinct values at the ranks ceil(i / buckets * n), i from 1 to buckets, exactly.

    A sketch gives bounds closely below and above each rank, and counts between them tell which ranges hold the ranks, wherever
    the sketch erred. Only these ranges' values are counted each, and their counts summed in order, so that no task sorts the column.
    """
    accuracy = max(10_000, 100 * buckets)
    about = sorted({min(1.0, max(0.0, i / buckets + d / accuracy)) for i in range(1, buckets + 1) for d in (-2, 2)})
    bounds = values.agg(F.array_distinct(F.percentile_approx(column, about, accuracy)).alias("__bounds"))
    ranged = values.crossJoin(F.broadcast(bounds)).select(F.col(column).alias("v"), F.size(F.filter("__bounds", lambda c: c < F.col(column))).alias("part"))
    # a row for each bound, and one
    counts = ranged.groupBy("part").agg(F.count("*").alias("c"))
    upto = counts.select("part", F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("upto"), "c", F.sum("c").over(Window.partitionBy()).alias("m"))
    ranks = F.explode(F.transform(F.array(*[F.lit(i / buckets) for i in range(1, buckets + 1)]), lambda q: F.ceil(q * F.col("m").cast("double")))).alias("rank")
    sought = upto.select("part", (F.col("upto") - F.col("c")).alias("before"), "upto", ranks).filter("rank > before and rank <= upto").groupBy(F.col("part").alias("p")).agg(F.first("before").alias("before"), F.collect_set("rank").alias("ranks"))
    each = ranged.join(F.broadcast(sought.select("p")), F.col("part") == F.col("p"), "left_semi").groupBy("part", "v").agg(F.count("*").alias("c"))
    run = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = each.withColumn("to", F.sum("c").over(run)).join(F.broadcast(sought), F.col("part") == F.col("p"))
    hit = at.filter(F.exists("ranks", lambda r: (r - F.col("before") > F.col("to") - F.col("c")) & (r - F.col("before") <= F.col("to"))))
    return hit.agg(F.sort_array(F.collect_set("v")).alias("__cuts"))


def histogram(df: DataFrame, column: str, buckets: int) -> DataFrame:
    """(bucket, lo, hi, n): buckets of equal depth, whose bounds are the exact values at their ranks.

    A bucket holds lo < value <= hi, and the first its lo too; equal bounds make one bucket.
    """
    values = df.filter(F.col(column).isNotNull()).select(column)
    # one row of at most `buckets` numbers
    placed = values.crossJoin(F.broadcast(_cuts(values, column, buckets))).withColumn("bucket", F.size(F.filter("__cuts", lambda c: c < F.col(column))))
    return placed.groupBy("bucket").agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("n"))


def profile(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n, nulls, distinct_values, lo, hi): one pass over all columns, bounds as text."""
    parts = [F.struct(F.lit(c).alias("column"), F.count("*").alias("n"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_values"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")) for c in columns]
    return df.agg(F.array(*parts).alias("__all")).select(F.explode("__all").alias("e")).select("e.*")


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """(value, n) of the n most frequent values; of equally frequent ones the least."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def encoding_advice(df: DataFrame, column: str, order: str) -> DataFrame:
    """(encoding) for a whole-number column: dictionary, delta_of_delta, bit_packed or frame_of_reference.

    Few values (at most 1 % and 4,096) make a dictionary; values that mostly grow
    with `order` over more than 16 bits deltas; small non-negative ones packed bits.
    Growth is measured within ranges of 1,024 of `order`, so no task takes all rows.
    """
    within = Window.partitionBy("__part").orderBy(order)
    steps = df.select(F.col(column).cast("bigint").alias("v"), order, F.floor(F.col(order).cast("double") / 1024).alias("__part")).withColumn("__up", F.col("v") >= F.lag("v").over(within))
    s = steps.agg(F.count("*").alias("n"), F.approx_count_distinct("v", 0.01).alias("ndv"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg(F.col("__up").cast("double")).alias("up"))
    few = (F.col("ndv") <= 4096) & (F.col("ndv") <= F.col("n") * 0.01)
    return s.select(F.when(few, "dictionary").when((F.col("up") >= 0.8) & (F.col("hi") - F.col("lo") > 65535), "delta_of_delta").when((F.col("lo") >= 0) & (F.col("hi") < 65536), "bit_packed").otherwise("frame_of_reference").alias("encoding"))


def selectivity_at_least(buckets: DataFrame, x: float) -> DataFrame:
    """(selectivity): the share of values >= x, from the buckets of a histogram; within a bucket values are taken as evenly spread."""
    width = F.col("hi") - F.col("lo")
    part = F.when(F.col("lo") >= x, 1.0).when(F.col("hi") < x, 0.0).otherwise(F.when(width > 0, (F.col("hi") - x) / width).otherwise(1.0))
    return buckets.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * part), F.sum("n").cast("double")), F.lit(0.0)).alias("selectivity"))


def selectivities(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """(equal, between, not_null): estimates for a predicate on a column, from counts and bounds alone: one value's share, a range's, and that of nulls' absence."""
    c = F.col(column)
    s = df.agg(F.count("*").alias("n"), F.count(c).alias("there"), F.count_distinct(c).alias("ndv"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi"))
    there = F.try_divide(F.col("there").cast("double"), F.col("n").cast("double"))
    inside = F.greatest(F.lit(0.0), F.least(F.lit(float(high)), F.col("hi")) - F.greatest(F.lit(float(low)), F.col("lo")))
    share = F.when(F.col("hi") > F.col("lo"), inside / (F.col("hi") - F.col("lo"))).otherwise(F.col("lo").between(low, high).cast("double"))
    return s.select(F.coalesce(F.try_divide(there, F.col("ndv").cast("double")), F.lit(0.0)).alias("equal"), F.coalesce(there * share, F.lit(0.0)).alias("between"), F.coalesce(there, F.lit(0.0)).alias("not_null"))
