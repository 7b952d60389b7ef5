"""Joins by method, skew and ranges; lookups; top rows of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a side that every task may hold.
HELD_BYTES = 64 << 20
_HINTS = {"hash": "shuffle_hash", "merge": "merge", "broadcast": "broadcast"}


def equi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner", method: str = "auto") -> DataFrame:
    """Join on one key of each side; null keys match nothing.

    auto leaves the method to the planner and adaptive execution, which choose by
    size. broadcast sends the right side to all tasks if the plan's estimate or a
    count of its rows proves it small; else the sides are hashed.
    """
    if method == "broadcast" and not is_small(right):
        method = "hash"
    if method != "auto":
        right = right.hint(_HINTS[method])
    return left.join(right, left[left_key] == right[right_key], how)


def is_small(df: DataFrame, held_bytes: int = HELD_BYTES) -> bool:
    """Whether df is proven to fit into held_bytes: by the optimizer's estimate, which for files is their size, or by its rows and their longest row."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if estimate <= held_bytes:
        return True
    n, longest = df.agg(F.count("*"), F.max(F.octet_length(F.to_json(F.struct("*"))))).first()
    return n * (longest or 0) <= held_bytes


def theta_join(left: DataFrame, right: DataFrame, condition: Column, how: str = "inner", held_bytes: int = HELD_BYTES) -> DataFrame:
    """Join on any condition; there is no key to hash by, so each left row meets all right ones.

    The right side is sent to all tasks if it is proven small. Else inner joins
    take it in parts by hash, one after the other, which all tasks hold in turn;
    a range condition is better served by range_join, and totals over all that is below a bound by totals_below.
    """
    if is_small(right, held_bytes):
        return left.join(F.broadcast(right), condition, how)
    if how != "inner":
        return left.join(right, condition, how)
    estimate = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(64, -(-estimate // held_bytes))
    some = [right.filter(F.pmod(F.xxhash64(*right.columns), F.lit(parts)) == i) for i in range(parts)]
    out = left.join(some[0], condition)
    for p in some[1:]:
        out = out.unionByName(left.join(p, condition))
    return out


def totals_below(left: DataFrame, right: DataFrame, value: str, bound: str, key: str, totals: Sequence[tuple[str, str, str]], parts: int = 256) -> DataFrame:
    """(key, n, totals) of each key of right: what an aggregate of theta_join(left, right, value < bound) by it gives, without making the pairs.

    totals are (name, "sum", "min" or "max", column of left). Left is totalled for each distinct value; values and bounds are dealt into ranges
    by a sketch, and a running total over each range begins with that of all ranges before it. The work grows with the rows, not with their pairs.
    """
    how = {"sum": F.sum, "min": F.min, "max": F.max}
    columns = [("n", "sum"), *((name, kind) for name, kind, _ in totals)]
    by_value = left.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("n"), *[how[kind](c).alias(name) for name, kind, c in totals])
    cuts = by_value.agg(F.percentile_approx("__v", [i / parts for i in range(1, parts)], 10 * parts).alias("__cuts"))  # one row of fewer than `parts` numbers
    ranged = lambda df: df.crossJoin(F.broadcast(cuts)).withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col("__v")))).drop("__cuts")
    lows = ranged(by_value).withColumn("__at", F.lit(2))
    none = [F.lit(None).cast(t).alias(n) for n, t in by_value.dtypes if n != "__v"]
    asked = ranged(right.filter(F.col(bound).isNotNull()).select(F.col(key).alias("__key"), F.col(bound).alias("__v"), *none)).withColumn("__at", F.lit(1))
    # each range's totals, carried to the ranges after it: at most parts squared rows
    whole = lows.groupBy(F.col("__part").alias("__p")).agg(*[how[kind](n).alias(n) for n, kind in columns])
    carried = whole.crossJoin(F.broadcast(whole.sparkSession.range(parts).select(F.col("id").cast("int").alias("__part")))).filter("__p < __part")
    carried = carried.groupBy("__part").agg(*[how[kind](n).alias(n) for n, kind in columns]).withColumn("__at", F.lit(0))
    rows = lows.unionByName(asked, allowMissingColumns=True).unionByName(carried, allowMissingColumns=True)
    # at an equal value bounds come before values, so that these aren't below them
    run = Window.partitionBy("__part").orderBy(F.col("__at") != 0, "__v", "__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.select("__key", "__at", *[how[kind](n).over(run).alias(n) for n, kind in columns]).filter("__at = 1 and n > 0")
    return found.groupBy(F.col("__key").alias(key)).agg(*[how[kind](n).alias(n) for n, kind in columns])


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salts: int) -> DataFrame:
    """Inner join whose hot left keys are spread over `salts` partitions, each right row being repeated that often.

    The salt is a hash of the left row, so that a task which runs again gives the same rows. The sides are sorted and merged, which spills:
    the planner takes the repeated side for as small as its file, and would send it to all tasks, whose memory then grew with it.
    """
    left = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    right = right.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))).hint("merge")
    return left.join(right, (left[left_key] == right[right_key]) & (F.col("__salt") == F.col("__salt2"))).drop("__salt", "__salt2")


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Left rows with the right rows for which low <= point < high.

    Both sides meet by buckets of `width`, an equality that hashes; a right row
    is repeated for each bucket that it touches.
    """
    left = left.withColumn("__bucket", F.floor(F.col(point) / width))
    right = right.filter(F.col(low) < F.col(high)).withColumn("__b", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return left.join(right, (F.col("__bucket") == F.col("__b")) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("__bucket", "__b")


def find_by_key(df: DataFrame, key: str, value, version: Column | None = None) -> DataFrame:
    """Rows of a key; with a version column the row of the latest only. The filter reaches the scan."""
    found = df.filter(F.col(key) == value)
    return found if version is None else found.orderBy(version.desc()).limit(1)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; the planner limits each partition's groups before the exchange."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("__rank") <= n).drop("__rank")
