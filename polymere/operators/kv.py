"""Key-value logs and version chains as DataFrames: the latest write wins, history is kept.

A log has key, value and seq, which orders the writes of a key. A null or empty
value deletes the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _dead(value: str) -> Column:
    c = F.col(value)
    return c.isNull() | (c.cast("string") == "")


def live(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """(key, value) of every key that is there now: a max_by, which combines before the exchange."""
    last = log.groupBy(key).agg(F.max_by(F.struct(F.col(value)), F.col(seq)).alias("__last"))
    return last.select(key, F.col(f"__last.{value}").alias(value)).filter(~_dead(value))


def get(log: DataFrame, wanted, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """The pair of one key, or no row. The filter reaches the scan."""
    return live(log.filter(F.col(key) == wanted), key, value, seq)


def range_scan(log: DataFrame, start, end=None, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """Live pairs with start <= key < end in order of key; no end: all from start."""
    df = log.filter(F.col(key) >= start)
    return live(df if end is None else df.filter(F.col(key) < end), key, value, seq).orderBy(key)


def compact(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """The log rewritten: the last write of each key that is there now, its seq with it."""
    last = log.groupBy(key).agg(F.max_by(F.struct(F.col(value), F.col(seq)), F.col(seq)).alias("__last"))
    return last.select(key, F.col(f"__last.{value}").alias(value), F.col(f"__last.{seq}").alias(seq)).filter(~_dead(value))


def compaction_stats(log: DataFrame, key: str = "key", value: str = "value", seq: str = "seq") -> DataFrame:
    """One row: rows_before, rows_after, tombstones (keys whose last write deletes), and bytes of keys and values before and after."""
    size = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + F.coalesce(F.octet_length(F.col(value).cast("string")), F.lit(0))
    last = log.withColumn("__size", size).groupBy(key).agg(F.count("*").alias("n"), F.sum("__size").alias("bytes"), F.max_by(F.struct(F.col(value), F.col("__size")), F.col(seq)).alias("__last"))
    last = last.withColumn("dead", _dead(f"__last.{value}"))
    zero = F.lit(0).cast("bigint")
    return last.agg(
        F.coalesce(F.sum("n"), zero).alias("rows_before"), F.count_if(~F.col("dead")).alias("rows_after"), F.count_if("dead").alias("tombstones"),
        F.coalesce(F.sum("bytes"), zero).alias("bytes_before"), F.coalesce(F.sum(F.when(~F.col("dead"), F.col("__last.__size"))), zero).cast("bigint").alias("bytes_after"),
    )


def secondary_index(log: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """(value, key, begin_ts, end_ts): which keys had a value, and from when to when."""
    chain = versions(log.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(ts).alias("__ts")), "key", "__ts")
    return chain.filter("value is not null").select("value", "key", "begin_ts", "end_ts")


def lookup(index: DataFrame, at, low, high=None) -> DataFrame:
    """Entries of a value, or of low <= value <= high, that are visible at a time; the filter reaches the scan."""
    hit = F.col("value") == low if high is None else F.col("value").between(low, high)
    return read_at(index.filter(hit), at)


def supersede(index: DataFrame, value, key, ts) -> DataFrame:
    """index where the entry of value and key that is open ends at ts."""
    hit = (F.col("value") == F.lit(value)) & (F.col("key") == F.lit(key)) & F.col("end_ts").isNull()
    return index.withColumn("end_ts", F.when(hit, F.lit(ts)).otherwise(F.col("end_ts")))


def relocate(index: DataFrame, moved: DataFrame) -> DataFrame:
    """index after keys moved: moved has (old_key, new_key), each old_key once."""
    both = index.join(moved, F.col("key") == F.col("old_key"), "left")
    return both.select("value", F.coalesce("new_key", "key").alias("key"), "begin_ts", "end_ts")


def versions(log: DataFrame, key: str, ts: str) -> DataFrame:
    """log with begin_ts and end_ts: a version ends where the key's next begins; the last one's end is null."""
    return log.withColumn("begin_ts", F.col(ts)).withColumn("end_ts", F.lead(ts).over(Window.partitionBy(key).orderBy(ts)))


def read_at(chain: DataFrame, at) -> DataFrame:
    """Versions visible at a time: begin_ts <= at < end_ts."""
    at = at if isinstance(at, Column) else F.lit(at)
    return chain.filter((F.col("begin_ts") <= at) & (F.col("end_ts").isNull() | (F.col("end_ts") > at)))


def collect_garbage(chain: DataFrame, oldest) -> DataFrame:
    """Versions that a reader at `oldest` or later can still see."""
    return chain.filter(F.col("end_ts").isNull() | (F.col("end_ts") > F.lit(oldest)))


def conflicts(writes: DataFrame) -> DataFrame:
    """(txn, conflict) from (txn, key, read_ts, commit_ts): the first committer of a key wins.

    A transaction conflicts if a key that it writes has another commit after its
    snapshot and before its own commit. Both are found in one sweep of each
    key's commits in order.
    """
    before = F.max("commit_ts").over(Window.partitionBy("key").orderBy("commit_ts", "txn").rowsBetween(Window.unboundedPreceding, -1))
    marked = writes.withColumn("__hit", F.coalesce(before > F.col("read_ts"), F.lit(False)))
    return marked.groupBy("txn").agg(F.bool_or("__hit").alias("conflict"))


def recover(log: DataFrame) -> DataFrame:
    """(key, value) after redo of committed transactions only, from (lsn, txn, kind, key, value); kind is write, commit or abort."""
    ended = log.groupBy("txn").agg(F.bool_or(F.col("kind") == "commit").alias("__done"))
    writes = log.filter("kind = 'write'").join(ended.filter("__done"), "txn", "left_semi")
    return live(writes, "key", "value", "lsn")


def undo(log: DataFrame) -> DataFrame:
    """(lsn, txn, key, before): the writes to take back, of transactions that didn't commit, last first, each with the value that committed writes had left."""
    ended = log.groupBy("txn").agg(F.bool_or(F.col("kind") == "commit").alias("__done"))
    writes = log.filter("kind = 'write'").join(ended, "txn")
    done = F.when(F.col("__done"), F.struct("value"))
    last = F.last(done, ignorenulls=True).over(Window.partitionBy("key").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1))
    return writes.withColumn("__last", last).filter("not __done").select("lsn", "txn", "key", F.col("__last.value").alias("before")).orderBy(F.desc("lsn"))
