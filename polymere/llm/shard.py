"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Under a uniform permutation, the number of rows that go from partition i to
shard j has a multivariate hypergeometric distribution, given the sizes of
partitions and shards. The matrix is drawn first; each partition then permutes
its rows and sends as many as its row of the matrix says, in one exchange, and
each receiver permutes what it received. The result is a uniform permutation cut
into shards whose sizes are exact.

A receiver takes a group of consecutive shards, as many as a task can hold. Its
rows are in uniform order once permuted, so that cutting them at the shards'
sizes is as good as drawing a column for each shard, and a row of the matrix has
as many numbers as there are receivers, not shards.

No one holds the matrix. Partitions form a binary tree; the counts of a node are
split between its halves by one multivariate draw whose seed is the node. That
draw is a binary tree over the receivers, a level of which is one vectorised
hypergeometric draw. A task draws along its path to the root only: its own row,
and every task sees the same tree. Populations that numpy's generator doesn't
take (10^9) are drawn by rejection from a log-concave hat with probabilities
that are accurate at any size; both draws are exact, without a cut tail.

Rows are permuted by a seeded hash of their content, so a partition that is
read again, after an executor was lost, gives the same shards. Input that isn't
read straight from files is written to the shared folder first, as its
partitions might be cut otherwise the second time; a task whose rows don't
match the count fails rather than give wrong sizes.

Defined results: nulls, empty texts and repeated rows are rows like any other;
equal rows are interchangeable. The new columns `shard` and `shard_position`
get a trailing underscore for each column of that name that is there already.
An empty table gives an empty one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, persist_table

ROWS_PER_SHARD = 2048
#: Rows of a receiver, if there are more receivers than shuffle partitions.
RECEIVER_ROWS = 131_072
SEED = 29


def _stirling_rest(n: float) -> float:
    """log(n!) less Stirling's (n + 1/2) log n - n + log(2 pi) / 2."""
    if n < 16:
        return math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) if n else 0.0
    m = n * n
    return (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - 1 / 1188 / m) / m) / m) / m) / n


def _deviance(x: float, mean: float) -> float:
    """x log(x / mean) + mean - x, without cancellation."""
    d = (x - mean) / (x + mean)
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, term, k = (x - mean) * d, 2 * x * d, 1
    while True:
        term *= d * d
        k += 2
        more = total + term / k
        if more == total:
            return total
        total = more


def _log_binomial(x: int, n: int, p: float) -> float:
    if not n or p in (0.0, 1.0):
        return 0.0
    if x == 0:
        return n * math.log1p(-p)
    if x == n:
        return n * math.log(p)
    rest = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _deviance(x, n * p) - _deviance(n - x, n * (1 - p))
    return rest + 0.5 * math.log(n / (2 * math.pi * x * (n - x)))


def log_probability(x: int, good: int, bad: int, n: int) -> float:
    """Of x good among n of good + bad: saddle points keep it accurate at any size."""
    if x < max(0, n - bad) or x > min(n, good):
        return -math.inf
    p = n / (good + bad)
    return _log_binomial(x, good, p) + _log_binomial(n - x, bad, p) - _log_binomial(n, good + bad, p)


def draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows, taken from good + bad, are good; by rejection, exact for any log-concave distribution with known mode."""
    if not good or not bad or not n or n == good + bad:
        return good if n == good + bad else n if not bad else 0
    mode = (n + 1) * (good + 1) // (good + bad + 2)
    top = log_probability(mode, good, bad, n)
    p = math.exp(top)
    w = 1 + p / 2
    while True:
        u, v, accept = rng.random(3)
        y = v * w / p if u <= w / (1 + w) else (w - math.log1p(-v)) / p
        x = mode + (1 if rng.random() < 0.5 else -1) * round(y)
        if accept * min(1.0, math.exp(min(0.0, w - p * y))) <= math.exp(min(0.0, log_probability(x, good, bad, n) - top)):
            return x


def draws(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """draw for each of many populations."""
    small = good + bad < 1_000_000_000
    out = rng.hypergeometric(np.where(small, good, 0), np.where(small, bad, 0), np.where(small, n, 0))
    for i in np.flatnonzero(~small).tolist():
        out[i] = draw(rng, int(good[i]), int(bad[i]), int(n[i]))
    return out


def split(rng: np.random.Generator, sizes: np.ndarray, n: int) -> np.ndarray:
    """How many rows of each size are among n rows taken from all."""
    levels = [np.asarray(sizes, np.int64)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append(np.append(last, 0).reshape(-1, 2).sum(axis=1) if len(last) % 2 else last.reshape(-1, 2).sum(axis=1))
    counts = np.array([n], np.int64)
    for level in levels[-2::-1]:
        both = np.append(level, 0) if len(level) % 2 else level
        left = draws(rng, both[0::2], both[1::2], counts)
        counts = np.stack([left, counts - left], axis=1).reshape(-1)[: len(level)]
    return counts


def matrix_row(i: int, partitions: np.ndarray, shards: np.ndarray, seed: int) -> np.ndarray:
    """Row i of the communication matrix; its sum is partitions[i], and the rows' sum is shards."""
    upto = np.concatenate([[0], np.cumsum(partitions)])
    lo, hi, counts = 0, len(partitions), np.asarray(shards, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = split(np.random.default_rng([seed, lo, hi]), counts, int(upto[mid] - upto[lo]))
        if i < mid:
            hi, counts = mid, left
        else:
            lo, counts = mid, counts - left
    return counts


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


#: Nodes of a plan under which partitions are the files' own, whatever columns are read.
_AS_READ = {"LogicalRelation", "DataSourceV2ScanRelation", "Project", "Filter", "SubqueryAlias", "MapInArrow", "MapInPandas"}


def _read_from_files(df: DataFrame) -> bool:
    """Whether df's partitions are those of its files."""

    def ok(node) -> bool:
        children = node.children()
        return node.getClass().getSimpleName() in _AS_READ and all(ok(children.apply(i)) for i in range(children.size()))

    return ok(df._jdf.queryExecution().optimizedPlan())


def shuffle_into_shards(docs: DataFrame, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED, receiver_rows: int = RECEIVER_ROWS) -> DataFrame:
    """docs with `shard` and `shard_position`: a uniform shuffle, in shards of rows_per_shard rows or one or so less."""
    if not _read_from_files(docs):
        docs, _ = persist_table(docs, "unsharded")
    spark = docs.sparkSession
    counted = dict(docs.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect())
    sizes = np.array([counted.get(i, 0) for i in range(max(counted, default=0) + 1)], np.int64)
    rows = int(sizes.sum())
    shards = max(1, math.ceil(rows / rows_per_shard))
    each, longer = divmod(rows, shards)  # the first `longer` shards have a row more
    receivers = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / receiver_rows)))
    first = np.arange(receivers + 1) * shards // receivers
    held = spark.sparkContext.broadcast((sizes, np.diff(first * each + np.minimum(first, longer))))
    shard, position = free_name(docs, "shard"), free_name(docs, "shard_position")
    schema = T.StructType([*docs.schema.fields, T.StructField(shard, T.IntegerType())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, at = TaskContext.get().partitionId(), 0
        sizes, takes = held.value
        upto = np.cumsum(matrix_row(i, sizes, takes, seed)) if i < len(sizes) else np.zeros(1, np.int64)
        for b in batches:
            to = np.searchsorted(upto, np.arange(at, at + b.num_rows), "right").astype(np.int32)
            at += b.num_rows
            if at > upto[-1]:
                raise RuntimeError(f"partition {i} has more rows than the {upto[-1]} counted")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to)], [*b.schema.names, shard])
        if at != upto[-1]:
            raise RuntimeError(f"partition {i} has {at} rows; {upto[-1]} were counted")

    def order(salt: int) -> list:
        plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        return [F.xxhash64(F.lit(seed + salt), *plain), F.xxhash64(F.lit(seed + salt + 2), *plain)]

    sent = map_rows(docs.sortWithinPartitions(*order(0)), send, schema).repartitionById(receivers, F.col(f"`{shard}`"))
    # a partition is one receiver's; the number of a row after all permutations gives its shard
    number = free_name(docs, "row_number")
    local = F.row_number().over(Window.partitionBy(F.col(f"`{shard}`")).orderBy(*order(1)))
    before = f"(bigint(`{shard}`) * {shards} div {receivers})"
    rows_before = F.expr(f"{before} * {each} + least({before}, {longer})")
    long_rows, n = longer * (each + 1), f"`{number}`"
    return sent.withColumn(number, local - 1 + rows_before).select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.expr(f"int(if({n} < {long_rows}, {n} div {each + 1}, {longer} + ({n} - {long_rows}) div {max(1, each)}))").alias(shard),
        F.expr(f"if({n} < {long_rows}, {n} % {each + 1}, ({n} - {long_rows}) % {max(1, each)})").alias(position),
    )
