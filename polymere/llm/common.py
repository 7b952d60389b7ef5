"""Reading tables, durable intermediate tables and sampling, for all operators here."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written by persist_table and still there, in the order of writing.
_written: list[str] = []


def persist_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write df to the shared folder and read it back: this cuts the lineage, and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_table(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _written:
        _written.remove(path)


def written() -> set[str]:
    return set(_written)


def release(spark: SparkSession, keep: set[str] = frozenset()) -> None:
    """Drop intermediate tables but those in `keep`: for when what was made of them has been written itself."""
    for path in [p for p in _written if p not in keep]:
        drop_table(spark, path)


def sample_rows(df: DataFrame, rows: int, by: str, text: str, max_bytes: int, least: int = 0, most_values: int = 1000, seed: int = 17) -> list[Row]:
    """At most `rows` distinct rows of df for training, in proportion to how often each value of `by` occurs, but of each `least`, or all that it has.

    They are those of the least hashes of the whole row, so they are the same
    however df is partitioned, and repeated rows count once. Their texts hold
    `max_bytes` in all at most, divided as the rows are; a text longer than a
    tenth of it isn't taken. Of more than `most_values` values the most frequent
    are sampled. What the driver gets is bounded by these numbers.
    """
    spark = df.sparkSession
    columns = df.columns
    hashed = df.withColumns({"__by": F.col(by).cast("string"), "__h": F.xxhash64(F.lit(seed), *[F.col(f"`{c}`") for c in columns]), "__bytes": F.coalesce(F.octet_length(F.col(text)), F.lit(0))})
    counted = hashed.groupBy("__by").count().orderBy(F.desc("count"), F.asc_nulls_first("__by")).limit(most_values).collect()
    n = sum(r["count"] for r in counted)
    quota = {r["__by"]: min(r["count"], max(least, -(-rows * r["count"] // n))) for r in counted}
    total = sum(quota.values())
    count = {r["__by"]: r["count"] for r in counted}
    hashed = hashed.filter(F.col("__bytes") <= max_bytes // 10)
    share = {v: min(1.0, 3 * q / count[v]) for v, q in quota.items()}
    rows_of: list[Row] = []

    def at_most(df: DataFrame, bounds: dict) -> DataFrame:
        of = spark.createDataFrame(list(bounds.items()), "__value string, __bound bigint")
        return df.join(F.broadcast(of), F.col("__by").eqNullSafe(F.col("__value"))).filter(F.col("__h") <= F.col("__bound")).select("__by", "__h", "__bytes", *[F.col(f"`{c}`") for c in columns])

    while share:
        bounds = {v: 2**63 - 1 if s >= 1 else int(s * 2**63) * 2 - 2**63 for v, s in share.items()}
        found, path = persist_table(at_most(hashed, bounds).dropDuplicates(["__by", "__h"]), "sample")
        seen: dict[str | None, list[tuple[int, int]]] = {v: [] for v in share}
        for r in found.select("__by", "__h", "__bytes").collect():
            seen[r["__by"]].append((r["__h"], r["__bytes"]))
        cut = {}
        for v, sizes in seen.items():
            # fewer than wanted, where rows repeat: look further
            if len(sizes) < quota[v] and share[v] < 1:
                share[v] = min(1.0, 8 * share[v])
                continue
            del share[v]
            left = max_bytes * quota[v] // total
            for h, size in sorted(sizes)[: quota[v]]:
                if size > left:
                    break
                left -= size
                cut[v] = h
        if cut:
            rows_of += at_most(found, cut).collect()
        drop_table(spark, path)
    return sorted(rows_of, key=lambda r: (r["__h"], str(r["__by"])))


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow for columns of any name: with dots in it, mapInArrow itself doesn't find them."""
    names, given = df.columns, [f"c{i}" for i in range(len(schema))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(b.rename_columns(names) for b in batches):
            yield out.rename_columns(given)

    plain = T.StructType([T.StructField(c, f.dataType) for c, f in zip(given, schema.fields)])
    return df.toDF(*[f"c{i}" for i in range(len(names))]).mapInArrow(renamed, plain).toDF(*schema.names)


def text_slices(column: pa.Array | pa.ChunkedArray, size: int = 1 << 19) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about `size` bytes: first row, end row, their bytes, and offsets (one more than rows).

    A null counts as an empty text; a text longer than `size` is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end
