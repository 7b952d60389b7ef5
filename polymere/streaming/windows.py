"""Structured Streaming: the same windows as in batch, with watermarks; distinct events; upserts into a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import series


def read_files(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 16, pattern: str = "*.parquet") -> DataFrame:
    """A stream of Parquet files as they come to a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", pattern).parquet(path)


def windowed(stream: DataFrame, kind: str, spans: Sequence[int], ts: str, keys: Sequence[str], aggregates: Sequence[Column], delay: str) -> DataFrame:
    """Windows of a stream; rows later than `delay` behind the latest are dropped, and state ends with its window."""
    return series.windowed(stream, kind, spans, F.col(ts), [F.col(k) for k in keys], aggregates, delay)


def distinct_events(stream: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    """Each key once within the delay."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_available(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off all files that are there, to a table in memory; for tests and queries of small results."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def write_files(df: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Appends to Parquet files, each row once, whatever is lost on the way."""
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.partitionBy(*partition_by) if partition_by else w).start()
