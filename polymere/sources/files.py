"""Readers and writers: delimited text with inferred types, JSON, Parquet, Arrow."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = [T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType(), T.StringType()]


def infer_types(text: DataFrame) -> T.StructType:
    """The narrowest of boolean, bigint, double and string that holds every value of each column of strings; one aggregate over all rows."""
    def rank(c: str):
        v = F.trim(F.col(f"`{c}`"))
        return F.when(v.isNull() | (v == ""), 0).when(F.lower(v).isin("true", "false"), 1).when(v.try_cast("bigint").isNotNull() & v.rlike(r"^[-+]?\d+$"), 2).when(v.try_cast("double").isNotNull(), 3).otherwise(4)

    parts = [F.struct(F.max(rank(c)).alias("most"), F.max((rank(c) == 1).cast("int")).alias("truth"), F.max(rank(c).isin(2, 3).cast("int")).alias("number")) for c in text.columns]
    found = text.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).first()
    # a column of both truth values and numbers is text
    return T.StructType([T.StructField(c, _KINDS[4 if r.truth and r.number else r.most or 0]) for c, r in zip(text.columns, found)])


def read_csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text; quoted fields may hold delimiters and line ends. Types are inferred from all rows if none are given."""
    read = spark.read.option("sep", delimiter).option("header", header).option("multiLine", True).option("escape", '"').option("ignoreLeadingWhiteSpace", True)
    if schema is not None:
        return read.schema(schema).csv(path)
    text = read.csv(path)
    kinds = infer_types(text)
    return text.select(*[F.trim(F.col(f"`{f.name}`")).try_cast(f.dataType).alias(f.name) if not isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in kinds])


def read_json(spark: SparkSession, path: str, variant: bool = False) -> DataFrame:
    """JSON lines with an inferred schema, or each line as a variant in `document`."""
    if not variant:
        return spark.read.json(path)
    return spark.read.text(path).select(F.try_parse_json("value").alias("document"))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_arrow(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Arrow IPC files or streams of a folder or pattern, each read where a task is."""
    names = [f.name for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                data = content.as_buffer()
                reader = pa.ipc.open_file(data) if bytes(data[:6]) == b"ARROW1" else pa.ipc.open_stream(data)
                for part in reader.read_all().select(names).to_batches():
                    yield part

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def to_ipc(df: DataFrame) -> DataFrame:
    """(data): Arrow IPC streams, one for each batch of rows, each readable on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["data"])

    return df.mapInArrow(run, "data binary")


def from_ipc(streams: DataFrame, schema: T.StructType | str) -> DataFrame:
    """The rows of Arrow IPC streams in `data`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data"):
                if data.is_valid:
                    yield from pa.ipc.open_stream(data.as_buffer())

    return streams.select("data").mapInArrow(run, schema)


def _numbers(df: DataFrame, finite: bool = False) -> DataFrame:
    """Times as microseconds since 1970; with `finite`, doubles that JSON can't write as null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.unix_micros(c.cast("timestamp"))
        elif finite and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",", mode: str = "errorifexists") -> None:
    """Delimited text: fields with a delimiter, quote or line end are quoted, quotes doubled, nulls are empty, times microseconds."""
    _numbers(df).write.mode(mode).option("sep", delimiter).option("header", header).option("nullValue", "").option("emptyValue", '""').option("escape", '"').csv(path)


def write_ndjson(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """An object a line; doubles that aren't finite are null, times microseconds."""
    _numbers(df, finite=True).write.mode(mode).option("ignoreNullFields", False).json(path)


def write_json_array(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Files that each hold one array of objects, written as rows come; otherwise as write_ndjson."""
    rows = _numbers(df, finite=True).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for b in batches:
            lines = []
            for text in b.column("value").to_pylist():
                lines.append(mark + text)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, b.schema.field("value").type)], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"], pa.string())], ["value"])

    # without rows there may be no task to write the brackets
    out = df.sparkSession.createDataFrame([("[]",)], "value string") if rows.isEmpty() else rows.mapInArrow(run, "value string")
    out.write.mode(mode).text(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The objects of files that hold an array each; a file is read by one task."""
    read = spark.read.option("multiLine", True)
    return (read.schema(schema) if schema is not None else read).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), mode: str = "append", compression: str = "zstd", row_group_bytes: int = 128 << 20, dictionary: bool = True, statistics: bool = True) -> None:
    """Rows sorted within partitions, so that row groups have narrow bounds and later scans skip them.

    compression is none, snappy, gzip, lz4, zstd or what else the session's Parquet has.
    """
    if partition_by:
        df = df.repartition(*partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    w = df.write.mode(mode).option("compression", compression).option("parquet.block.size", row_group_bytes).option("parquet.enable.dictionary", dictionary).option("parquet.column.statistics.enabled", statistics)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


_META = "path string, rows bigint, row_groups int, columns int, bytes bigint, compressed_bytes bigint, codec string, dictionary boolean, has_statistics boolean, created_by string"


def parquet_metadata(spark: SparkSession, path: str) -> DataFrame:
    """What each file's footer says; footers are read by tasks, files' data isn't."""
    names = [(f,) for f in spark.read.parquet(path).inputFiles()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name in b["path"]:
                system, at = fs.FileSystem.from_uri(name)
                with system.open_input_file(at) as f:
                    m = pq.read_metadata(f)
                chunks = [m.row_group(i).column(j) for i in range(m.num_row_groups) for j in range(m.num_columns)]
                rows.append((name, m.num_rows, m.num_row_groups, m.num_columns, sum(c.total_uncompressed_size for c in chunks), sum(c.total_compressed_size for c in chunks), chunks[0].compression if chunks else None, any("DICT" in e for c in chunks for e in c.encodings), all(c.is_stats_set for c in chunks), m.created_by))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _META.split(", ")])

    return spark.createDataFrame(names, "path string").repartition(max(1, min(len(names), spark.sparkContext.defaultParallelism))).mapInPandas(run, _META)


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    return spark.createDataFrame(frame)
