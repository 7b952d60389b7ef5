"""Queries and the SQL that gives the same rows, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "benchmark", "embeddings", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    return Engine(spark).register_parquet(sf_dir, *names)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        """Registers a query under its function's name."""

        def keep(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep

    def pipe(self, name: str, text: str, sql: str, tables: str, **how) -> None:
        """Registers a query written in the language."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return engine(spark, sf_dir, *tables.split()).query(text, **how)

        run.__name__, run.__doc__ = name, text
        self.add(sql)(run)
