"""The engine: named tables and graphs, and the language over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang import ast, parse_statement, unparse
from .operators.graph import Graph
from .plans.compile import BindError, Compiler, rel_of, set_op

_TYPES = {"i64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType(), "bool": T.BooleanType(), "string": T.StringType(), "bytes": T.BinaryType(), "timestamp": T.TimestampNTZType(), "doc": T.StringType()}


class Engine:
    """Runs statements of the language; writes make new versions of a table, and readers keep theirs.

    A transaction is a snapshot of the registry that rollback brings back: one
    writer, in this process. A table that is changed many times should be saved
    and registered anew, since each change adds to its plan.
    """

    def __init__(self, spark: SparkSession, max_hops: int = 10, watermark: str | None = None) -> None:
        self.spark, self.max_hops, self.watermark = spark, max_hops, watermark
        self.tables: dict[str, DataFrame] = {}
        self.views: dict[str, object] = {}
        self.graphs: dict[str, Graph] = {}
        self.keys: dict[str, str] = {}
        self.indexes: dict[str, tuple[str, str]] = {}
        self.functions: dict[str, Callable[..., Column]] = {}
        self.procedures: dict[str, str] = {}
        self.aggregates: dict[str, Callable[..., Column]] = {}
        self.table_functions: dict[str, Callable[..., DataFrame]] = {}
        self._snapshots: list[tuple] = []

    # -- registry

    def register(self, name: str, df: DataFrame, primary_key: str | None = None) -> Engine:
        self.tables[name] = df
        if primary_key:
            self.keys[name] = primary_key
        return self

    def register_parquet(self, folder: str, *names: str) -> Engine:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def register_graph(self, name: str, nodes: DataFrame, edges: DataFrame) -> Engine:
        self.graphs[name] = Graph(nodes, edges)
        return self

    def register_function(self, name: str, function: Callable[..., Column]) -> Engine:
        """A function of columns to a column (built-ins, or a pandas UDF)."""
        self.functions[name] = function
        return self

    def register_aggregate(self, name: str, function: Callable[..., Column]) -> Engine:
        """A function of columns to an aggregate column, for group_by and window: built of built-in aggregates, or a grouped pandas UDF."""
        self.aggregates[name] = function
        return self

    def register_table_function(self, name: str, function: Callable[..., DataFrame]) -> Engine:
        """A function of plain values to rows; table_function calls it, and what it gives can be registered as a table."""
        self.table_functions[name] = function
        return self

    def table_function(self, name: str, *args) -> DataFrame:
        if name not in self.table_functions:
            raise BindError(f"no table function is called {name}")
        return self.table_functions[name](*args)

    def register_procedure(self, name: str, text: str) -> Engine:
        """Statements under a name, separated by `;` at ends of lines; call runs them."""
        for statement in self._statements(text):
            parse_statement(statement)
        self.procedures[name] = text
        return self

    @staticmethod
    def _statements(text: str) -> list[str]:
        return [x for x in (part.strip() for part in re.split(r";[ \t]*(?:\n|\Z)", text)) if x]

    def call(self, name: str, now=None, **params) -> DataFrame | None:
        """What the last statement of a procedure gives; $name in it is params[name]."""
        if name not in self.procedures:
            raise BindError(f"no procedure is called {name}")
        out = None
        for statement in self._statements(self.procedures[name]):
            out = self.run(statement, now, **params)
        return out

    def promote(self, table: str, column: str, kind: str, path: str | None = None) -> Engine:
        """The table with a column of a type of its own: a text column cast, or what a document column has at a path."""
        df = self._base(table)
        head, _, rest = (path or column).partition(".")
        c = F.col(head)
        value = F.try_variant_get(F.try_parse_json(c), f"$.{rest}", kind) if rest else c.try_cast(kind)
        self.tables[table] = df.withColumn(column, value)
        return self

    def table(self, name: str) -> DataFrame:
        if name in self.tables:
            return self.tables[name]
        if name in self.views:
            return self._query(self.views[name], Compiler(self))
        raise BindError(f"no table or view is called {name}")

    def counts(self) -> DataFrame:
        """(name, rows) of every table, counted together."""
        out = None
        for n, df in self.tables.items():
            one = df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("name"), "rows")
            out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], "name string, rows bigint") if out is None else out

    def catalog(self) -> DataFrame:
        """(kind, name, detail) of everything registered."""
        rows = [("table", n, df.schema.simpleString()) for n, df in self.tables.items()]
        rows += [("view", n, unparse(q)) for n, q in self.views.items()]
        rows += [("index", n, f"{t}({c})") for n, (t, c) in self.indexes.items()]
        rows += [("graph", n, f"{g.nodes.schema.simpleString()} {g.edges.schema.simpleString()}") for n, g in self.graphs.items()]
        rows += [("procedure", n, t) for n, t in self.procedures.items()]
        rows += [(kind, n, "") for kind, held in (("function", self.functions), ("aggregate", self.aggregates), ("table function", self.table_functions)) for n in held]
        return self.spark.createDataFrame(rows, "kind string, name string, detail string")

    # -- statements

    def query(self, text: str, now=None, **params) -> DataFrame:
        """The rows of a query; $name in it is params[name], and `in last` counts back from now."""
        tree = parse_statement(text)
        return self._query(tree, Compiler(self, params=params, now=now))

    def run(self, text: str, now=None, **params) -> DataFrame | None:
        """Any statement; queries and explain give rows, the others None."""
        return self._run(parse_statement(text), Compiler(self, params=params, now=now))

    def _query(self, tree: object, c: Compiler) -> DataFrame:
        match tree:
            case ast.Pipeline():
                return c.pipeline(tree).named()
            case ast.Distinct(query):
                return self._query(query, c).distinct()
            case ast.SetOp(op, left, right):
                return set_op(op, self._query(left, c), self._query(right, c))
            case ast.With(name, query, body):
                inner = Compiler(self, {**c.scope, name: self._query(query, c)}, c.params, c.now)
                return self._query(body, inner)
        raise BindError("not a query")

    def _run(self, tree: object, c: Compiler) -> DataFrame | None:
        match tree:
            case ast.CreateView(name, query):
                self._free(name)
                self._query(query, c)
                self.views[name] = query
            case ast.CreateTable(name, columns, key):
                self._free(name)
                if key is not None and key not in [x.name for x in columns]:
                    raise BindError(f"the primary key {key} is no column")
                schema = T.StructType([T.StructField(x.name, _TYPES[x.type], True, {"not_null": x.not_null or x.name == key}) for x in columns])
                self.register(name, self.spark.createDataFrame([], schema), key)
            case ast.CreateIndex(name, table, column):
                if column not in self.table(table).columns:
                    raise BindError(f"{table} has no column {column}")
                self.indexes[name] = (table, column)
            case ast.Drop(kind, name):
                held = {"table": self.tables, "view": self.views, "index": self.indexes}[kind]
                if name not in held:
                    raise BindError(f"no {kind} is called {name}")
                del held[name]
                if kind == "table":
                    self.keys.pop(name, None)
            case ast.Insert(table, values, upsert):
                self._insert(table, dict(values), upsert, c)
            case ast.Update(table, values, condition):
                df = self._base(table)
                rel = rel_of(df, table)
                hit = F.coalesce(c.expr(rel, condition).column, F.lit(False)) if condition is not None else F.lit(True)
                new = dict(values)
                self._known(df, new)
                self.tables[table] = df.select(*[F.when(hit, c.expr(rel, new[f.name]).column.cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in new else F.col(f.name) for f in df.schema])
            case ast.Delete(table, condition):
                df = self._base(table)
                gone = F.coalesce(c.expr(rel_of(df, table), condition).column, F.lit(False)) if condition is not None else F.lit(True)
                self.tables[table] = df.filter(~gone)
            case ast.Transaction("begin"):
                self._snapshots.append(tuple(dict(x) for x in self._state()))
            case ast.Transaction(action):
                if not self._snapshots:
                    raise BindError(f"{action} without begin")
                old = self._snapshots.pop()
                if action == "rollback":
                    for held, was in zip(self._state(), old):
                        held.clear()
                        held.update(was)
            case ast.Explain(statement, analyze):
                return self._explain(statement, analyze, c)
            case _:
                return self._query(tree, c)
        return None

    def _state(self) -> tuple[dict, ...]:
        return self.tables, self.views, self.keys, self.indexes, self.graphs

    def _free(self, name: str) -> None:
        if name in self.tables or name in self.views:
            raise BindError(f"{name} exists")

    def _base(self, table: str) -> DataFrame:
        if table not in self.tables:
            raise BindError(f"no table is called {table}")
        return self.tables[table]

    @staticmethod
    def _known(df: DataFrame, values: dict) -> None:
        if lost := set(values) - set(df.columns):
            raise BindError(f"no column is called {', '.join(sorted(lost))}")

    def _insert(self, table: str, values: dict, upsert: bool, c: Compiler) -> None:
        df = self._base(table)
        self._known(df, values)
        one = rel_of(self.spark.range(1), None)
        for f in df.schema:
            if f.metadata.get("not_null") and (f.name not in values or values[f.name] == ast.Literal(None)):
                raise BindError(f"{f.name} is not null")
        held = {f.name for f in df.schema if f.metadata.get("not_null")}
        row = one.df.select(*[(c.expr(one, values[f.name]).column if f.name in values else F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
        if held and (lost := [k for k, v in row.select(*sorted(held)).first().asDict().items() if v is None]):
            raise BindError(f"{', '.join(lost)} is not null")
        if upsert:
            key = self.keys.get(table)
            if key is None or key not in values:
                raise BindError("upsert needs a primary key and its value")
            df = df.join(row.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
        self.tables[table] = df.unionByName(row)

    def _explain(self, statement: object, analyze: bool, c: Compiler) -> DataFrame:
        df = self._query(statement, c)
        text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "cost")
        rows = [(i, line) for i, line in enumerate(text.splitlines())]
        if analyze:
            rows.append((len(rows), f"actual rows: {df.count()}"))
        return self.spark.createDataFrame(rows, "line int, plan string").orderBy("line")
