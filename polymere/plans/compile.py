"""From syntax trees to DataFrames.

A compiled pipeline is a Rel: a DataFrame whose columns have unique names, and
for each the source alias and name by which the language refers to it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import registry
from ..lang import ast
from ..operators import graph, series

if TYPE_CHECKING:
    from ..engine import Engine

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class BindError(ValueError):
    """A name that is unknown or ambiguous, or an operation that a stage can't take."""


@dataclass(frozen=True)
class Col:
    inner: str
    alias: str | None
    name: str


@dataclass
class Rel:
    df: DataFrame
    cols: list[Col]
    graph: graph.Graph | None = None
    window: tuple[int, list[str]] | None = None  # size and keys of a tumbling window just made
    hops: str | None = None
    sorts: list[Column] = field(default_factory=list)

    def named(self) -> DataFrame:
        """The DataFrame with the names that the language gives its columns."""
        seen: dict[str, int] = {}
        for c in self.cols:
            seen[c.name] = seen.get(c.name, 0) + 1
        return self.df.select(*[F.col(f"`{c.inner}`").alias(c.name if seen[c.name] == 1 or c.alias is None else f"{c.alias}.{c.name}") for c in self.cols])


def rel_of(df: DataFrame, alias: str | None) -> Rel:
    return Rel(df, [Col(c, alias, c) for c in df.columns])


@dataclass
class Value:
    """A compiled expression; kind is its type, None for a value whose type the other operand decides (a path into JSON)."""

    column: Column
    kind: T.DataType | None
    literal: object = None

    def as_(self, kind: T.DataType) -> Value:
        if self.kind is not None:
            return self
        return Value(self.column.try_cast(kind), kind)

    @property
    def text(self) -> Value:
        return self if self.kind is not None else Value(self.column, T.StringType())


@dataclass(frozen=True)
class _Flag:
    """A column in place of an expression."""

    column: str


class Compiler:
    def __init__(self, engine: Engine, scope: dict[str, DataFrame] | None = None, params: dict | None = None, now=None) -> None:
        self.engine, self.scope, self.params, self.now = engine, scope or {}, params or {}, now

    # -- names

    def resolve(self, rel: Rel, path: tuple[str, ...]) -> Value:
        if len(path) > 1:
            found = [c for c in rel.cols if c.alias == path[0] and c.name == path[1]]
            if found:
                return self.nested(rel, found[0].inner, path[2:])
            whole = [c for c in rel.cols if c.name == ".".join(path)]
            if len(whole) == 1:
                return self.nested(rel, whole[0].inner, ())
        found = [c for c in rel.cols if c.name == path[0]]
        if len(found) > 1:
            raise BindError(f"{path[0]} is ambiguous: it is in {', '.join(str(c.alias) for c in found)}")
        if not found:
            if len(path) == 1 and any(c.alias == path[0] and c.name == "id" for c in rel.cols):
                return self.resolve(rel, (path[0], "id"))
            raise BindError(f"no column is called {'.'.join(path)}; there are {', '.join(c.name for c in rel.cols)}")
        return self.nested(rel, found[0].inner, path[1:])

    def nested(self, rel: Rel, inner: str, rest: tuple[str, ...]) -> Value:
        column, kind = F.col(f"`{inner}`"), rel.df.schema[inner].dataType
        return self.walk(column, kind, rest)

    def walk(self, column: Column, kind: T.DataType, rest: tuple[str, ...]) -> Value:
        if not rest:
            return Value(column, kind)
        head, tail = rest[0], rest[1:]
        if isinstance(kind, T.StructType):
            if head not in kind.names:
                raise BindError(f"no field is called {head}")
            return self.walk(column[head], kind[head].dataType, tail)
        if isinstance(kind, T.MapType):
            return self.walk(column[head], kind.valueType, tail)
        if isinstance(kind, T.ArrayType) and head == "*":
            inner = self.walk(F.lit(None).cast(kind.elementType), kind.elementType, tail).kind
            return Value(F.transform(column, lambda x: self.walk(x, kind.elementType, tail).column), T.ArrayType(inner))
        if isinstance(kind, (T.StringType, T.VariantType)):
            if "*" in rest:
                json = column if isinstance(kind, T.StringType) else F.to_json(column)
                return Value(F.from_json(F.get_json_object(json, "$" + "".join("[*]" if p == "*" else f".{p}" for p in rest)), "array<string>"), T.ArrayType(T.StringType()))
            if isinstance(kind, T.VariantType):
                return Value(F.try_variant_get(column, "$" + "".join(f".{p}" for p in rest), "string"), None)
            return Value(F.get_json_object(column, "$" + "".join(f".{p}" for p in rest)), None)
        raise BindError(f"{kind.simpleString()} has no part {head}")

    # -- expressions

    def expr(self, rel: Rel, e: object) -> Value:
        match e:
            case ast.Literal(value):
                kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value), T.NullType())
                column = F.lit(value).cast("bigint") if kind == T.LongType() else F.lit(value)
                return Value(column, kind, value)
            case ast.Param(name):
                if name not in self.params:
                    raise BindError(f"no value is given for ${name}")
                return self.expr(rel, ast.Literal(self.params[name]))
            case ast.Ref(path):
                return self.resolve(rel, path)
            case ast.Unary("not", operand):
                return Value(~self.expr(rel, operand).as_(T.BooleanType()).column, T.BooleanType())
            case ast.Unary("-", operand):
                v = self.expr(rel, operand).as_(T.DoubleType())
                return Value(F.try_subtract(F.lit(0).cast(v.kind), v.column), v.kind)
            case ast.InLast(operand, span):
                if self.now is None:
                    raise BindError("`in last` needs the engine's parameter now")
                ts = self.expr(rel, operand).column
                now = F.lit(self.now).cast("timestamp_ntz")
                return Value((ts >= now - F.expr(f"INTERVAL {span.millis * 1000} MICROSECOND")) & (ts <= now), T.BooleanType())
            case ast.Call("path_length", ()):
                if rel.hops is None:
                    raise BindError("path_length() is for rows of a match")
                return Value(F.col(rel.hops), T.IntegerType())
            case ast.Call(name, args):
                return self.call(rel, name, [self.expr(rel, a).text for a in args])
            case ast.Binary(op, left, right):
                return self.binary(op, self.expr(rel, left), self.expr(rel, right))
            case _Flag(column):
                return Value(F.col(column), T.BooleanType())
            case ast.InQuery():
                raise BindError("`in (query)` is for filter and select")
        raise TypeError(f"not an expression: {e!r}")

    def call(self, rel: Rel, name: str, args: list[Value]) -> Value:
        columns = [a.column for a in args]
        if name in self.engine.functions:
            column = self.engine.functions[name](*columns)
        elif name in registry.BUILT_IN:
            column = F.call_function(name, *columns)
        else:
            raise BindError(f"no function is called {name}")
        return Value(column, rel.df.select(column.alias("x")).schema["x"].dataType)

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("and", "or"):
            x, y = a.as_(T.BooleanType()).column, b.as_(T.BooleanType()).column
            return Value(x & y if op == "and" else x | y, T.BooleanType())
        if a.kind is None and b.kind is None:
            a, b = (a.text, b.text) if op in ("==", "!=", "<", "<=", ">", ">=") else (a.as_(T.DoubleType()), b.as_(T.DoubleType()))
        a, b = a.as_(b.kind) if b.kind is not None else a, b.as_(a.kind) if a.kind is not None else b
        x, y = a.column, b.column
        if op in ("==", "!=", "<", "<=", ">", ">="):
            made = {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
            return Value(made, T.BooleanType())
        whole = isinstance(a.kind, _INTEGRAL) and isinstance(b.kind, _INTEGRAL)
        if whole:
            x, y = x.cast("bigint"), y.cast("bigint")
            if op == "/":
                # division by zero and the one overflow, of the least number by -1, give null
                safe = F.when((y == 0) | ((y == -1) & (x == F.lit(-(1 << 63)))), F.lit(None)).otherwise(y)
                return Value(F.call_function("div", x, safe), T.LongType())
        made = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply, "/": F.try_divide}[op](x, y)
        return Value(made, T.LongType() if whole else T.DoubleType() if not isinstance(a.kind, T.DecimalType) and not isinstance(b.kind, T.DecimalType) else T.DecimalType(38, 18))

    # -- stages

    def source(self, name: str, kind: str | None = None) -> Rel:
        if kind == "graph":
            g = self.engine.graphs.get(name)
            if g is None:
                raise BindError(f"no graph is called {name}")
            return replace(rel_of(g.nodes, name), graph=g)
        if kind is not None:
            name = f"{kind} {name}" if f"{kind} {name}" in self.engine.tables else name
        return rel_of(self.scope[name] if name in self.scope else self.engine.table(name), name)

    def pipeline(self, p: ast.Pipeline) -> Rel:
        rel: Rel | None = None
        for stage in p.stages:
            if not isinstance(stage, ast.Sort) and rel is not None and rel.sorts and not isinstance(stage, ast.Take):
                rel = replace(rel, sorts=[])  # an order that nothing takes from has no effect on a set of rows
            rel = self.stage(rel, stage)
        return self.ordered(rel)

    def ordered(self, rel: Rel) -> Rel:
        return replace(rel, df=rel.df.orderBy(*rel.sorts), sorts=[]) if rel.sorts else rel

    def stage(self, rel: Rel | None, s: object) -> Rel:
        match s:
            case ast.From(query=q) if q is not None:
                inner = self.pipeline(q)
                return rel_of(inner.named(), None)
            case ast.From(name, kind):
                return self.source(name, kind)
            case ast.Filter(condition):
                return self.filter(rel, condition)
            case ast.Select(items):
                return self.project(rel, items)
            case ast.Sort(ref, descending):
                c = self.resolve(rel, ref.path).column
                # a later sort is stable: it comes before the earlier ones
                return replace(rel, sorts=[c.desc_nulls_last() if descending else c.asc_nulls_first(), *rel.sorts])
            case ast.Take(n):
                out = self.ordered(rel)
                return replace(out, df=out.df.limit(n))
            case ast.Join(kind, source, alias, on):
                return self.join(rel, kind, source, alias, on)
            case ast.GroupBy(keys, found):
                columns, cols = self.keys(rel, keys)
                df = rel.df.groupBy(*columns).agg(*self.aggregates(rel, found))
                return Rel(df, [*cols, *[Col(a.name, None, a.name) for a in found]])
            case ast.TimeWindow():
                return self.window(rel, s)
            case ast.FillGaps(method):
                if rel.window is None:
                    raise BindError("fill gaps follows a tumbling window")
                size, keys = rel.window
                return replace(rel, df=series.fill_gaps(rel.df, size, keys, method).select(*rel.df.columns))
            case ast.Match():
                return self.match(rel, s)
            case ast.Return(items, distinct):
                out = self.project(rel, items)
                return replace(out, df=out.df.distinct()) if distinct else out
        raise TypeError(f"not a stage: {s!r}")

    def filter(self, rel: Rel, condition: object) -> Rel:
        if isinstance(condition, ast.Binary) and condition.op == "and" and _has_query(condition):
            return self.filter(self.filter(rel, condition.left), condition.right)
        if isinstance(condition, ast.InQuery) or isinstance(condition, ast.Unary) and condition.op == "not" and isinstance(condition.operand, ast.InQuery):
            inside = condition if isinstance(condition, ast.InQuery) else condition.operand
            v = self.expr(rel, inside.operand).text
            found = self.pipeline(inside.query).df
            keys = found.select(F.col(f"`{found.columns[0]}`").alias("__member")).filter("__member is not null").distinct()
            how = "left_semi" if inside is condition else "left_anti"
            df = rel.df.withColumn("__probe", v.column)
            if how == "left_anti":  # null is neither in nor out
                df = df.filter("__probe is not null")
            return replace(rel, df=df.join(keys, F.col("__probe") == F.col("__member"), how).drop("__probe"))
        marked, condition, flags = self.marked(rel, condition)
        return replace(rel, df=marked.df.filter(self.expr(marked, condition).as_(T.BooleanType()).column).drop(*flags))

    def marked(self, rel: Rel, e: object) -> tuple[Rel, object, list[str]]:
        """rel with a column for each `in (query)` within e, which tells whether the row's value is among the query's; and e with these columns."""
        flags: list[str] = []

        def walk(rel: Rel, e: object) -> tuple[Rel, object]:
            match e:
                case ast.InQuery(operand, query):
                    rel, operand = walk(rel, operand)
                    flag = f"__in{len(rel.df.columns)}"
                    found = self.pipeline(query).df
                    keys = found.select(F.col(f"`{found.columns[0]}`").alias("__member"), F.lit(True).alias(flag)).filter("__member is not null").distinct()
                    df = rel.df.withColumn("__probe", self.expr(rel, operand).text.column)
                    # a null is neither in nor out
                    there = F.when(F.col("__probe").isNotNull(), F.coalesce(flag, F.lit(False)))
                    df = df.join(keys, F.col("__probe") == F.col("__member"), "left").withColumn(flag, there).drop("__probe", "__member")
                    flags.append(flag)
                    return replace(rel, df=df), _Flag(flag)
                case ast.Binary(op, a, b):
                    rel, a = walk(rel, a)
                    rel, b = walk(rel, b)
                    return rel, ast.Binary(op, a, b)
                case ast.Unary(op, a):
                    rel, a = walk(rel, a)
                    return rel, ast.Unary(op, a)
                case ast.Call(name, args):
                    out = []
                    for a in args:
                        rel, a = walk(rel, a)
                        out.append(a)
                    return rel, ast.Call(name, tuple(out))
            return rel, e

        rel, e = walk(rel, e)
        return rel, e, flags

    def project(self, rel: Rel, items: tuple[ast.Item, ...]) -> Rel:
        columns, cols = [], []
        for i, item in enumerate(items):
            rel, expr, _ = self.marked(rel, item.expr)
            v = self.expr(rel, expr).text
            if item.alias:
                name = item.alias
            elif isinstance(item.expr, ast.Ref):
                name = ".".join(p for p in item.expr.path if p != "*") if len(item.expr.path) > 1 else item.expr.path[0]
            else:
                name = f"column{i + 1}"
            inner = name if name not in [c.inner for c in cols] else f"{name}__{i}"
            columns.append(v.column.alias(inner))
            cols.append(Col(inner, None, name))
        return Rel(rel.df.select(*columns), cols)

    def keys(self, rel: Rel, keys: tuple[ast.Ref, ...]) -> tuple[list[Column], list[Col]]:
        columns, cols = [], []
        for k in keys:
            name = ".".join(k.path) if len(k.path) > 1 else k.path[0]
            columns.append(self.resolve(rel, k.path).text.column.alias(name))
            cols.append(Col(name, None, name))
        return columns, cols

    def aggregates(self, rel: Rel, found: tuple[ast.Aggregate, ...]) -> list[Column]:
        out = []
        for a in found:
            values = [self.expr(rel, x) for x in a.args]
            if a.function in self.engine.aggregates:
                out.append(self.engine.aggregates[a.function](*[v.text.column for v in values]).alias(a.name))
                continue
            numeric = a.function in ("sum", "mean", "avg", "percentile", "stddev", "variance", "median")
            columns = [(v.as_(T.DoubleType()) if numeric else v.text).column for v in values]
            try:
                out.append(registry.aggregate(a.function, columns, lambda i, values=values: float(values[i].literal)).alias(a.name))
            except ValueError as e:
                raise BindError(str(e)) from None
        return out

    def join(self, rel: Rel, kind: str, source: str, alias: str | None, on: object) -> Rel:
        other = self.source(source)
        alias = alias or source
        taken = {c.inner for c in rel.cols}
        names = {}
        for c in other.cols:
            inner = c.inner
            while inner in taken:
                inner = f"{alias}__{inner}" if not inner.startswith(f"{alias}__") else inner + "_"
            names[c.inner] = inner
            taken.add(inner)
        right = other.df.select(*[F.col(f"`{a}`").alias(b) for a, b in names.items()])
        cols = [*rel.cols, *[Col(names[c.inner], alias, c.name) for c in other.cols]]
        both = Rel(rel.df.crossJoin(right), cols, hops=rel.hops)  # for types only; the plan isn't run
        condition = self.expr(both, on).as_(T.BooleanType()).column
        return Rel(rel.df.join(right, condition, kind), cols, rel.graph, hops=rel.hops)

    def window(self, rel: Rel, s: ast.TimeWindow) -> Rel:
        ts = self.resolve(rel, s.on.path).column
        keys, cols = self.keys(rel, s.keys)
        spans = [d.millis for d in s.spans]
        df = series.windowed(rel.df, s.kind, spans, ts, keys, self.aggregates(rel, s.aggregates), self.engine.watermark)
        made = Rel(df, [Col("window_start", None, "window_start"), Col("window_end", None, "window_end"), *cols, *[Col(a.name, None, a.name) for a in s.aggregates]])
        return replace(made, window=(spans[0], [c.inner for c in cols]) if s.kind == "tumbling" else None)

    def match(self, rel: Rel, s: ast.Match) -> Rel:
        if rel.graph is None:
            raise BindError("match follows `from graph`")
        plain = rel_of(rel.graph.nodes, None)

        def chosen(n: ast.Node) -> DataFrame:
            df = rel.graph.nodes
            if n.label is not None:
                df = df.filter(F.col("label") == n.label)
            for name, value in n.properties:
                df = df.filter(self.binary("==", self.resolve(plain, (name,)), self.expr(plain, value)).column)
            return df

        walked = graph.match(rel.graph, [(n.variable, chosen(n), n.label is not None or bool(n.properties)) for n in s.nodes], [(e.direction, e.type, e.least, e.most) for e in s.edges], self.engine.max_hops)
        cols = []
        for c in walked.columns:
            alias, _, name = c.partition("__")
            cols.append(Col(c, alias if name else None, name or c))
        return Rel(walked, cols, rel.graph, hops="hops")


def _has_query(e: object) -> bool:
    match e:
        case ast.InQuery():
            return True
        case ast.Binary(_, a, b):
            return _has_query(a) or _has_query(b)
        case ast.Unary(_, a):
            return _has_query(a)
    return False


def set_op(op: str, left: DataFrame, right: DataFrame) -> DataFrame:
    if len(left.columns) != len(right.columns):
        raise BindError("the sides of a set operation have equally many columns")
    right = right.toDF(*left.columns)
    return {"union": lambda: left.union(right).distinct(), "union all": lambda: left.union(right), "intersect": lambda: left.intersect(right), "except": lambda: left.subtract(right)}[op]()
