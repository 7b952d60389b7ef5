"""Syntax trees back to text that parses to the same tree."""

from __future__ import annotations

from . import ast

_LEVEL = {"or": 1, "and": 2, "==": 4, "!=": 4, "<": 4, "<=": 4, ">": 4, ">=": 4, "+": 5, "-": 5, "*": 6, "/": 6}


def _string(s: str) -> str:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        s = s.replace(a, b)
    return f'"{s}"'


def _path(ref: ast.Ref) -> str:
    out = ref.path[0]
    for p in ref.path[1:]:
        out += "[*]" if p == "*" else f".{p}"
    return out


def _expr(e: object, level: int = 0) -> str:
    match e:
        case ast.Literal(value):
            if value is None or isinstance(value, bool):
                return {None: "null", True: "true", False: "false"}[value]
            if isinstance(value, str):
                return _string(value)
            text = format(value, "f") if isinstance(value, float) and "e" in repr(value) else repr(value)
            return text if value >= 0 else f"({text})" if level > 6 else text
        case ast.Ref():
            return _path(e)
        case ast.Param(name):
            return f"${name}"
        case ast.Call(name, args):
            return f"{name}({', '.join(map(_expr, args))})"
        case ast.Binary(op, left, right):
            own = _LEVEL[op]
            # comparisons don't chain; the others group to the left
            text = f"{_expr(left, own + (own == 4))} {op} {_expr(right, own + 1)}"
            return f"({text})" if own < level else text
        case ast.Unary("not", operand):
            text = f"not {_expr(operand, 3)}"
            return f"({text})" if level > 3 else text
        case ast.Unary("-", operand):
            return f"-{_expr(operand, 7)}"
        case ast.InQuery(operand, query):
            text = f"{_expr(operand, 5)} in ({unparse(query)})"
        case ast.InLast(operand, span):
            text = f"{_expr(operand, 5)} in last({span.text})"
        case _:
            raise TypeError(f"not an expression: {e!r}")
    return f"({text})" if level > 4 else text


def _item(i: ast.Item) -> str:
    return _expr(i.expr) + (f" as {i.alias}" if i.alias else "")


def _aggregates(found: tuple) -> str:
    return "{ " + ", ".join(f"{a.name}: {a.function}({', '.join(map(_expr, a.args))})" for a in found) + " }"


def _node(n: ast.Node) -> str:
    inside = n.variable + (f":{n.label}" if n.label else "")
    if n.properties:
        inside += " {" + ", ".join(f"{k}: {_expr(v)}" for k, v in n.properties) + "}"
    return f"({inside})"


def _edge(e: ast.Edge) -> str:
    hops = ""
    if (e.least, e.most) != (1, 1):
        hops = f"*{e.least}" + ("" if e.most == e.least else f"..{'' if e.most is None else e.most}")
    inside = f"[{':' + e.type if e.type else ''}{hops}]"
    return {"out": f"-{inside}->", "in": f"<-{inside}-", "both": f"-{inside}-"}[e.direction]


def _keys(keys: tuple) -> str:
    return ", ".join(map(_path, keys))


def _stage(s: object) -> str:
    match s:
        case ast.From(query=q) if q is not None:
            return f"from ({unparse(q)})"
        case ast.From(name, kind):
            return f"from {kind + ' ' if kind else ''}{name}"
        case ast.Filter(condition):
            return f"filter {_expr(condition)}"
        case ast.Select(items):
            return "select { " + ", ".join(map(_item, items)) + " }"
        case ast.Sort(ref, descending):
            return f"sort {_path(ref)} {'desc' if descending else 'asc'}"
        case ast.Take(n):
            return f"take {n}"
        case ast.Join(kind, source, alias, on):
            return f"join {kind} {source} {alias + ' ' if alias else ''}on {_expr(on)}"
        case ast.GroupBy(keys, found):
            return f"group_by {_keys(keys)} {_aggregates(found)}"
        case ast.TimeWindow(kind, spans, on, keys, found):
            by = f" group_by {_keys(keys)}" if keys else ""
            return f"window {kind}({', '.join(d.text for d in spans)}) on {_path(on)}{by} {_aggregates(found)}"
        case ast.FillGaps(method):
            return f"fill gaps with {method}"
        case ast.Match(nodes, edges):
            return "match " + _node(nodes[0]) + "".join(_edge(e) + _node(n) for e, n in zip(edges, nodes[1:]))
        case ast.Return(items, distinct):
            return f"return {'distinct ' if distinct else ''}{', '.join(map(_item, items))}"
    raise TypeError(f"not a stage: {s!r}")


def unparse(tree: object) -> str:
    match tree:
        case ast.Pipeline(stages):
            return " | ".join(map(_stage, stages))
        case ast.SetOp(op, left, right):
            return f"{unparse(left)} {op} {unparse(right)}"
        case ast.Distinct(query):
            return f"distinct {unparse(query)}"
        case ast.With(name, query, body):
            return f"with {name} as ({unparse(query)}) {unparse(body)}"
        case ast.CreateView(name, query):
            return f"create view {name} as {unparse(query)}"
        case ast.CreateTable(name, columns, key):
            parts = [f"{c.name}: {c.type}{' not null' if c.not_null else ''}" for c in columns] + ([f"primary_key: {key}"] if key else [])
            return f"create table {name} {{ {', '.join(parts)} }}"
        case ast.CreateIndex(name, table, column):
            return f"create index {name} on {table}({column})"
        case ast.Drop(kind, name):
            return f"drop {kind} {name}"
        case ast.Insert(table, values, upsert):
            return f"{'upsert' if upsert else 'insert'} into {table} {{ {', '.join(f'{k}: {_expr(v)}' for k, v in values)} }}"
        case ast.Update(table, values, condition):
            return f"update {table} set {', '.join(f'{k} = {_expr(v)}' for k, v in values)}" + (f" where {_expr(condition)}" if condition is not None else "")
        case ast.Delete(table, condition):
            return f"delete from {table}" + (f" where {_expr(condition)}" if condition is not None else "")
        case ast.Transaction(action):
            return action
        case ast.Explain(statement, analyze):
            return f"explain {'analyze ' if analyze else ''}{unparse(statement)}"
    return _expr(tree)
