"""Recursive descent over tokens."""

from __future__ import annotations

from collections.abc import Callable

from . import ast
from .tokens import SyntaxFault, Token, UnexpectedEnd, tokenize

_COMPARE = ("==", "=", "!=", "<", "<=", ">", ">=")
_SETS = ("union", "intersect", "except")
_TYPES = ("i64", "u64", "f64", "bool", "string", "bytes", "timestamp", "doc")


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = tokenize(text), 0

    # -- tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def fail(self, expected: str) -> Exception:
        t = self.now
        return UnexpectedEnd(expected, t.offset) if t.kind == "end" else SyntaxFault(expected, t.text, t.offset)

    def step(self) -> Token:
        t = self.now
        self.at += 1
        return t

    def is_(self, *texts: str) -> bool:
        return self.now.text in texts and self.now.kind not in ("string", "end")

    def take(self, *texts: str) -> str | None:
        return self.step().text if self.is_(*texts) else None

    def need(self, *texts: str) -> str:
        got = self.take(*texts)
        if got is None:
            raise self.fail(" or ".join(map(repr, texts)))
        return got

    def name(self, what: str = "a name") -> str:
        if self.now.kind not in ("ident", "keyword"):
            raise self.fail(what)
        return self.step().text

    def ident(self, what: str = "a name") -> str:
        if self.now.kind != "ident":
            raise self.fail(what)
        return self.step().text

    def integer(self) -> int:
        if self.now.kind != "int":
            raise self.fail("an integer")
        return self.step().value

    def duration(self) -> ast.Duration:
        if self.now.kind != "duration":
            raise self.fail("a duration")
        return ast.Duration(self.step().text)

    def list_of(self, one: Callable, close: str) -> tuple:
        out = []
        while not self.is_(close):
            out.append(one())
            if not self.take(","):
                break
        self.need(close)
        return tuple(out)

    # -- expressions

    def path(self) -> ast.Ref:
        parts = [self.ident("a column")]
        while True:
            if self.take("."):
                parts.append(self.name("a part of a path"))
            elif self.is_("[") and self.tokens[self.at + 1].text == "*":
                self.step(), self.step()
                self.need("]")
                parts.append("*")
            else:
                return ast.Ref(tuple(parts))

    def expr(self) -> object:
        e = self.conjunction()
        while self.take("or"):
            e = ast.Binary("or", e, self.conjunction())
        return e

    def conjunction(self) -> object:
        e = self.negation()
        while self.take("and"):
            e = ast.Binary("and", e, self.negation())
        return e

    def negation(self) -> object:
        if self.take("not"):
            return ast.Unary("not", self.negation())
        return self.comparison()

    def comparison(self) -> object:
        e = self.sum_()
        if op := self.take(*_COMPARE):
            e = ast.Binary("==" if op == "=" else op, e, self.sum_())
        elif self.is_("in"):
            self.step()
            if self.take("last"):
                self.need("(")
                e = ast.InLast(e, self.duration())
            else:
                self.need("(")
                e = ast.InQuery(e, self.pipeline())
            self.need(")")
        return e

    def sum_(self) -> object:
        e = self.product()
        while op := self.take("+", "-"):
            e = ast.Binary(op, e, self.product())
        return e

    def product(self) -> object:
        e = self.primary()
        while op := self.take("*", "/"):
            e = ast.Binary(op, e, self.primary())
        return e

    def primary(self) -> object:
        t = self.now
        if t.kind in ("int", "float", "string"):
            return ast.Literal(self.step().value)
        if t.kind == "param":
            return ast.Param(self.step().value)
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("-"):
            e = self.primary()
            return ast.Literal(-e.value) if isinstance(e, ast.Literal) and isinstance(e.value, (int, float)) and not isinstance(e.value, bool) else ast.Unary("-", e)
        if t.kind == "ident":
            if t.text in ("true", "false", "null") and self.tokens[self.at + 1].text not in (".", "("):
                self.step()
                return ast.Literal({"true": True, "false": False, "null": None}[t.text])
            if self.tokens[self.at + 1].text == "(":
                self.step(), self.step()
                return ast.Call(t.text, self.list_of(self.expr, ")"))
            return self.path()
        raise self.fail("an expression")

    # -- stages

    def item(self) -> ast.Item:
        e = self.expr()
        return ast.Item(e, self.ident("an alias") if self.take("as") else None)

    def aggregate(self) -> ast.Aggregate:
        name = self.name("an aggregate's name")
        self.need(":")
        function = self.ident("an aggregate function")
        self.need("(")
        return ast.Aggregate(name, function, self.list_of(self.expr, ")"))

    def aggregates(self) -> tuple:
        self.need("{")
        found = self.list_of(self.aggregate, "}")
        if not found:
            self.at -= 1
            raise self.fail("an aggregate")
        return found

    def keys(self) -> tuple[ast.Ref, ...]:
        found = [self.path()]
        while self.take(","):
            found.append(self.path())
        return tuple(found)

    def source(self) -> ast.From:
        if self.take("("):
            q = self.pipeline()
            self.need(")")
            return ast.From(query=q)
        first = self.ident("a source")
        if self.now.kind == "ident" and self.now.text not in _SETS:
            return ast.From(self.step().text, first)
        return ast.From(first)

    def stage(self) -> object:
        if self.take("filter"):
            return ast.Filter(self.expr())
        if self.take("select"):
            self.need("{")
            return ast.Select(self.list_of(self.item, "}"))
        if self.take("sort"):
            ref = self.path()
            return ast.Sort(ref, self.take("asc", "desc") == "desc")
        if self.take("take"):
            return ast.Take(self.integer())
        if self.is_("join", "inner", "left", "right", "full"):
            kind = self.take("inner", "left", "right", "full")
            self.need("join")
            kind = kind or self.take("inner", "left", "right", "full") or "inner"
            source = self.ident("a source")
            alias = self.step().text if self.now.kind == "ident" else None
            self.need("on")
            return ast.Join(kind, source, alias, self.expr())
        if self.take("group_by"):
            return ast.GroupBy(self.keys(), self.aggregates())
        if self.take("window"):
            kind = self.need("tumbling", "hopping", "session")
            self.need("(")
            spans = [self.duration()]
            if kind == "hopping":
                self.need(",")
                spans.append(self.duration())
            self.need(")")
            self.need("on")
            on = self.path()
            keys = self.keys() if self.take("group_by") else ()
            return ast.TimeWindow(kind, tuple(spans), on, keys, self.aggregates())
        if self.is_("fill"):
            self.step()
            self.need("gaps")
            self.need("with")
            return ast.FillGaps(self.ident("a method"))
        if self.take("match"):
            return self.match()
        if self.take("return"):
            distinct = bool(self.take("distinct"))
            items = [self.item()]
            while self.take(","):
                items.append(self.item())
            return ast.Return(tuple(items), distinct)
        raise self.fail("a stage")

    def node(self) -> ast.Node:
        self.need("(")
        variable = self.ident("a node's name")
        label = self.ident("a label") if self.take(":") else None
        properties = ()
        if self.take("{"):
            properties = self.list_of(lambda: (self.name(), (self.need(":"), self.expr())[1]), "}")
        self.need(")")
        return ast.Node(variable, label, properties)

    def edge(self) -> ast.Edge:
        incoming = self.need("<-", "-") == "<-"
        self.need("[")
        kind = self.ident("an edge's type") if self.take(":") else None
        least, most = 1, 1
        if self.take("*"):
            most = None
            if self.now.kind == "int":
                least = most = self.integer()
            if self.take(".."):
                most = self.integer() if self.now.kind == "int" else None
        self.need("]")
        if incoming:
            self.need("-")
            return ast.Edge("in", kind, least, most)
        return ast.Edge("out" if self.need("->", "-") == "->" else "both", kind, least, most)

    def match(self) -> ast.Match:
        nodes, edges = [self.node()], []
        while self.is_("-", "<-"):
            edges.append(self.edge())
            nodes.append(self.node())
        if not edges:
            raise self.fail("an edge")
        return ast.Match(tuple(nodes), tuple(edges))

    def pipeline(self) -> ast.Pipeline:
        self.need("from")
        stages: list = [self.source()]
        while self.take("|"):
            stages.append(self.stage())
        return ast.Pipeline(tuple(stages))

    # -- statements

    def query(self) -> object:
        if self.take("distinct"):
            q: object = ast.Distinct(self.pipeline())
        elif self.take("("):
            q = self.query()
            self.need(")")
        else:
            q = self.pipeline()
        while self.is_(*_SETS):
            op = self.step().text
            if op == "union" and self.take("all"):
                op = "union all"
            right: object = ast.Distinct(self.pipeline()) if self.take("distinct") else self.pipeline()
            q = ast.SetOp(op, q, right)
        return q

    def assignment(self, sep: str) -> tuple[str, object]:
        name = self.name("a column")
        self.need(sep)
        return name, self.expr()

    def statement(self) -> object:
        if self.is_("from", "distinct", "("):
            return self.query()
        word = self.now.text
        if word not in ("with", "create", "drop", "insert", "upsert", "update", "delete", "begin", "commit", "rollback", "explain"):
            raise self.fail("a statement")
        self.step()
        if word == "with":
            name = self.ident()
            self.need("as")
            self.need("(")
            q = self.query()
            self.need(")")
            return ast.With(name, q, self.statement() if self.is_("with") else self.query())
        if word == "create":
            kind = self.need("table", "view", "index")
            name = self.ident()
            if kind == "view":
                self.need("as")
                return ast.CreateView(name, self.query())
            if kind == "index":
                self.need("on")
                table = self.ident()
                self.need("(")
                column = self.ident()
                self.need(")")
                return ast.CreateIndex(name, table, column)
            return self.table(name)
        if word == "drop":
            return ast.Drop(self.need("table", "view", "index"), self.ident())
        if word in ("insert", "upsert"):
            self.need("into")
            table = self.ident()
            self.need("{")
            return ast.Insert(table, self.list_of(lambda: self.assignment(":"), "}"), word == "upsert")
        if word == "update":
            table = self.ident()
            self.need("set")
            values = [self.assignment("=")]
            while self.take(","):
                values.append(self.assignment("="))
            return ast.Update(table, tuple(values), self.expr() if self.take("where") else None)
        if word == "delete":
            self.need("from")
            table = self.ident()
            return ast.Delete(table, self.expr() if self.take("where") else None)
        if word == "explain":
            analyze = bool(self.take("analyze"))
            return ast.Explain(self.statement(), analyze)
        return ast.Transaction(word)

    def table(self, name: str) -> ast.CreateTable:
        self.need("{")
        columns, key = [], None
        while not self.is_("}"):
            column = self.name("a column")
            self.need(":")
            if column == "primary_key":
                key = self.ident()
            else:
                kind = self.ident("a type")
                if kind not in _TYPES:
                    self.at -= 1
                    raise self.fail("a type of " + ", ".join(_TYPES))
                not_null = bool(self.take("not"))
                if not_null:
                    self.need("null")
                columns.append(ast.ColumnDef(column, kind, not_null))
            if not self.take(","):
                break
        self.need("}")
        return ast.CreateTable(name, tuple(columns), key)

    def end(self, tree: object) -> object:
        self.take(";")
        if self.now.kind != "end":
            raise self.fail("the end")
        return tree


def parse(text: str) -> ast.Pipeline:
    """A pipeline, and nothing after it."""
    p = _Parser(text)
    return p.end(p.pipeline())


def parse_statement(text: str) -> object:
    """Any statement, and nothing after it."""
    p = _Parser(text)
    return p.end(p.statement())
