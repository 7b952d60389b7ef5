"""Syntax trees: expressions, stages of a pipeline, statements."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Duration:
    text: str

    @property
    def millis(self) -> int:
        unit = "ms" if self.text.endswith("ms") else self.text[-1]
        return int(self.text[: -len(unit)]) * {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}[unit]


# -- expressions

@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool | None


@dataclass(frozen=True)
class Ref:
    """A dotted path; a part `*` takes all elements of an array."""

    path: tuple[str, ...]


@dataclass(frozen=True)
class Param:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Binary:
    op: str  # or and == != < <= > >= + - * /
    left: object
    right: object


@dataclass(frozen=True)
class Unary:
    op: str  # not -
    operand: object


@dataclass(frozen=True)
class InQuery:
    operand: object
    query: Pipeline


@dataclass(frozen=True)
class InLast:
    operand: object
    span: Duration


# -- stages

@dataclass(frozen=True)
class From:
    """A named source (kind is the first of two words, as in `graph social`) or a pipeline."""

    name: str | None = None
    kind: str | None = None
    query: Pipeline | None = None


@dataclass(frozen=True)
class Filter:
    condition: object


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]


@dataclass(frozen=True)
class Sort:
    ref: Ref
    descending: bool = False


@dataclass(frozen=True)
class Take:
    n: int


@dataclass(frozen=True)
class Join:
    kind: str
    source: str
    alias: str | None
    on: object


@dataclass(frozen=True)
class Aggregate:
    name: str
    function: str
    args: tuple


@dataclass(frozen=True)
class GroupBy:
    keys: tuple[Ref, ...]
    aggregates: tuple[Aggregate, ...]


@dataclass(frozen=True)
class TimeWindow:
    kind: str  # tumbling hopping session
    spans: tuple[Duration, ...]
    on: Ref
    keys: tuple[Ref, ...]
    aggregates: tuple[Aggregate, ...]


@dataclass(frozen=True)
class FillGaps:
    method: str


@dataclass(frozen=True)
class Node:
    variable: str
    label: str | None = None
    properties: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class Edge:
    direction: str  # out in both
    type: str | None = None
    least: int = 1
    most: int | None = 1  # None: as many as the engine allows


@dataclass(frozen=True)
class Match:
    nodes: tuple[Node, ...]
    edges: tuple[Edge, ...]


@dataclass(frozen=True)
class Return:
    items: tuple[Item, ...]
    distinct: bool = False


@dataclass(frozen=True)
class Pipeline:
    stages: tuple


# -- statements

@dataclass(frozen=True)
class SetOp:
    op: str  # union, union all, intersect, except
    left: object
    right: object


@dataclass(frozen=True)
class Distinct:
    query: Pipeline


@dataclass(frozen=True)
class With:
    name: str
    query: object
    body: object


@dataclass(frozen=True)
class CreateView:
    name: str
    query: object


@dataclass(frozen=True)
class ColumnDef:
    name: str
    type: str
    not_null: bool = False


@dataclass(frozen=True)
class CreateTable:
    name: str
    columns: tuple[ColumnDef, ...]
    primary_key: str | None = None


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str


@dataclass(frozen=True)
class Drop:
    kind: str  # table view index
    name: str


@dataclass(frozen=True)
class Insert:
    table: str
    values: tuple[tuple[str, object], ...]
    upsert: bool = False


@dataclass(frozen=True)
class Update:
    table: str
    values: tuple[tuple[str, object], ...]
    condition: object | None = None


@dataclass(frozen=True)
class Delete:
    table: str
    condition: object | None = None


@dataclass(frozen=True)
class Transaction:
    action: str  # begin commit rollback


@dataclass(frozen=True)
class Explain:
    statement: object
    analyze: bool = False
    options: dict = field(default_factory=dict, compare=False, hash=False)
