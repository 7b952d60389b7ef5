"""RDF triples, and the part of SPARQL that selects by triple patterns and filters.

A term is text in the usual line form: <iri>, "text", "text"@lang or
"text"^^<type>, _:blank. Triples have s, p and o. A basic graph pattern becomes
equi-joins on shared variables, whose order the planner chooses.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"""\s+|(<=|>=|!=)|(<[^<>\s]*>)|("(?:[^"\\]|\\.)*"(?:@[A-Za-z-]+|\^\^<[^<>\s]*>)?)|([?$]\w+)|(-?\d+(?:\.\d+)?)|([{}().=<>*])|([A-Za-z_][\w:/#-]*)""")
_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


class SparqlError(ValueError):
    pass


@dataclass(frozen=True)
class Select:
    variables: tuple[str, ...]
    patterns: tuple[tuple[str, str, str], ...]
    filters: tuple[tuple[str, str, str], ...]
    limit: int | None
    distinct: bool


def parse(text: str) -> Select:
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SparqlError(f"nothing can be read at {text[at:at + 20]!r}")
        if m[0].strip():
            tokens.append(m[0])
        at = m.end()
    tokens.append("")
    i = 0

    def take(*wanted: str) -> str:
        nonlocal i
        t = tokens[i]
        if wanted and t.upper() not in wanted:
            raise SparqlError(f"{' or '.join(wanted)} is expected, not {t!r}")
        i += 1
        return t

    take("SELECT")
    distinct = tokens[i].upper() == "DISTINCT"
    i += distinct
    names = []
    if tokens[i] == "*":
        take()
    else:
        while tokens[i][:1] in ("?", "$"):
            names.append(take()[1:])
        if not names:
            raise SparqlError("SELECT names variables or *")
    if tokens[i].upper() == "WHERE":
        take()
    take("{")
    patterns, filters = [], []
    while tokens[i] != "}":
        if not tokens[i]:
            raise SparqlError("} is missing")
        if tokens[i].upper() == "FILTER":
            take()
            take("(")
            v = take()
            if v[:1] not in ("?", "$"):
                raise SparqlError("FILTER compares a variable")
            filters.append((v[1:], take("=", "!=", "<", "<=", ">", ">="), take()))
            take(")")
        else:
            s, p, o = take(), take(), take()
            patterns.append((s, _TYPE if p == "a" else p, o))
        if tokens[i] == ".":
            take()
    take("}")
    limit = None
    if tokens[i].upper() == "LIMIT":
        take()
        limit = int(take())
    if tokens[i]:
        raise SparqlError(f"{tokens[i]!r} is left over")
    if not names:
        names = list(dict.fromkeys(t[1:] for x in patterns for t in x if t[:1] in ("?", "$")))
    return Select(tuple(names), tuple(patterns), tuple(filters), limit, distinct)


def lexical(term: Column) -> Column:
    """The text of a term, without quotes, brackets, language or type."""
    return F.when(term.startswith('"'), F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1)).when(term.startswith("<"), F.regexp_extract(term, r"^<(.*)>$", 1)).otherwise(term)


def match_pattern(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples equal to the terms given; None is any."""
    for name, term in (("s", s), ("p", p), ("o", o)):
        if term is not None:
            triples = triples.filter(F.col(name) == term)
    return triples


def insert(triples: DataFrame, more: DataFrame) -> DataFrame:
    return triples.unionByName(more).dropDuplicates(["s", "p", "o"])


def remove(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone, ["s", "p", "o"], "left_anti")


_COMPARE = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


def _condition(term: Column, op: str, literal: str) -> Column:
    compare = _COMPARE[op]
    if literal.startswith("<"):
        if op not in ("=", "!="):
            raise SparqlError("IRIs are compared by = and != only")
        return term.startswith("<") & compare(term, F.lit(literal))
    if literal.startswith('"'):
        return compare(lexical(term), F.lit(re.match(r'"((?:[^"\\]|\\.)*)"', literal)[1]))
    if not re.fullmatch(r"-?\d+(?:\.\d+)?", literal):
        raise SparqlError(f"{literal!r} is neither a number nor a text nor an IRI")
    text = lexical(term)
    real = compare(text.try_cast("double"), F.lit(float(literal)))
    if "." in literal or not -(2**63) <= int(literal) < 2**63:
        return real
    # whole numbers are compared as such: doubles would make neighbours equal beyond 2^53
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("bigint")
    return F.coalesce(compare(whole, F.lit(int(literal))), real)


def joined_order(patterns: tuple[tuple[str, str, str], ...]) -> list[tuple[str, str, str]]:
    """Patterns in an order in which each shares a variable with one before, as far as there is one; of several the one with the most constants comes first."""
    left, out, bound = list(patterns), [], set()
    variables = lambda p: {t[1:] for t in p if t[:1] in ("?", "$")}
    while left:
        pick = max(range(len(left)), key=lambda i: (bool(variables(left[i]) & bound) or not out, 3 - len(variables(left[i]) - bound), -i))
        out.append(left.pop(pick))
        bound |= variables(out[-1])
    return out


def select(triples: DataFrame, text: str) -> DataFrame:
    """Solutions as rows, one column for each variable; one that no pattern binds is null.

    Names of variables keep their case; within the joins they have numbers.
    """
    q = parse(text)
    if not q.patterns:
        raise SparqlError("WHERE has no pattern")
    known = triples.filter("s is not null and p is not null and o is not null")
    left, column = None, {}
    for n, pattern in enumerate(joined_order(q.patterns)):
        part, first = known, {}
        for place, term in zip("spo", pattern):
            if term[:1] in ("?", "$"):
                if term[1:] in first:  # the same variable twice
                    part = part.filter(F.col(place) == F.col(first[term[1:]]))
                else:
                    first[term[1:]] = place
            else:
                part = part.filter(F.col(place) == (term if term[:1] in '<"_' else f"<{term}>" if ":" in term else term))
        mine = {v: f"v{n}_{i}" for i, v in enumerate(first)}
        part = part.select(*[F.col(place).alias(mine[v]) for v, place in first.items()], F.lit(1).alias(f"one{n}"))
        if left is None:
            left = part
        else:
            on = F.lit(True)
            for v in first:
                if v in column:
                    on = on & (F.col(column[v]) == F.col(mine[v]))
            left = left.join(part, on)
        column = mine | column
    for v, op, literal in q.filters:
        left = left.filter(F.coalesce(_condition(F.col(column[v]), op, literal), F.lit(False)) if v in column else F.lit(False))
    out = left.select(*[F.col(column[v]).alias(v) if v in column else F.lit(None).cast("string").alias(v) for v in q.variables])
    out = out.distinct() if q.distinct else out
    return out if q.limit is None else out.limit(q.limit)
