"""Triples as text: N-Triples, a line a triple, and Turtle, with prefixes and shared subjects."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "s string, p string, o string"
_IRI, _BLANK = r"<[^<>\"{}|^`\\\x00-\x20]*>", r"_:[\w.-]*\w"
_LITERAL = r'"(?:[^"\\\n\r]|\\.)*"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^' + _IRI + r")?"
_LINE = rf"^\s*({_IRI}|{_BLANK})\s*({_IRI})\s*({_IRI}|{_BLANK}|{_LITERAL})\s*\.\s*(?:#.*)?$"
_RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XSD = "http://www.w3.org/2001/XMLSchema#"


class TurtleError(ValueError):
    pass


def parse_ntriples(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o) of lines of N-Triples; comments and empty lines give none, and neither do lines that aren't triples (see bad_lines)."""
    c = F.col(column)
    return lines.filter(c.rlike(_LINE)).select(*[F.regexp_extract(c, _LINE, i).alias(n) for i, n in enumerate("spo", 1)])


def bad_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines that are neither triples nor empty nor comments."""
    c = F.col(column)
    return lines.filter(~c.rlike(_LINE) & ~c.rlike(r"^\s*(#.*)?$"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    return parse_ntriples(spark.read.text(path))


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    triples.select(F.concat_ws(" ", "s", "p", "o", F.lit("."))).write.mode(mode).text(path)


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<long>(?:\"{3}(?:(?!\"{3})(?:[^\\]|\\.))*\"{3}|'{3}(?:(?!'{3})(?:[^\\]|\\.))*'{3}))|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<iri><[^<>\s]*>)|(?P<keyword>@prefix\b|@base\b|(?i:prefix|base)(?=\s+[^\s:]*:?\s*<))|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<type>\^\^)"""
    r"""|(?P<blank>_:[\w.-]*\w)|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<name>(?:[\w-](?:[\w.-]*[\w-])?)?:(?:[\w%:-](?:[\w.%:-]*[\w%:-])?)?)|(?P<word>a(?=[\s<"])|true\b|false\b)|(?P<mark>[.;,\[\]()])""",
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(s: str) -> str:
    """Text of a quoted token, escapes resolved."""
    s = s[3:-3] if s[:3] in ('"""', "'''") else s[1:-1]
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), s)


def _quoted(s: str) -> str:
    return '"' + s.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r") + '"'


def parse_turtle(text: str) -> Iterator[tuple[str, str, str]]:
    """Triples of a Turtle document, terms in the form of N-Triples.

    Prefixes, `a`, `;` and `,`, numbers and truth values, language and type, and
    anonymous nodes in brackets, which are named in order. A base is put before
    relative IRIs. Lists in parentheses are refused.
    """
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise TurtleError(f"nothing can be read at {text[at:at + 20]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[0]))
        at = m.end()
    tokens.append(("end", ""))
    i, prefixes, base, made = 0, {}, "", 0
    out: list[tuple[str, str, str]] = []

    def iri(t: str) -> str:
        return t if not base or re.match(r"<[A-Za-z][A-Za-z0-9+.-]*:", t) else f"<{base}{t[1:]}"

    def expect(mark: str) -> None:
        nonlocal i
        if tokens[i][1] != mark:
            raise TurtleError(f"{mark!r} is expected, not {tokens[i][1]!r}")
        i += 1

    def term() -> str:
        nonlocal i, made
        kind, t = tokens[i]
        i += 1
        if kind == "iri":
            return iri(t)
        if kind == "blank":
            return t
        if kind == "name":
            prefix, _, local = t.partition(":")
            if prefix not in prefixes:
                raise TurtleError(f"the prefix {prefix!r} isn't declared")
            return f"<{prefixes[prefix]}{local}>"
        if kind == "word":
            return f"<{_RDF}type>" if t == "a" else f'"{t}"^^<{_XSD}boolean>'
        if kind == "number":
            name = "double" if "e" in t.lower() else "decimal" if "." in t else "integer"
            return f'"{t}"^^<{_XSD}{name}>'
        if kind in ("string", "long"):
            out_ = _quoted(_plain(t))
            if tokens[i][0] == "lang":
                i += 1
                return out_ + tokens[i - 1][1]
            if tokens[i][0] == "type":
                i += 1
                return f"{out_}^^{term()}"
            return out_
        if t == "[":
            made += 1
            node = f"_:anon{made}"
            if tokens[i][1] != "]":
                pairs(node)
            expect("]")
            return node
        raise TurtleError(f"a term is expected, not {t!r}")

    def pairs(subject: str) -> None:
        nonlocal i
        while True:
            p = term()
            while True:
                out.append((subject, p, term()))
                if tokens[i][1] != ",":
                    break
                i += 1
            while tokens[i][1] == ";":
                i += 1
            if tokens[i - 1][1] != ";" or tokens[i][1] in (".", "]"):
                return

    while tokens[i][0] != "end":
        kind, t = tokens[i]
        if kind == "keyword":
            i += 1
            if "prefix" in t.lower():
                name, full = tokens[i], tokens[i + 1]
                if name[0] != "name" or full[0] != "iri":
                    raise TurtleError("a prefix and its IRI are expected")
                prefixes[name[1].partition(":")[0]] = iri(full[1])[1:-1]
                i += 2
            else:
                base = tokens[i][1][1:-1]
                i += 1
            if t[0] == "@":
                expect(".")
            continue
        subject = term()
        if tokens[i][1] != ".":
            pairs(subject)
        expect(".")
    yield from out


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of Turtle files, each read whole by one task, as prefixes hold from where they stand on; blank nodes are of their file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("path").to_pylist(), b.column("value").to_pylist()):
                tag = format(abs(hash_name(name)), "x")
                rows = [[re.sub(r"^_:", f"_:f{tag}x", t) for t in triple] for triple in parse_turtle(text)]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[at : at + 10_000])], ["s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInArrow(run, _SCHEMA)


def hash_name(name: str) -> int:
    h = 0
    for c in name.encode():
        h = (h * 131 + c) % (1 << 48)
    return h


def write_turtle(triples: DataFrame, path: str, prefixes: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Turtle files: triples sorted by subject and predicate, written as they stream, with `;` and `,` where they share these; no subject is collected."""
    names = sorted((prefixes or {}).items(), key=lambda x: -len(x[1]))
    head = [f"@prefix {n}: <{x}> ." for n, x in sorted((prefixes or {}).items())]

    def short(t: str) -> str:
        if t == f"<{_RDF}type>":
            return "a"
        for n, x in names:
            if t.startswith("<" + x) and re.fullmatch(r"\w(?:[\w-]*\w)?", t[len(x) + 1 : -1]):
                return f"{n}:{t[len(x) + 1 : -1]}"
        return t

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines = None, list(head)
        for b in batches:
            for s, p, o in zip(*(b.column(c).to_pylist() for c in "spo")):
                if last and last[0] == s:
                    lines[-1] += f" , {short(o)}" if last[1] == p else f" ;\n    {short(p)} {short(o)}"
                else:
                    if last:
                        lines[-1] += " ."
                    # what is finished can go; the line that may go on stays
                    if len(lines) > 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
                        lines = []
                    lines.append(f"{short(s)} {short(p)} {short(o)}")
                last = s, p
                if len(lines[-1]) > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([*lines[:-1], lines[-1] + " ."], pa.string())], ["value"])
                    last, lines = None, []
        if last:
            lines[-1] += " ."
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])

    triples.repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o").mapInArrow(run, "value string").write.mode(mode).text(path)
