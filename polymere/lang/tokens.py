"""Tokens of the pipeline language."""

from __future__ import annotations

import re
from dataclasses import dataclass

KEYWORDS = frozenset("and asc desc distinct filter from full group_by hopping inner join last left match not on or return right select session sort take tumbling window".split())
_ESCAPES = {'"': '"', "\\": "\\", "n": "\n", "t": "\t", "r": "\r"}
_TOKEN = re.compile(
    r"""(?P<skip>[\s]+|--[^\n]*)
    |(?P<float>\d+\.\d+(?:[eE][+-]?\d+)?)
    |(?P<duration>\d+(?:ms|[smhdw])(?![A-Za-z0-9_]))
    |(?P<int>\d+)
    |(?P<string>"(?:[^"\\]|\\.)*")
    |(?P<param>\$[A-Za-z_]\w*)
    |(?P<ident>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<op>->|<-|\.\.|==|!=|<=|>=|[=<>+\-*/|.,:;(){}\[\]])""",
    re.X | re.S,
)


class LanguageError(ValueError):
    """A text that isn't of the language; offset is where."""

    def __init__(self, message: str, offset: int) -> None:
        super().__init__(f"{message} at {offset}")
        self.offset = offset


class LexError(LanguageError):
    pass


class SyntaxFault(LanguageError):
    def __init__(self, expected: str, got: str, offset: int) -> None:
        super().__init__(f"expected {expected}, got {got!r}", offset)
        self.expected, self.got = expected, got


class UnexpectedEnd(LanguageError):
    def __init__(self, expected: str, offset: int) -> None:
        super().__init__(f"expected {expected}, but the text ends", offset)
        self.expected = expected


@dataclass(frozen=True)
class Token:
    kind: str  # keyword ident int float string duration param op end
    text: str
    offset: int
    value: object = None


def unescape(body: str) -> str:
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            raise LexError("unterminated string" if text[at] == '"' else f"no token begins with {text[at]!r}", at)
        kind, s = m.lastgroup, m.group()
        if kind == "int":
            if int(s) >= 1 << 63:
                raise LexError("integer beyond 64 bits", at)
            out.append(Token("int", s, at, int(s)))
        elif kind == "float":
            out.append(Token("float", s, at, float(s)))
        elif kind == "string":
            out.append(Token("string", s, at, unescape(s[1:-1])))
        elif kind == "ident":
            out.append(Token("keyword" if s in KEYWORDS else "ident", s, at, s))
        elif kind != "skip":
            out.append(Token(kind, s, at, s[1:] if kind == "param" else s))
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
