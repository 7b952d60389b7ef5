"""The pipeline language: text to syntax tree and back."""

from .parser import parse, parse_statement
from .tokens import LanguageError, LexError, SyntaxFault, UnexpectedEnd
from .unparse import unparse

__all__ = ["LanguageError", "LexError", "SyntaxFault", "UnexpectedEnd", "parse", "parse_statement", "unparse"]
