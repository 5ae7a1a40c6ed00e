"""Tokens of the SQL-like front-ends, and the predicate grammar they share."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from tessera.plans.nodes import All, Always, AnyOf, Leaf, Not

DEPTH = 128
_TOKEN = re.compile(
    r"""\s+|--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)
    |(?P<string>'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_$][\w$]*(?:\.(?:[A-Za-z_$][\w$]*|\d+|\*))*|`[^`]+`)|(?P<op><>|!=|<=|>=|==|=|<|>|\(|\)|,|\[|\]|\{|\}|\*|\+|-|/|:|;|\.|\||%)""",
    re.X | re.S,
)
_NEGATIVE = {"=": "eq", "==": "eq", "!=": "ne", "<>": "ne", ">": "gt", ">=": "ge", "<": "lt", "<=": "le"}
_FLIPPED = {"eq": "eq", "ne": "ne", "gt": "lt", "ge": "le", "lt": "gt", "le": "ge"}


class ParseError(ValueError):
    """Text that no front-end understands."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int


def strip_comments(text: str) -> str:
    """Without --, # and /* */ comments outside quotes."""
    return re.sub(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*")|--[^\n]*|\#[^\n]*|/\*.*?(?:\*/|\Z)""", lambda m: m[1] or " ", text, flags=re.S)


def tokenize(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ParseError(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup:
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return out


class Parser:
    """A cursor over tokens, with literals and predicates."""

    def __init__(self, text: str, args: Sequence[Any] = ()):
        self.text, self.tokens, self.at, self.args = text, tokenize(text), 0, args

    def peek(self, ahead: int = 0) -> Token:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else Token("end", "", len(self.text))

    def next(self) -> Token:
        t = self.peek()
        self.at += 1
        return t

    def word(self, *words: str, ahead: int = 0) -> bool:
        """Whether the next tokens are these words."""
        return all(self.peek(ahead + i).kind == "name" and self.peek(ahead + i).text.upper() == w for i, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.word(*words):
            self.at += len(words)
            return True
        return False

    def op(self, text: str) -> bool:
        if self.peek().kind == "op" and self.peek().text == text:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not (self.op(text) or self.take(text.upper())):
            raise ParseError(f"expected {text!r} at {self.peek().at}, not {self.peek().text!r}")

    def name(self) -> str:
        t = self.next()
        if t.kind == "name":
            return t.text.strip("`")
        if t.kind == "string":
            return t.text[1:-1]
        raise ParseError(f"expected a name at {t.at}, not {t.text!r}")

    def parameter(self) -> bool:
        """Whether the next token stands for one of the arguments."""
        return self.peek().kind == "name" and re.fullmatch(r"\$\d+", self.peek().text) is not None

    def argument(self) -> Any:
        t = self.next()
        n = int(t.text[1:])
        if not 1 <= n <= len(self.args):
            raise ParseError(f"no argument for {t.text}")
        return self.args[n - 1]

    def integer(self) -> int:
        if self.parameter():
            n = self.argument()
            if isinstance(n, bool) or not isinstance(n, int) or n < 0:
                raise ParseError("expected a whole number")
            return n
        t = self.next()
        if t.kind != "number" or not t.text.isdigit():
            raise ParseError(f"expected a whole number at {t.at}")
        return int(t.text)

    def end(self) -> None:
        while self.op(";"):
            pass
        if self.peek().kind != "end":
            raise ParseError(f"unexpected {self.peek().text!r} at {self.peek().at}")

    def is_literal(self) -> bool:
        t = self.peek()
        return self.parameter() or t.kind in ("string", "number") or t.kind == "op" and t.text in ("-", "[", "{") or t.kind == "name" and t.text.upper() in ("TRUE", "FALSE", "NULL")

    def literal(self) -> Any:
        if self.parameter():
            return self.argument()
        t = self.next()
        if t.kind == "string":
            body = t.text[1:-1]
            return re.sub(r"\\(.)", r"\1", body.replace("''", "'") if t.text[0] == "'" else body)
        if t.kind == "number":
            return int(t.text) if t.text.isdigit() else float(t.text)
        if t.kind == "op" and t.text == "-":
            return -self.literal()
        if t.kind == "op" and t.text == "[":
            out: list = []
            while not self.op("]"):
                out.append(self.literal())
                self.op(",")
            return out
        if t.kind == "op" and t.text == "{":
            fields: dict = {}
            while not self.op("}"):
                k = self.name()
                self.expect(":")
                fields[k] = self.literal()
                self.op(",")
            return fields
        if t.kind == "name" and t.text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[t.text.upper()]
        raise ParseError(f"expected a value at {t.at}, not {t.text!r}")

    def predicate(self, depth: int = 0) -> Any:
        """OR binds least, then AND, then NOT."""
        if depth > DEPTH:
            raise ParseError("nested too deeply")
        parts = [self._and(depth)]
        while self.take("OR"):
            parts.append(self._and(depth))
        return parts[0] if len(parts) == 1 else AnyOf(tuple(parts))

    def _and(self, depth: int) -> Any:
        parts = [self._not(depth)]
        while self.take("AND"):
            parts.append(self._not(depth))
        return parts[0] if len(parts) == 1 else All(tuple(parts))

    def _not(self, depth: int) -> Any:
        if self.take("NOT"):
            if depth >= DEPTH:
                raise ParseError("nested too deeply")
            return Not(self._not(depth + 1))
        if self.op("("):
            inner = self.predicate(depth + 1)
            self.expect(")")
            return inner
        return self._leaf()

    def _leaf(self) -> Any:
        if self.is_literal():
            a = self.literal()
            op = _NEGATIVE.get(self.peek().text) if self.peek().kind == "op" else None
            if op is None:
                if isinstance(a, bool) or a in (0, 1):
                    return Always() if a else Not(Always())
                raise ParseError("a value is no condition")
            self.next()
            if self.is_literal():
                b = self.literal()
                try:
                    holds = {"eq": a == b, "ne": a != b}[op] if op in ("eq", "ne") else {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]
                except TypeError:
                    holds = False
                return Always() if holds else Not(Always())
            return Leaf(_FLIPPED[op], self.name(), a)
        name = self.name()
        if self.take("IS", "NOT", "NULL"):
            return Leaf("notnull", name)
        if self.take("IS", "NULL"):
            return Leaf("isnull", name)
        negated = self.take("NOT")
        if self.take("BETWEEN"):
            lo = self.literal()
            self.expect("AND")
            leaf: Any = Leaf("between", name, (lo, self.literal()))
        elif self.take("IN"):
            self.expect("(")
            values = []
            while not self.op(")"):
                values.append(self.literal())
                self.op(",")
            leaf = Leaf("in", name, tuple(values))
        elif self.take("LIKE") or self.take("ILIKE"):
            leaf = Leaf("like", name, self.literal())
        elif self.take("CONTAINS"):
            leaf = Leaf("contains", name, self.literal())
        elif self.take("STARTS", "WITH") or self.take("STARTS_WITH") or self.take("STARTSWITH"):
            leaf = Leaf("startswith", name, self.literal())
        elif self.take("ENDS", "WITH") or self.take("ENDS_WITH") or self.take("ENDSWITH"):
            leaf = Leaf("endswith", name, self.literal())
        elif not negated and self.peek().kind == "op" and self.peek().text in _NEGATIVE:
            op = _NEGATIVE[self.next().text]
            leaf = Leaf(op, name, self.literal())
        else:
            raise ParseError(f"no condition on {name} at {self.peek().at}")
        return Not(leaf) if negated else leaf
