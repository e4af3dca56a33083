"""The filter language: text to a tree, and a tree to a Column.

    any := all {"or" all}      all := not {"and" not}      not := "not" not | "(" any ")" | test
    test := operand ("==" | "!=" | ">" | ">=" | "<" | "<=") operand | path "in" "[" [literal {"," literal}] "]" | path "like" STRING

Conditions on a type's own fields follow SQL's three-valued logic, so that they push down as they are. Conditions
that look through references are two-valued: null equals null only, differs from all else, and no order holds with
it. They are spelled null-safe only where it matters, which is for `!=` and below `not`.
"""

from __future__ import annotations

import datetime
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError

_LEXEME = re.compile(r"""\s*(?:(?P<number>-?\d+(?:\.\d+)?)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<path>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<sign>==|!=|>=|<=|[<>()\[\],]))""", re.A)
_TESTS: dict[str, Callable] = {"==": operator.eq, "!=": operator.ne, ">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le}
_TURNED = {"==": "==", "!=": "!=", ">": "<", ">=": "<=", "<": ">", "<=": ">="}
_WORDS = {"and", "or", "not", "in", "like", "true", "false", "null"}
_NUMBERS = {"int", "long", "double", "datetime"}


class Path(NamedTuple):
    parts: tuple[str, ...]


class Literal(NamedTuple):
    value: Any


@dataclass(frozen=True)
class Test:
    op: str
    left: Path
    right: Path | Literal


@dataclass(frozen=True)
class Among:
    left: Path
    values: tuple[Any, ...]


@dataclass(frozen=True)
class Like:
    left: Path
    pattern: str


@dataclass(frozen=True)
class Group:
    """All of the parts, or any."""

    every: bool
    parts: tuple[Any, ...]


@dataclass(frozen=True)
class Not:
    part: Any


class _Reader:
    def __init__(self, text: str):
        self.text, self.tokens, self.at = text, [], 0
        at = 0
        while text[at:].strip():
            m = _LEXEME.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at:].strip()[:20]!r} in filter {text!r}")
            kind, told = m.lastgroup, m[m.lastgroup]
            if kind == "path" and told.lower() in _WORDS:
                kind, told = "word", told.lower()
            self.tokens.append((kind, told))
            at = m.end()
        self.tokens.append(("end", ""))

    def fail(self, wanted: str):
        raise QueryError(f"expected {wanted}, found {self.tokens[self.at][1] or 'the end'!r} in filter {self.text!r}")

    def has(self, text: str) -> bool:
        if self.tokens[self.at] in (("sign", text), ("word", text)):
            self.at += 1
            return True
        return False

    def group(self, every: bool) -> Any:
        word, below = ("and", self.negated) if every else ("or", lambda: self.group(True))
        parts = [below()]
        while self.has(word):
            parts.append(below())
        flat = [q for p in parts for q in (p.parts if isinstance(p, Group) and p.every == every else (p,))]
        return flat[0] if len(flat) == 1 else Group(every, tuple(flat))

    def negated(self) -> Any:
        if self.has("not"):
            return Not(self.negated())
        if self.has("("):
            out = self.group(False)
            if not self.has(")"):
                self.fail("')'")
            return out
        return self.test()

    def operand(self) -> Path | Literal:
        kind, told = self.tokens[self.at]
        self.at += 1
        if kind == "path":
            return Path(tuple(told.split(".")))
        if kind == "number":
            return Literal(float(told) if "." in told else int(told))
        if kind == "string":
            return Literal(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), told[1:-1], flags=re.S))
        if told in ("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[told])
        self.at -= 1
        self.fail("a field or a literal")

    def test(self) -> Any:
        left = self.operand()
        kind, told = self.tokens[self.at]
        if told in _TESTS and kind == "sign":
            self.at += 1
            right = self.operand()
            if isinstance(left, Literal):
                if isinstance(right, Literal):
                    raise QueryError(f"two literals compared in filter {self.text!r}")
                left, right, told = right, left, _TURNED[told]
            if right == Literal(None) and isinstance(right, Literal) and told not in ("==", "!="):
                raise QueryError(f"null has no order: filter {self.text!r}")
            return Test(told, left, right)
        if told not in ("in", "like"):
            self.fail("a comparison")
        if isinstance(left, Literal):
            raise QueryError(f"a field must stand before {told!r} in filter {self.text!r}")
        self.at += 1
        if told == "like":
            if self.tokens[self.at][0] != "string":
                self.fail("a string")
            return Like(left, self.operand().value)
        if not self.has("["):
            self.fail("'['")
        values = []
        while not self.has("]"):
            if values and not self.has(","):
                self.fail("',' or ']'")
            if self.tokens[self.at][0] not in ("number", "string"):
                self.fail("a number or a string")
            values.append(self.operand().value)
        return Among(left, tuple(values))


def parse_filter(text: str | None) -> Any:
    """The tree of a filter; None for an empty one."""
    if text is None or not text.strip():
        return None
    reader = _Reader(text)
    out = reader.group(False)
    if reader.tokens[reader.at][0] != "end":
        reader.fail("the end")
    return out


def paths(node: Any) -> Iterator[Path]:
    """All fields that a filter looks at."""
    if isinstance(node, Group):
        for p in node.parts:
            yield from paths(p)
    elif isinstance(node, Not):
        yield from paths(node.part)
    elif node is not None:
        yield node.left
        if isinstance(node, Test) and isinstance(node.right, Path):
            yield node.right


def split(node: Any) -> tuple[Any, Any]:
    """What looks at own fields only, and the rest; both hold where the filter does."""
    if node is None:
        return None, None
    parts = node.parts if isinstance(node, Group) and node.every else (node,)
    own = [p for p in parts if all(len(x.parts) == 1 for x in paths(p))]
    rest = [p for p in parts if p not in own]

    def whole(parts):
        return None if not parts else parts[0] if len(parts) == 1 else Group(True, tuple(parts))

    return whole(own), whole(rest)


class Source(NamedTuple):
    """A column, the language's type of it, and the kind of timestamp that holds a datetime, if one does."""

    column: Column
    type: str
    clock: str | None = None

    def value(self) -> Column:
        return seconds(self.column, self.clock) if self.clock else self.column


def seconds(column: Column, clock: str) -> Column:
    """Whole seconds since 1970; a timestamp without zone counts as UTC (the session's zone is pinned to it)."""
    return F.unix_seconds(column.cast("timestamp"))


def instant(value: float, clock: str) -> Column:
    """A count of seconds as a constant of the clock's type, so that the comparison reaches the file scan."""
    told = (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=value)).isoformat(" ")
    return F.lit(told).cast("timestamp_ntz") if clock == "timestamp_ntz" else F.timestamp_micros(F.lit(round(value * 1_000_000)))


def _fits(source: Source, value: Any, path: Path) -> None:
    if isinstance(value, bool):
        ok = source.type == "boolean"
    elif isinstance(value, (int, float)):
        ok = source.type in _NUMBERS
    else:
        ok = source.type == "string"
    if not ok:
        raise QueryError(f"{'.'.join(path.parts)} is a {source.type}; it can't be compared with {value!r}")


def compile_filter(node: Any, find: Callable[[Path], Source], null_safe: bool = False, below_not: bool = False) -> Column:
    """find: the source of a path. null_safe: two-valued logic."""
    if isinstance(node, Group):
        parts = [compile_filter(p, find, null_safe, below_not) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if node.every else out | p
        return out
    if isinstance(node, Not):
        return ~compile_filter(node.part, find, null_safe, True)
    left = find(node.left)
    sure = (lambda c: F.coalesce(c, F.lit(False))) if null_safe and below_not else (lambda c: c)
    if isinstance(node, Like):
        _fits(left, "", node.left)
        return sure(left.value().like(node.pattern.replace("\\", "\\\\")))
    if isinstance(node, Among):
        for v in node.values:
            _fits(left, v, node.left)
        values = [instant(v, left.clock) for v in node.values] if left.clock else list(node.values)
        return sure(left.column.isin(*values)) if values else F.lit(False)
    if isinstance(node.right, Literal):
        value = node.right.value
        if value is None:
            return left.column.isNull() if node.op == "==" else left.column.isNotNull()
        _fits(left, value, node.left)
        a, b = left.column, instant(value, left.clock) if left.clock else F.lit(value)
    else:
        right = find(node.right)
        if (left.type in _NUMBERS) != (right.type in _NUMBERS) or left.type not in _NUMBERS and left.type != right.type:
            raise QueryError(f"{'.'.join(node.left.parts)} is a {left.type} and {'.'.join(node.right.parts)} a {right.type}; they can't be compared")
        a, b = left.value(), right.value()
    if null_safe and node.op == "!=":
        return ~a.eqNullSafe(b)
    if null_safe and node.op == "==" and (below_not or isinstance(node.right, Path)):
        return a.eqNullSafe(b)
    return sure(_TESTS[node.op](a, b))
