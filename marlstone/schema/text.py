"""Scanner and grammar of the modelling language.

    module     := type*
    type       := mark* ("mixin" | ["abstract"] "entity") "type" NAME ["extends" NAME] ["mixes" NAME {"," NAME}]
                  ["schema" "name" STRING] "{" {field [","]} "}"
    mark       := "@" NAME ["(" [NAME "=" literal {"," NAME "=" literal}] ")"]
    field      := NAME ":" kind ["schema" "name" STRING] ["=" literal]
    kind       := NAME | NAME "(" NAME ")" | "[" NAME "]" "(" NAME "," NAME ")" | "timeseries" "<" NAME ">" "(" NAME ")"
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any, NamedTuple

from ..errors import GrammarError, ScanError

# The reserved words, and what a backslash makes of the next character.
RESERVED = frozenset({"entity", "mixin", "abstract", "type", "extends", "mixes", "schema", "timeseries", "true", "false", "null"})
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
CONSTANTS = {"true": True, "false": False, "null": None}

_LEXEME = re.compile(
    r"""(?P<gap>\s+|//[^\n]*|/\*.*?\*/)
      | (?P<number>-?\d+(?:\.\d+)?)
      | (?P<string>"(?:\\.|[^"\\\n])*")
      | (?P<name>[A-Za-z_]\w*)
      | (?P<sign>[@{}\[\]()<>:,=])""",
    re.S | re.X | re.A,
)


class Token(NamedTuple):
    kind: str  # number, string, name, word (reserved), sign or end
    text: str
    value: Any
    line: int
    col: int


@dataclass
class FieldDecl:
    name: str
    kind: str  # primitive, reference, collection or timeseries
    type: str  # of the value, the other entity or the measurements
    keys: tuple[str, ...] = ()
    column: str | None = None
    default: Any = None
    has_default: bool = False
    line: int = 0


@dataclass
class TypeDecl:
    name: str
    mixin: bool = False
    abstract: bool = False
    extends: str | None = None
    mixes: list[str] = field(default_factory=list)
    table: str | None = None
    fields: list[FieldDecl] = field(default_factory=list)
    marks: dict[str, dict[str, Any]] = field(default_factory=dict)
    line: int = 0


def scan(source: str) -> list[Token]:
    """All tokens and a last one of kind `end`."""
    out, at, line, begin = [], 0, 1, 0
    while at < len(source):
        m = _LEXEME.match(source, at)
        col = at - begin + 1
        if not m:
            what = "unterminated comment" if source.startswith("/*", at) else "unterminated string" if source[at] == '"' else f"unexpected character {source[at]!r}"
            raise ScanError(what, line, col)
        text, kind = m[0], m.lastgroup
        if kind == "number":
            out.append(Token("number", text, float(text) if "." in text else int(text), line, col))
        elif kind == "string":
            out.append(Token("string", text, _unescaped(text[1:-1], line, col), line, col))
        elif kind == "name":
            out.append(Token("word" if text in RESERVED else "name", text, text, line, col))
        elif kind == "sign":
            out.append(Token("sign", text, text, line, col))
        if breaks := text.count("\n"):
            line, begin = line + breaks, at + text.rindex("\n") + 1
        at = m.end()
    out.append(Token("end", "", None, line, at - begin + 1))
    return out


def _unescaped(body: str, line: int, col: int) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in ESCAPES:
            raise ScanError(f"unknown escape \\{m[1]}", line, col)
        return ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, body, flags=re.S)


class _Reader:
    def __init__(self, tokens: list[Token]):
        self.tokens, self.at = tokens, 0

    @property
    def next(self) -> Token:
        return self.tokens[self.at]

    def fail(self, wanted: str):
        t = self.next
        raise GrammarError(f"expected {wanted}, found {t.text or 'the end'!r}", t.line, t.col)

    def has(self, text: str) -> bool:
        """Takes the sign or reserved word if it is next."""
        if self.next.kind in ("sign", "word") and self.next.text == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.has(text):
            self.fail(repr(text))

    def name(self) -> str:
        if self.next.kind != "name":
            self.fail("a name")
        self.at += 1
        return self.tokens[self.at - 1].text

    def physical(self) -> str | None:
        """After `schema`, `name` is a keyword; elsewhere it is a name like any other."""
        if not self.has("schema"):
            return None
        if self.next.text != "name":
            self.fail("'name' after 'schema'")
        self.at += 1
        if self.next.kind != "string":
            self.fail("a string")
        self.at += 1
        return self.tokens[self.at - 1].value

    def literal(self) -> Any:
        t = self.next
        if t.kind in ("number", "string"):
            self.at += 1
            return t.value
        if t.text in CONSTANTS:
            self.at += 1
            return CONSTANTS[t.text]
        self.fail("a literal")

    def mark(self, into: dict[str, dict[str, Any]]) -> None:
        told = into.setdefault(self.name(), {})
        if self.has("(") and not self.has(")"):
            while True:
                key = self.name()
                self.need("=")
                told[key] = self.literal()
                if not self.has(","):
                    break
            self.need(")")

    def field(self) -> FieldDecl:
        line = self.next.line
        name = self.name()
        self.need(":")
        if self.has("["):
            other = self.name()
            self.need("]")
            out = FieldDecl(name, "collection", other, self.keys(2), line=line)
        elif self.has("timeseries"):
            self.need("<")
            value = self.name()
            self.need(">")
            out = FieldDecl(name, "timeseries", value, self.keys(1), line=line)
        else:
            other = self.name()
            refers = self.next.text == "("
            out = FieldDecl(name, "reference" if refers else "primitive", other, self.keys(1) if refers else (), line=line)
        out.column = self.physical()
        if self.has("="):
            out.default, out.has_default = self.literal(), True
        return out

    def keys(self, n: int) -> tuple[str, ...]:
        self.need("(")
        out = [self.name()]
        for _ in range(n - 1):
            self.need(",")
            out.append(self.name())
        self.need(")")
        return tuple(out)

    def type(self) -> TypeDecl:
        marks: dict[str, dict[str, Any]] = {}
        while self.has("@"):
            self.mark(marks)
        line = self.next.line
        mixin = self.has("mixin")
        abstract = not mixin and self.has("abstract")
        if not mixin and not self.has("entity"):
            self.fail("'entity' or 'mixin'")
        self.need("type")
        out = TypeDecl(self.name(), mixin, abstract, marks=marks, line=line)
        if self.has("extends"):
            out.extends = self.name()
        if self.has("mixes"):
            out.mixes.append(self.name())
            while self.has(","):
                out.mixes.append(self.name())
        out.table = self.physical()
        self.need("{")
        while not self.has("}"):
            out.fields.append(self.field())
            self.has(",")
        return out


def parse(source: str) -> list[TypeDecl]:
    reader, out = _Reader(scan(source)), []
    while reader.next.kind != "end":
        out.append(reader.type())
    return out
