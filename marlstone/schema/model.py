"""Declarations resolved to a catalogue of entity types with flat fields."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

from ..errors import ModelError
from .text import FieldDecl, TypeDecl, parse

#: Values of the language as Spark holds them; a datetime is a count of seconds.
SPARK = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "datetime": T.LongType()}
MEASURED = ("double", "int", "long")
POINT = T.StructType([T.StructField("ts", T.LongType()), T.StructField("value", T.DoubleType())])


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    type: str
    keys: tuple[str, ...] = ()
    column: str = ""
    default: Any = None
    has_default: bool = False
    line: int = 0

    @property
    def stored(self) -> bool:
        return self.kind == "primitive"

    @property
    def spark(self) -> T.DataType:
        return SPARK[self.type]

    def same(self, other: FieldDecl | Field) -> bool:
        return (self.kind, self.type, self.keys) == (other.kind, other.type, other.keys)


@dataclass
class Entity:
    name: str
    table: str
    abstract: bool
    fields: dict[str, Field]
    bases: list[str] = field(default_factory=list)  # from the root down, itself last
    mixins: list[str] = field(default_factory=list)
    marks: dict[str, dict[str, Any]] = field(default_factory=dict)
    line: int = 0

    def __getitem__(self, name: str) -> Field:
        if name not in self.fields:
            raise ModelError(f"{self.name} has no field {name!r}")
        return self.fields[name]

    def __contains__(self, name: str) -> bool:
        return name in self.fields

    @property
    def stored(self) -> list[Field]:
        return [f for f in self.fields.values() if f.stored]

    @property
    def schema(self) -> T.StructType:
        """Of logical names."""
        return T.StructType([T.StructField(f.name, f.spark) for f in self.stored])

    @property
    def physical(self) -> T.StructType:
        return T.StructType([T.StructField(f.column, f.spark) for f in self.stored])

    def isa(self, name: str) -> bool:
        return name in self.bases or name in self.mixins

    def indexes(self) -> dict[str, tuple[bool, tuple[str, ...]]]:
        """Name: whether unique, and the physical columns. Each string of a @db mark is one index."""
        out = {}
        for key, unique in (("unique", True), ("index", False)):
            told = self.marks.get("db", {}).get(key)
            names = [x.strip() for x in told.split(",")] if isinstance(told, str) else []
            if names:
                columns = tuple(self.fields[n].column if n in self.fields and self.fields[n].stored else n for n in names)
                out[f"{'ux' if unique else 'ix'}_{self.table}_{'_'.join(columns)}"] = (unique, columns)
        return out

    def ddl(self) -> str:
        """The table as Spark would be told to make it."""
        columns = ", ".join(f"`{f.column}` {f.spark.simpleString().upper()}" for f in self.stored)
        return f"CREATE TABLE `{self.table}` ({columns}) USING PARQUET"


class Model:
    def __init__(self, entities: dict[str, Entity]):
        self.entities = entities

    def __getitem__(self, name: str) -> Entity:
        if name not in self.entities:
            raise ModelError(f"unknown type {name!r}")
        return self.entities[name]

    def __contains__(self, name: str) -> bool:
        return name in self.entities

    @property
    def names(self) -> list[str]:
        return sorted(self.entities)

    @property
    def concrete(self) -> list[Entity]:
        return [e for e in self.entities.values() if not e.abstract]

    def concrete_of(self, name: str) -> list[Entity]:
        """The type itself if it can have rows, else those below it that can, by name."""
        own = self[name]
        if not own.abstract:
            return [own]
        return sorted((e for e in self.concrete if name in e.bases), key=lambda e: e.name)

    def fingerprint(self) -> str:
        """A digest of tables, columns and indexes; defaults and relations don't count."""
        shape = [[e.table, sorted((f.column, f.type) for f in e.stored), sorted((k, u, c) for k, (u, c) in e.indexes().items())] for e in sorted(self.concrete, key=lambda e: e.table)]
        return hashlib.sha256(json.dumps(shape).encode()).hexdigest()


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()


def _chain(name: str, types: dict[str, TypeDecl]) -> list[TypeDecl]:
    """From the root down to the type."""
    out: list[TypeDecl] = []
    at: str | None = name
    while at is not None:
        decl = types.get(at)
        if decl is None:
            raise ModelError(f"{out[-1].name} extends unknown type {at!r}", out[-1].line)
        if decl in out:
            raise ModelError(f"{name} extends itself through {at}", decl.line)
        if decl.mixin and out:
            raise ModelError(f"{out[-1].name} can't extend the mixin {at}; it can mix it in", out[-1].line)
        out.append(decl)
        at = decl.extends
    return out[::-1]


def _flat(chain: list[TypeDecl], types: dict[str, TypeDecl]) -> tuple[dict[str, Field], list[str]]:
    fields: dict[str, Field] = {}
    origin: dict[str, str] = {}
    mixed: list[str] = []

    def add(decl: FieldDecl, owner: str) -> None:
        old = fields.get(decl.name)
        if old is None:
            fields[decl.name] = Field(decl.name, decl.kind, decl.type, decl.keys, decl.column or decl.name, decl.default, decl.has_default, decl.line)
            origin[decl.name] = owner
        elif not old.same(decl):
            raise ModelError(f"field {decl.name!r} of {owner} contradicts that of {origin[decl.name]}", decl.line)
        elif decl.column:
            fields[decl.name] = replace(old, column=decl.column)

    for decl in chain:
        for name in decl.mixes:
            if name not in types:
                raise ModelError(f"{decl.name} mixes unknown {name!r}", decl.line)
            if not types[name].mixin:
                raise ModelError(f"{decl.name} mixes {name}, which is no mixin", decl.line)
            if name not in mixed:
                mixed.append(name)
                for f in types[name].fields:
                    add(f, name)
        for f in decl.fields:
            add(f, decl.name)
    first = {"id": fields["id"]} if "id" in fields else {}
    return {**first, **fields}, mixed


def resolve(declared: list[TypeDecl]) -> Model:
    types: dict[str, TypeDecl] = {}
    for decl in declared:
        if decl.name in types:
            raise ModelError(f"type {decl.name} is declared twice", decl.line)
        types[decl.name] = decl
    entities = {}
    for decl in declared:
        if not decl.mixin:
            chain = _chain(decl.name, types)
            fields, mixed = _flat(chain, types)
            entities[decl.name] = Entity(decl.name, decl.table or snake(decl.name), decl.abstract, fields, [d.name for d in chain], mixed, decl.marks, decl.line)
    model = Model(entities)
    _validate(model)
    return model


def _validate(model: Model) -> None:
    tables: dict[str, str] = {}
    for e in model.entities.values():
        if not e.abstract and tables.setdefault(e.table, e.name) != e.name:
            raise ModelError(f"{tables[e.table]} and {e.name} share the table {e.table!r}", e.line)
        if "id" not in e:
            raise ModelError(f"{e.name} has no id", e.line)
        if not e["id"].stored:
            raise ModelError(f"the id of {e.name} must be a primitive", e.line)
        columns: dict[str, str] = {}
        for f in e.fields.values():
            _validate_field(model, e, f)
            if f.stored and columns.setdefault(f.column, f.name) != f.name:
                raise ModelError(f"{columns[f.column]} and {f.name} of {e.name} share the column {f.column!r}", f.line)
        for name, (_, of) in e.indexes().items():
            for c in of:
                if c not in columns:
                    raise ModelError(f"index {name} of {e.name} names {c!r}, which is no stored field", e.line)


def _validate_field(model: Model, e: Entity, f: Field) -> None:
    def key(owner: Entity, name: str, primitive: bool = True) -> None:
        if name not in owner:
            raise ModelError(f"{e.name}.{f.name} needs a field {name!r} of {owner.name}", f.line)
        if primitive and not owner[name].stored:
            raise ModelError(f"{e.name}.{f.name} needs {owner.name}.{name} to be a primitive", f.line)

    if f.kind == "primitive":
        if f.type not in SPARK:
            raise ModelError(f"{e.name}.{f.name} has unknown type {f.type!r}", f.line)
    elif f.kind == "timeseries":
        if f.type not in MEASURED:
            raise ModelError(f"{e.name}.{f.name} can't measure {f.type!r}; {', '.join(MEASURED)} can be measured", f.line)
        key(e, f.keys[0])
    else:
        if f.type not in model:
            raise ModelError(f"{e.name}.{f.name} refers to unknown type {f.type!r}", f.line)
        if f.kind == "reference":
            key(e, f.keys[0])
        else:
            key(model[f.type], f.keys[0])
            key(e, f.keys[1])


def load(source: str) -> Model:
    return resolve(parse(source))
