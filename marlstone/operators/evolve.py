"""Changes of model: what differs, whether rows survive it, and how to carry it out."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import functions as F

from ..errors import EvolutionError
from ..schema.model import Entity, Model
from ..sources.store import EntityStore
from .series import SeriesStore

# The types that hold every value of a type.
WIDER = {"int": {"long", "double"}, "long": {"double"}, "boolean": {"int", "long"}, "datetime": {"long"}}


@dataclass(frozen=True)
class Change:
    kind: str
    target: str
    detail: str
    safe: bool
    statement: str = ""

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass(frozen=True)
class Plan:
    changes: tuple[Change, ...]

    def __len__(self) -> int:
        return len(self.changes)

    def __iter__(self):
        return iter(self.changes)

    @property
    def is_empty(self) -> bool:
        return not self.changes

    @property
    def is_safe(self) -> bool:
        return all(c.safe for c in self.changes)

    def unsafe(self) -> list[Change]:
        return [c for c in self.changes if not c.safe]

    def statements(self) -> list[str]:
        return [c.statement for c in self.changes if c.statement]

    def summary(self) -> list[str]:
        return [f"{c.kind} {c.target}: {c.detail}{'' if c.safe else ' (loses data)'}" for c in self.changes]


def diff(old: Model, new: Model) -> Plan:
    """Concrete types only, columns by their physical names: a renamed column is a dropped and a new one."""
    before, after = ({e.name: e for e in m.concrete} for m in (old, new))
    out = [Change("create_type", n, f"table {after[n].table}", True, after[n].ddl()) for n in after if n not in before]
    out += [Change("drop_type", n, f"table {before[n].table} and its rows", False, f"DROP TABLE `{before[n].table}`") for n in before if n not in after]
    for n in after:
        if n in before:
            out += _diff_type(before[n], after[n])
    return Plan(tuple(out))


def _diff_type(a: Entity, b: Entity) -> list[Change]:
    out = []
    if a.table != b.table:
        out.append(Change("rename_table", b.name, f"{a.table} to {b.table}", False, f"ALTER TABLE `{a.table}` RENAME TO `{b.table}`"))
    x, y = ({f.column: f for f in e.stored} for e in (a, b))
    for c, f in y.items():
        if c not in x:
            default = f" with default {f.default!r}" if f.has_default else ""
            out.append(Change("add_column", f"{b.name}.{c}", f"{f.type}{default}", True, f"ALTER TABLE `{b.table}` ADD COLUMNS (`{c}` {f.spark.simpleString().upper()})"))
    for c, f in x.items():
        if c not in y:
            out.append(Change("drop_column", f"{b.name}.{c}", f.type, False, f"ALTER TABLE `{b.table}` DROP COLUMN `{c}`"))
    for c, f in y.items():
        if c in x and x[c].type != f.type:
            wider = f.type in WIDER.get(x[c].type, ())
            out.append(Change("widen_column" if wider else "narrow_column", f"{b.name}.{c}", f"{x[c].type} to {f.type}", wider))
    # an index is metadata here; its name has the old table in it if the table was renamed
    i, j = ({columns: (name, unique) for name, (unique, columns) in e.indexes().items()} for e in (a, b))
    for columns in j:
        name, unique = j[columns]
        if columns not in i:
            out.append(Change("add_index", b.name, name, True))
        elif i[columns][1] != unique:
            out.append(Change("rebuild_index", b.name, name, True))
    out += [Change("drop_index", b.name, i[c][0], True) for c in i if c not in j]
    return out


def apply(store: EntityStore, old: Model, new: Model, allow_destructive: bool = False, series: SeriesStore | None = None) -> Plan:
    """Rewrites the tables that change; refuses to lose data unless that is allowed.

    The points of a dropped type or series are gone too: a later one of that name starts empty.
    A narrowed column keeps what its new type can hold; the rest becomes null.
    """
    plan = diff(old, new)
    if plan.unsafe() and not allow_destructive:
        raise EvolutionError("; ".join(Plan(tuple(plan.unsafe())).summary()))
    before = {e.name: e for e in old.concrete}
    for e in new.concrete:
        was = before.get(e.name)
        if was is None or e.name in store.bindings:
            continue
        columns = {c.column: c for c in was.stored}
        if was.table != e.table and store.exists(was.table):
            store.rename(was.table, e.table)
            store.forget()
        if {c.column: c.type for c in e.stored} != {c.column: c.type for c in was.stored} and store.exists(e.table):
            held = store.rows(was, store.log(e.table).version(), e.table)
            cells = []
            for f in e.stored:
                if f.column not in columns:
                    c = F.lit(f.default if f.has_default else None).cast(f.spark)
                elif columns[f.column].type != f.type:
                    c = F.col(f"`{f.column}`").try_cast(f.spark)
                else:
                    c = F.col(f"`{f.column}`")
                cells.append(c.alias(f.column))
            store.replace(e, held.select(cells))
    for e in old.concrete:
        if e.name not in {x.name for x in new.concrete} and e.name not in store.bindings and store.exists(e.table):
            store.drop(e.table)
    if series is not None:
        after = {e.name: e for e in new.concrete}
        series.drop([(e.name, f.name) for e in old.concrete for f in e.fields.values() if f.kind == "timeseries" and (e.name not in after or f.name not in after[e.name] or after[e.name][f.name].kind != "timeseries")])
    store.forget()
    return plan
