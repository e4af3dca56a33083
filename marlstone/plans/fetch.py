"""Requests for rows, built bottom-up to one lazy DataFrame.

Conditions on the type's own fields go to its scan. If nothing looks through references, order and limit are applied
before anything is joined; otherwise only the references that the filter needs are joined first, then filter, order
and limit, and what is to be included is joined to the rows that are left. References are left joins on the other
type's id; collections and series are grouped by their key before they are joined, so the rows stay as many.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..functions import predicates as P
from ..schema.model import POINT, Entity, Field, Model
from ..sources.store import EntityStore

TYPE = "_type"
#: A reference that only the filter needs stands in this column of structs until the filter is done.
HELD = "__held"


@dataclass
class PlanReport:
    """Where the parts of a request went."""

    entity: str
    own_filter: bool = False
    residual_filter: bool = False
    order_below_joins: bool = False
    limit_below_joins: bool = False
    joined: list[str] = field(default_factory=list)
    scans: int = 1
    observed: dict[str, Observation] = field(default_factory=dict)

    def counts(self) -> dict[str, int]:
        """Rows of the root and of the result, once the result has been computed; only for observed requests."""
        return {k: o.get["rows"] for k, o in self.observed.items()}

    def watch(self, name: str, df: DataFrame) -> DataFrame:
        self.observed[name] = Observation()
        return df.observe(self.observed[name], F.count(F.lit(1)).alias("rows"))


def include_tree(include: list[str] | None) -> dict[str, dict]:
    """Dotted paths as nested dictionaries that share prefixes."""
    tree: dict[str, dict] = {}
    for path in include or []:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})
    return tree


def parse_order(entity: Entity, order: str | list | tuple | None) -> list[Column]:
    """"f" and "-f" and ("f", "desc"); nulls first when rising, last when falling."""
    out = []
    for spec in [order] if isinstance(order, str) else order or []:
        if isinstance(spec, str):
            name, down = spec.removeprefix("-"), spec.startswith("-")
        else:
            name, way = spec
            if str(way).lower() not in ("asc", "desc"):
                raise QueryError(f"unknown order {way!r}")
            down = str(way).lower() == "desc"
        if name not in entity or not entity[name].stored:
            raise QueryError(f"{entity.name} can't be ordered by {name!r}")
        c = F.col(f"`{name}`")
        out.append(c.desc_nulls_last() if down else c.asc_nulls_first())
    return out


class Planner:
    def __init__(self, model: Model, store: EntityStore, series: Any):
        self.model, self.store, self.series = model, store, series

    # checks that need no rows

    def check_tree(self, entity: Entity, tree: dict[str, dict]) -> None:
        for name, below in tree.items():
            if name not in entity:
                raise QueryError(f"{entity.name} has no field {name!r} to include")
            f = entity[name]
            if f.stored:
                raise QueryError(f"{entity.name}.{name} is stored; only relations are included")
            if f.kind == "timeseries":
                if below:
                    raise QueryError(f"nothing lies below the series {entity.name}.{name}")
                continue
            for sub in self.model.concrete_of(f.type):
                self.check_tree(sub, below)

    def path_field(self, entity: Entity, path: P.Path) -> Field:
        """The stored field at the end of a path through references."""
        at = [entity]
        for k, part in enumerate(path.parts):
            fields = []
            for e in at:
                if part not in e:
                    raise QueryError(f"{e.name} has no field {part!r}, in {'.'.join(path.parts)!r}")
                fields.append(e[part])
            last = k == len(path.parts) - 1
            if last:
                if not all(f.stored for f in fields):
                    raise QueryError(f"{'.'.join(path.parts)!r} isn't a stored field")
                if len({f.type for f in fields}) > 1:
                    raise QueryError(f"{'.'.join(path.parts)!r} has several types")
                return fields[0]
            if not all(f.kind == "reference" for f in fields):
                raise QueryError(f"{part!r} isn't a reference, in {'.'.join(path.parts)!r}")
            at = [e for t in dict.fromkeys(f.type for f in fields) for e in self.model.concrete_of(t)]
        raise QueryError("an empty path")

    def own_source(self, entity: Entity, name: str) -> P.Source:
        if name not in entity or not entity[name].stored:
            raise QueryError(f"{entity.name} has no stored field {name!r}")
        return self.store.source(entity, entity[name])

    def own_filter(self, entity: Entity, node: Any) -> Column:
        return P.compile_filter(node, lambda p: self.own_source(entity, p.parts[0]))

    # building

    def fetch(self, entity: Entity, filter: str | None = None, include: list[str] | None = None, order: Any = None, limit: int | None = None, offset: int | None = None, window: tuple | None = None, columns: list[str] | None = None, observe: bool = False) -> tuple[DataFrame, PlanReport]:
        """observe: count the rows that the root gives and those of the result, in the same pass.

        columns: own fields; "site.name" reads that field (and keys) only of the rows included at `site`.
        """
        tree = include_tree(include)
        self.check_tree(entity, tree)
        only = self._child_columns(tree, columns)
        columns = None if columns is None else [c for c in columns if "." not in c]
        keys = parse_order(entity, order)
        for what, n in (("limit", limit), ("offset", offset)):
            if n is not None and (isinstance(n, bool) or not isinstance(n, int) or n < 0):
                raise QueryError(f"{what} must be a count")
        own, rest = P.split(P.parse_filter(filter))
        report = PlanReport(entity.name, own is not None, rest is not None, bool(keys) and rest is None, limit is not None and rest is None)
        raw = self.store.raw(entity)
        if own is not None:
            raw = raw.where(self.own_filter(entity, own))
        needed = None if columns is None else [*columns, *self._keys(entity, tree), *self._order_names(order), *(p.parts[0] for p in P.paths(rest) if len(p.parts) == 1), *(entity[p.parts[0]].keys[0] for p in P.paths(rest) if len(p.parts) > 1 and p.parts[0] in entity and entity[p.parts[0]].keys)]
        df = self.store.logical(entity, raw, needed)
        df = report.watch("root", df) if observe else df
        if rest is not None:
            df = self._residual(df, entity, rest, report)
        if keys:
            df = df.orderBy(*keys)
        if limit is not None:
            df = (df.offset(offset) if offset else df).limit(limit)
        stored = df.columns
        # rows that a filter alone has chosen can be asked for twice: once to say which children are needed
        df = self.expand(df, entity, tree, window, report, narrow=own is not None and rest is None and limit is None, only=only)
        if tree and keys:
            df = df.orderBy(*keys)
        if columns is not None:
            df = df.select([c for c in df.columns if c not in stored or c == "id" or c in columns])
        return report.watch("result", df) if observe else df, report

    @staticmethod
    def _child_columns(tree: dict[str, dict], columns: list[str] | None) -> dict[tuple, list[str]]:
        out: dict[tuple, list[str]] = {}
        for c in columns or []:
            *path, name = c.split(".")
            below = tree
            for part in path:
                if part not in below:
                    raise QueryError(f"{c!r} isn't of an included row")
                below = below[part]
            if path:
                out.setdefault(tuple(path), []).append(name)
        return out

    @staticmethod
    def _order_names(order: Any) -> list[str]:
        return [s.removeprefix("-") if isinstance(s, str) else s[0] for s in ([order] if isinstance(order, str) else order or [])]

    @staticmethod
    def _keys(entity: Entity, tree: dict[str, dict]) -> list[str]:
        return [entity[n].keys[-1] if entity[n].kind == "collection" else entity[n].keys[0] for n in tree]

    def _residual(self, df: DataFrame, entity: Entity, node: Any, report: PlanReport) -> DataFrame:
        """Joins the references that the filter looks through, filters, and drops them again."""
        tree: dict[str, dict] = {}
        for p in P.paths(node):
            self.path_field(entity, p)
            at = tree
            for part in p.parts[:-1]:
                at = at.setdefault(part, {})
        names = {n: f"{HELD}_{n}" for n in tree}
        wide = self.expand(df, entity, tree, None, report, names)

        def find(p: P.Path) -> P.Source:
            f = self.path_field(entity, p)
            head = names.get(p.parts[0], p.parts[0]) if len(p.parts) > 1 else p.parts[0]
            return P.Source(F.col(".".join(f"`{x}`" for x in (head, *p.parts[1:]))), f.type)

        return wide.where(P.compile_filter(node, find, null_safe=True)).drop(*names.values())

    def expand(self, df: DataFrame, entity: Entity, tree: dict[str, dict], window: tuple | None, report: PlanReport, names: dict[str, str] | None = None, narrow: bool = False, only: dict | None = None, at: tuple = ()) -> DataFrame:
        """narrow: df's rows are few, so children are cut down to theirs before they are grouped.

        only: of the included rows at a path, the fields to read; `at` is the path of df's own rows.
        """
        rows = df
        for name, below in tree.items():
            f, column = entity[name], (names or {}).get(name, name)
            report.joined.append(f"{entity.name}.{name}")
            if f.kind == "timeseries":
                df = self._with_series(df, entity, f, column, window)
                report.scans += 1
                continue
            needed = (f.keys[0], rows.select(F.col(f"`{f.keys[1]}`").alias("__needed"))) if narrow and f.kind == "collection" else None
            other = self.target(f.type, below, window, report, needed, f.kind == "reference", only, (*at, name), f.keys[0] if f.kind == "collection" else "id")
            # children stand in the order of their ids: the struct begins with it, and so does the comparison
            key, value = f"__key_{column}", F.struct(*[F.col(f"`{c}`") for c in sorted(other.columns, key=lambda c: c != "id")])
            if f.kind == "reference":
                right = other.select(F.col("id").alias(key), value.alias(column))
                local = f.keys[0]
            else:
                grouped = other.where(F.col(f"`{f.keys[0]}`").isNotNull()).groupBy(F.col(f"`{f.keys[0]}`").alias(key))
                right = grouped.agg(F.array_sort(F.collect_list(value)).alias(column))
                local = f.keys[1]
            df = df.join(right, df[f"`{local}`"] == right[f"`{key}`"], "left").drop(key)
            if f.kind == "collection":
                empty = F.array().cast(right.schema[column].dataType)
                df = df.withColumn(column, F.coalesce(F.col(f"`{column}`"), empty))
        return df

    def target(self, name: str, tree: dict[str, dict], window: tuple | None, report: PlanReport, needed: tuple[str, DataFrame] | None = None, one: bool = False, only: dict | None = None, at: tuple = (), key: str = "id") -> DataFrame:
        """All rows of a type, with what lies below; of an abstract type, those of its concrete ones and their name.

        needed: a field and the values of it that are asked for. one: a row for each id, as references want it; in a
        collection each child stays, even where two types share an id. key: the field that the rows are joined by.
        """
        subs = self.model.concrete_of(name)
        if not subs:
            raise QueryError(f"no concrete type is a {name}")
        report.scans += len(subs)
        asked = (only or {}).get(at)
        frames = []
        for e in subs:
            some = None if asked is None else [*[c for c in asked if len(subs) == 1 or c in e], key, *self._keys(e, tree)]
            frames.append(self.store.logical(e, self.store.raw(e), some))
        if needed is not None:
            frames = [df.join(needed[1], df[f"`{needed[0]}`"] == needed[1]["__needed"], "left_semi") for df in frames]
        frames = [self.expand(df, e, tree, window, report, narrow=needed is not None, only=only, at=at) for e, df in zip(subs, frames)]
        if not self.model[name].abstract:
            return frames[0]
        kinds: dict[str, T.DataType] = {}
        for e, df in zip(subs, frames):
            for c in df.schema.fields:
                if kinds.setdefault(c.name, c.dataType) != c.dataType:
                    raise QueryError(f"the types below {name} disagree on {c.name!r}")
        union = None
        for e, df in zip(subs, frames):
            df = df.select("id", F.lit(e.name).alias(TYPE), *[F.col(f"`{c}`") for c in df.columns if c != "id"])
            union = df if union is None else union.unionByName(df, allowMissingColumns=True)
        if one and len(subs) > 1:  # one id in two types: the last type by name
            rest = [c for c in union.columns if c != "id"]
            union = union.groupBy("id").agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]), TYPE).alias("__r")).select("id", "__r.*")
        return union

    def _with_series(self, df: DataFrame, entity: Entity, f: Field, column: str, window: tuple | None) -> DataFrame:
        start, end = window or (None, None)
        points = self.series.points(entity, f, start, end)
        key = f"__key_{column}"
        pairs = F.array_sort(F.collect_list(F.struct("ts", "seq", "value")))
        grouped = points.groupBy(F.col("key").alias(key)).agg(F.transform(pairs, lambda p: F.struct(p["ts"].alias("ts"), p["value"].alias("value"))).alias(column))
        df = df.join(grouped, df[f"`{f.keys[0]}`"] == grouped[f"`{key}`"], "left").drop(key)
        return df.withColumn(column, F.coalesce(F.col(f"`{column}`"), F.array().cast(T.ArrayType(POINT))))


def pushed_filters(df: DataFrame) -> list[str]:
    """The conditions that the physical plan's file scans evaluate, one text for each scan."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.inputPlan()
    leaves, out = plan.collectLeaves(), []
    for k in range(leaves.size()):
        if leaves.apply(k).getClass().getSimpleName() == "FileSourceScanExec":
            told = leaves.apply(k).metadata().get("PushedFilters")
            if told.isDefined() and told.get() != "[]":
                out.append(told.get()[1:-1])
    return out


def absent_dropped(value: Any, model: Model) -> Any:
    """Nested rows as dictionaries; a row with a type name keeps that type's fields only."""
    if hasattr(value, "asDict"):
        told = {k: absent_dropped(v, model) for k, v in value.asDict(recursive=False).items()}
        kind = told.get(TYPE)
        if kind in model:
            return {k: v for k, v in told.items() if k == TYPE or k in model[kind]}
        return told
    if isinstance(value, list):
        return [absent_dropped(v, model) for v in value]
    return value
