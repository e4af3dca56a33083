"""The application's view: a model, its rows and its series."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ModelError, QueryError
from .functions import predicates
from .functions.metrics import compile_metrics
from .operators import evolve, writes
from .operators.series import SEGMENT_POINTS, SeriesBinding, SeriesStore, check_series
from .plans.fetch import Planner, PlanReport, absent_dropped, include_tree, pushed_filters
from .schema.model import Entity, Model, load
from .sources.store import Binding, EntityStore


class Rows:
    """A lazy result: `df` for more work on the cluster, or dictionaries on the driver."""

    def __init__(self, df: DataFrame, session: Session, report: PlanReport | None = None):
        self.df, self.report, self._session = df, report, session

    def to_dicts(self) -> list[dict[str, Any]]:
        return list(self)

    def __iter__(self) -> Iterator[dict[str, Any]]:
        for row in self.df.collect():
            self._session.counters["rows_returned"] += 1
            yield absent_dropped(row, self._session.model)

    def count(self) -> int:
        return self.df.count()

    def pushed_filters(self) -> list[str]:
        return pushed_filters(self.df)

    def explain(self) -> str:
        return self.df._jdf.queryExecution().explainString(self.df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


class EntitySet:
    def __init__(self, session: Session, entity: Entity):
        self.session, self.entity = session, entity

    # reading

    def fetch(self, filter: str | None = None, include: list[str] | None = None, order: Any = None, limit: int | None = None, offset: int | None = None, window: tuple | None = None, columns: list[str] | None = None, observe: bool = False) -> Rows:
        df, report = self.session.planner.fetch(self.entity, filter, include, order, limit, offset, window, columns, observe)
        self.session._planned(report)
        return Rows(df, self.session, report)

    def fetch_one(self, filter: str | None = None, **more: Any) -> dict[str, Any] | None:
        return next(iter(self.fetch(filter, limit=1, **more)), None)

    def get(self, id: Any, include: list[str] | None = None, window: tuple | None = None) -> dict[str, Any] | None:
        raw = self.session.store.raw(self.entity).where(F.col(f"`{self.entity['id'].column}`") == F.lit(id))
        planner = self.session.planner
        tree = include_tree(include)
        planner.check_tree(self.entity, tree)
        report = PlanReport(self.entity.name, own_filter=True)
        df = planner.expand(self.session.store.logical(self.entity, raw), self.entity, tree, window, report)
        self.session._planned(report)
        return next(iter(Rows(df, self.session, report)), None)

    def _own_only(self, filter: str | None) -> DataFrame:
        own, rest = predicates.split(predicates.parse_filter(filter))
        if rest is not None:
            raise QueryError("only a type's own fields can be counted or aggregated by")
        raw = self.session.store.raw(self.entity)
        return raw if own is None else raw.where(self.session.planner.own_filter(self.entity, own))

    def count(self, filter: str | None = None) -> int:
        return self._own_only(filter).count()

    def evaluate(self, group: list[str] | None = None, metrics: dict[str, str] | None = None, filter: str | None = None, order: Any = None, limit: int | None = None) -> Rows:
        """Aggregates of one type: a row for each group, or one row without groups."""
        planner, entity = self.session.planner, self.entity
        group = [group] if isinstance(group, str) else list(group or [])
        keys = [planner.own_source(entity, g).value().cast(entity[g].spark).alias(g) for g in group]
        found = compile_metrics(metrics or {}, lambda n: planner.own_source(entity, n))
        if clash := set(group) & set(metrics or {}):
            raise QueryError(f"{sorted(clash)[0]!r} is both a group and a metric")
        raw = self._own_only(filter)
        df = raw.groupBy(*keys).agg(*found) if keys else raw.agg(*found)
        for spec in reversed([order] if isinstance(order, str) else order or []):
            name = spec.removeprefix("-") if isinstance(spec, str) else spec[0]
            if name not in df.columns:
                raise QueryError(f"no group or metric {name!r} to order by")
        specs = [(s.removeprefix("-"), s.startswith("-")) if isinstance(s, str) else (s[0], str(s[1]).lower() == "desc") for s in ([order] if isinstance(order, str) else order or [])]
        if specs:
            df = df.orderBy(*[F.col(f"`{n}`").desc_nulls_last() if down else F.col(f"`{n}`").asc_nulls_first() for n, down in specs])
        return Rows(df if limit is None else df.limit(limit), self.session)

    # writing

    def _write(self, verb, rows) -> None:
        store, entity, staged = self.session.store, self.entity, []
        version = store.writable(entity)
        old = store.logical(entity, store.rows(entity, version))

        def stage(df: DataFrame) -> DataFrame:
            df, path = store.staged(entity.table, df)
            staged.append(path)
            return df

        try:
            if verb is not writes.remove:
                rows = writes.batch(self.session.spark, entity, rows, stage)
            delta = verb(entity, old, rows)
            adds = None if delta.adds is None else delta.adds.select([F.col(f"`{f.name}`").alias(f.column) for f in entity.stored])
            store.commit(entity, version, adds, delta.gone)
        finally:
            for path in staged:
                store.files.delete(path)

    def create(self, rows: writes.Rows) -> None:
        self._write(writes.create, rows)

    def upsert(self, rows: writes.Rows) -> None:
        self._write(writes.upsert, rows)

    def merge(self, rows: writes.Rows) -> None:
        self._write(writes.merge, rows)

    def remove(self, ids: Any) -> None:
        self._write(writes.remove, [ids] if not isinstance(ids, (list, tuple, set, DataFrame)) else ids)

    # series

    def append_series(self, field: str, key: Any = None, points: list[tuple[int, float]] | None = None, rows: Any = None) -> None:
        """points of one key, or rows of (key, ts, value) as a list or a DataFrame."""
        f = check_series(self.entity, field)
        self.session.series.append(self.entity, f, rows if rows is not None else [(key, t, v) for t, v in points or []])

    def series(self, field: str, key: Any = None, start: int | None = None, end: int | None = None) -> DataFrame:
        """ts and value of one key in order, or key, ts and value of all."""
        f = check_series(self.entity, field)
        df = self.session.series.points(self.entity, f, start, end, key)
        ordered = df.orderBy("key", "ts", "seq")
        return ordered.select("ts", "value") if key is not None else ordered.select("key", "ts", "value")


class Session:
    def __init__(self, spark: SparkSession, model: Model, store: EntityStore, series: SeriesStore):
        self.spark, self.model, self.store, self.series = spark, model, store, series
        self.planner = Planner(model, store, series)
        self.counters = {"requests": 0, "scans": 0, "rows_returned": 0}
        self.last_report: PlanReport | None = None
        self._sets: dict[str, EntitySet] = {}

    def entity(self, name: str) -> EntitySet:
        if name not in self._sets:
            try:
                entity = self.model[name]
            except ModelError as e:
                raise QueryError(str(e)) from None
            if entity.abstract:
                raise QueryError(f"{name} is abstract; it has no rows of its own")
            self._sets[name] = EntitySet(self, entity)
        return self._sets[name]

    __getitem__ = entity

    def _planned(self, report: PlanReport) -> None:
        self.counters["requests"] += 1
        self.counters["scans"] += report.scans
        self.last_report = report

    def flush(self) -> None:
        self.series.flush()

    def reset_counters(self) -> None:
        self.counters = dict.fromkeys(self.counters, 0)

    def stats(self) -> dict[str, Any]:
        return {**self.counters, "series": self.series.stats()}

    def evolve(self, new: Model | str, allow_destructive: bool = False) -> evolve.Plan:
        """Carry out the changes to a new model; see operators.evolve."""
        new = load(new) if isinstance(new, str) else new
        plan = evolve.apply(self.store, self.model, new, allow_destructive, self.series)
        self.model = new
        self.planner = Planner(new, self.store, self.series)
        self._sets.clear()
        return plan

    def close(self) -> None:
        self._sets.clear()
        self.store.forget()


def connect(spark: SparkSession, model: Model | str, path: str | None = None, bindings: dict[str, Binding | str | DataFrame] | None = None, series: dict[tuple[str, str], SeriesBinding] | None = None, segment_points: int = SEGMENT_POINTS) -> Session:
    """path: a folder that driver and executors share, for rows and series that are written here."""
    store = EntityStore(spark, path, bindings)
    return Session(spark, load(model) if isinstance(model, str) else model, store, SeriesStore(store, series, segment_points))
