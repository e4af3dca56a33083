"""Batch writes: what a batch adds to the old rows and which ids it removes, all or nothing.

Of the old rows only those are read whole that the batch replaces; the others give their ids or unique keys at most.

The batch's rows carry an ordinal, so that of rows with one id the last wins, and the names that were given, so that
defaults fill what is missing and an explicit null stays null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, StoreError
from ..schema.model import Entity

ORDINAL, GIVEN = "__ordinal", "__given"
Rows = dict[str, Any] | list[dict[str, Any]] | DataFrame


@dataclass
class Delta:
    """Rows to add, and a column of ids to remove from the old rows; under logical names."""

    adds: DataFrame | None
    gone: DataFrame | None


def batch(spark: SparkSession, entity: Entity, rows: Rows, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All stored fields, with null for what is missing, and the ordinal and given names of each row.

    stage: makes a DataFrame's rows once, so that all who read them see the same ordinals.
    """
    names = [f.name for f in entity.stored]
    if isinstance(rows, DataFrame):
        _check_names(entity, rows.columns)
        given = [c for c in rows.columns]
        columns = [(F.col(f"`{f.name}`").cast(f.spark) if f.name in given else F.lit(None).cast(f.spark)).alias(f.name) for f in entity.stored]
        if "id" not in given:
            raise StoreError(f"rows of {entity.name} need an id")
        out = stage(rows.select(*columns, F.monotonically_increasing_id().alias(ORDINAL), F.array(*map(F.lit, given)).alias(GIVEN)))
        if not out.where("id is null").isEmpty():
            raise StoreError(f"rows of {entity.name} need an id")
        return out
    told = []
    for k, row in enumerate([rows] if isinstance(rows, dict) else rows):
        _check_names(entity, row)
        if row.get("id") is None:
            raise StoreError(f"rows of {entity.name} need an id")
        told.append((*(_typed(entity, f, row.get(f.name)) for f in entity.stored), k, sorted(row)))
    schema = T.StructType([*entity.schema.fields, T.StructField(ORDINAL, T.LongType()), T.StructField(GIVEN, T.ArrayType(T.StringType()))])
    assert schema.names[: len(names)] == names
    return spark.createDataFrame(told, schema)


def _check_names(entity: Entity, names) -> None:
    for n in names:
        if n not in entity or not entity[n].stored:
            raise QueryError(f"{entity.name} has no stored field {n!r}")


_PYTHON = {"string": str, "int": int, "long": int, "datetime": int, "boolean": bool, "double": float}


def _typed(entity: Entity, f, value: Any) -> Any:
    if value is None:
        return None
    kind = _PYTHON[f.type]
    if f.type == "double" and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise StoreError(f"{entity.name}.{f.name} is a {f.type}; {value!r} isn't")
    if kind is int and not -(1 << (31 if f.type == "int" else 63)) <= value < 1 << (31 if f.type == "int" else 63):
        raise StoreError(f"{entity.name}.{f.name} can't hold {value}")
    return value


def _defaulted(entity: Entity, df: DataFrame) -> DataFrame:
    """Defaults where a name wasn't given."""
    out = {f.name: F.when(F.array_contains(GIVEN, f.name), F.col(f"`{f.name}`")).otherwise(F.lit(f.default).cast(f.spark)) for f in entity.stored if f.has_default and f.default is not None}
    return df.withColumns(out) if out else df


def _last(entity: Entity, df: DataFrame) -> DataFrame:
    """The last row of each id."""
    rest = [f.name for f in entity.stored if f.name != "id"]
    if not rest:
        return df.select("id").distinct()
    return df.groupBy("id").agg(F.max_by(F.struct(*[f"`{c}`" for c in rest]), ORDINAL).alias("r")).select("id", "r.*")


def _named(entity: Entity, df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{f.name}`") for f in entity.stored])


def create(entity: Entity, old: DataFrame, new: DataFrame) -> Delta:
    """An id that is there, or twice in the batch, is an error."""
    twice = new.groupBy("id").count().where("count > 1").select("id").union(new.join(old.select("id"), "id", "left_semi").select("id")).limit(1).collect()
    if twice:
        raise StoreError(f"{entity.name} {twice[0][0]!r} exists")
    return checked(entity, old, _named(entity, _defaulted(entity, new)), None)


def upsert(entity: Entity, old: DataFrame, new: DataFrame) -> Delta:
    """New rows, and rows that replace those of their id in all fields."""
    new = _named(entity, _last(entity, _defaulted(entity, new)))
    return checked(entity, old, new, old.select("id").join(new.select("id"), "id", "left_semi"))


def merge(entity: Entity, old: DataFrame, new: DataFrame) -> Delta:
    """New rows, and rows whose non-null fields replace those of their id. In a batch each field's last non-null wins."""
    rest = [f for f in entity.stored if f.name != "id"]
    some = [F.max_by(F.col(f"`{f.name}`"), F.when(F.col(f"`{f.name}`").isNotNull(), F.col(ORDINAL))).alias(f.name) for f in rest]
    given = F.array_distinct(F.flatten(F.collect_list(GIVEN))).alias(GIVEN)
    new = new.groupBy("id").agg(*some, given)
    met = old.join(new.select("id"), "id", "left_semi")
    o, n = met.withColumn("__old", F.lit(True)).alias("o"), new.alias("n")
    both = n.join(o, F.col("o.id") == F.col("n.id"), "left")

    def value(f):
        default = F.when(F.col("o.__old").isNull() & ~F.array_contains(f"n.{GIVEN}", f.name), F.lit(f.default).cast(f.spark))
        return F.coalesce(F.col(f"n.`{f.name}`"), F.col(f"o.`{f.name}`"), *([default] if f.has_default and f.default is not None else [])).alias(f.name)

    return checked(entity, old, _named(entity, both.select(F.col("n.id").alias("id"), *map(value, rest))), met.select("id"))


def remove(entity: Entity, old: DataFrame, ids: list[Any] | DataFrame) -> Delta:
    """Without these ids; ids that aren't there are ignored."""
    if not isinstance(ids, DataFrame):
        ids = old.sparkSession.createDataFrame([(_typed(entity, entity["id"], i),) for i in ids], T.StructType([T.StructField("id", entity["id"].spark)]))
    return Delta(None, old.select("id").join(ids.select(F.col(ids.columns[0]).alias("id")), "id", "left_semi"))


def checked(entity: Entity, old: DataFrame, adds: DataFrame, gone: DataFrame | None) -> Delta:
    """The delta, if no unique index has a key twice after it; keys with a null don't count."""
    names = {f.column: f.name for f in entity.stored}
    for index, (unique, columns) in entity.indexes().items():
        if unique:
            keys = [names[c] for c in columns]
            some = adds.dropna(subset=keys).select(*[f"`{k}`" for k in keys])
            twice = some.groupBy(*[f"`{k}`" for k in keys]).count().where("count > 1").drop("count")
            held = old.select("id", *[f"`{k}`" for k in keys if k != "id"])
            held = held if gone is None else held.join(gone, "id", "left_anti")
            twice = twice.union(held.join(some, keys, "left_semi").select(*[f"`{k}`" for k in keys])).limit(1).collect()
            if twice:
                raise StoreError(f"{index}: {tuple(twice[0])} is there twice")
    return Delta(adds, gone)
