"""Where the rows of entity types are: bound DataFrames, or folders of Parquet that a log names.

A write adds folders of rows and folders of removed ids below <root>/<table>/ and then one numbered file to the log,
which lists what counts: k new rows cost k rows, however large the table is. A row counts unless a later folder has removed its
id. A failed write leaves the log as it was, and of two writers that began from one version the second is refused.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, StoreError
from ..functions.predicates import Source, seconds
from ..schema.model import Entity, Field


@dataclass
class Binding:
    """Rows that live elsewhere: a path of Parquet or a DataFrame, and columns to compute for physical names that it lacks."""

    source: str | DataFrame
    computed: dict[str, Column] | None = None


def default_root(spark: SparkSession) -> str:
    """For sessions without a path: the shared folder if the cluster names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return f"{named.rstrip('/')}/entities-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise StoreError("a path is needed that all executors share")
    return "file://" + tempfile.mkdtemp(prefix="marlstone-")


class Files:
    """The few things that a store asks of Hadoop's file systems, on the driver."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def add(self, path: str, text: str) -> bool:
        """Whether the file could be made: not if it is there."""
        fs, p = self._at(path)
        if fs.exists(p):
            return False
        _, new = self._at(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        try:
            context.rename(new, p, self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
        except Py4JJavaError as e:
            fs.delete(new, False)
            if "FileAlreadyExists" in e.java_exception.toString():
                return False
            raise
        return True

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class Log:
    """Numbered files in a folder; the highest one holds what counts."""

    def __init__(self, files: Files, folder: str):
        self.files, self.folder = files, folder

    def version(self) -> int:
        """0 if there is none."""
        return max((int(n[:-5]) for n in self.files.names(self.folder) if re.fullmatch(r"\d+\.json", n)), default=0)

    def read(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.folder}/{version:012}.json")) if version else {}

    def commit(self, version: int, told: dict) -> None:
        """told counts from now on, if `version` is still the latest."""
        if self.version() != version or not self.files.add(f"{self.folder}/{version + 1:012}.json", json.dumps(told)):
            raise StoreError(f"{self.folder} has changed meanwhile; nothing was written")

    def prune(self) -> None:
        """Drop all but the latest."""
        last = self.version()
        for n in self.files.names(self.folder):
            if n != f"{last:012}.json":
                self.files.delete(f"{self.folder}/{n}")


#: Folders of a table beyond which a write puts them together.
FOLDERS = 64


class EntityStore:
    def __init__(self, spark: SparkSession, root: str | None = None, bindings: dict[str, Binding | str | DataFrame] | None = None):
        self.spark, self.files = spark, Files(spark)
        self._root = root.rstrip("/") if root else None
        self.bindings = {k: b if isinstance(b, Binding) else Binding(b) for k, b in (bindings or {}).items()}
        self._frames: dict[str, DataFrame] = {}

    @property
    def root(self) -> str:
        if self._root is None:
            self._root = default_root(self.spark)
        return self._root

    # reading

    def raw(self, entity: Entity) -> DataFrame:
        """The rows under physical names."""
        if entity.name not in self._frames:
            self._frames[entity.name] = self._open(entity)
        return self._frames[entity.name]

    def _open(self, entity: Entity) -> DataFrame:
        bound = self.bindings.get(entity.name)
        if bound is not None:
            df = self.spark.read.parquet(bound.source) if isinstance(bound.source, str) else bound.source
            df = df.withColumns(bound.computed) if bound.computed else df
            lacking = [f.column for f in entity.stored if f.column not in df.columns]
            if lacking:
                raise StoreError(f"the source of {entity.name} lacks {', '.join(lacking)}")
            return df
        if not self.exists(entity.table):
            return self.spark.createDataFrame([], entity.physical)
        return self.rows(entity, self.log(entity.table).version())

    def log(self, table: str) -> Log:
        return Log(self.files, f"{self.root}/{table}/log")

    def exists(self, table: str) -> bool:
        return self._root is not None and self.log(table).version() > 0

    def rows(self, entity: Entity, version: int, table: str | None = None) -> DataFrame:
        """What counts in a version, under physical names. Folders with the same removals behind them are one scan."""
        at = f"{self.root}/{table or entity.table}"
        told = self.log(table or entity.table).read(version)
        key, groups = entity["id"].column, {}
        for folder, n in told.get("adds", []):
            groups.setdefault(tuple(g for g, m in told["gone"] if m > n), []).append(f"{at}/{folder}")
        out = None
        for gone, folders in groups.items():
            df = self.spark.read.schema(entity.physical).parquet(*folders)
            if gone:
                ids = self.spark.read.schema(T.StructType([entity.physical[key]])).parquet(*[f"{at}/{g}" for g in gone])
                df = df.join(ids.toDF("__gone"), df[f"`{key}`"] == F.col("__gone"), "left_anti")
            out = df if out is None else out.union(df)
        return self.spark.createDataFrame([], entity.physical) if out is None else out

    def source(self, entity: Entity, f: Field, raw: DataFrame | None = None) -> Source:
        """A stored field over raw rows, for conditions that should reach the scan."""
        raw = self.raw(entity) if raw is None else raw
        kind = raw.schema[f.column].dataType.typeName()
        clock = kind if f.type == "datetime" and kind in ("timestamp", "timestamp_ntz") else None
        return Source(F.col(f"`{f.column}`"), f.type, clock)

    def logical(self, entity: Entity, raw: DataFrame, only: list[str] | None = None) -> DataFrame:
        """Rows under logical names and of the language's types; `only` keeps these fields, and always id."""
        if only is not None:
            for name in only:
                if name not in entity or not entity[name].stored:
                    raise QueryError(f"{entity.name} has no stored field {name!r}")
        fields = [f for f in entity.stored if only is None or f.name == "id" or f.name in only]
        out = []
        for f in fields:
            source = self.source(entity, f, raw)
            c = seconds(source.column, source.clock) if source.clock else source.column
            out.append((c if raw.schema[f.column].dataType == f.spark else c.cast(f.spark)).alias(f.name))
        return raw.select(out)

    # writing

    def writable(self, entity: Entity) -> int:
        """The version that a write starts from."""
        if entity.name in self.bindings:
            raise StoreError(f"{entity.name} is bound to a source that can't be written")
        return self.log(entity.table).version()

    def staged(self, table: str, df: DataFrame) -> tuple[DataFrame, str]:
        """df as files, so that it's made once, and the folder to delete afterwards."""
        path = f"{self.root}/{table}/batch-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _put(self, entity: Entity, rows: DataFrame) -> str:
        """A folder of rows, which come under physical names; sorted by the first index, so that a scan by it can skip."""
        folder = f"v-{uuid.uuid4().hex}"
        rows = rows.select([F.col(f"`{f.column}`").cast(f.spark).alias(f.column) for f in entity.stored])
        by = next(iter(entity.indexes().values()), (None, []))[1]
        (rows.sortWithinPartitions(*[f"`{c}`" for c in by]) if by else rows).write.parquet(f"{self.root}/{entity.table}/{folder}")
        return folder

    def commit(self, entity: Entity, version: int, adds: DataFrame | None, gone: DataFrame | None, whole: bool = False) -> None:
        """adds: rows under physical names; gone: ids to remove from what `version` has. whole: nothing of that stays."""
        log, key = self.log(entity.table), entity["id"].column
        told = {"adds": [], "gone": []} if whole or not version else log.read(version)
        if gone is not None:
            folder = f"g-{uuid.uuid4().hex}"
            path = f"{self.root}/{entity.table}/{folder}"
            gone.select(F.col(gone.columns[0]).cast(entity["id"].spark).alias(key)).write.parquet(path)
            if self.spark.read.schema(T.StructType([entity.physical[key]])).parquet(path).isEmpty():
                self.files.delete(path)
            else:
                told["gone"].append([folder, version + 1])
        if adds is not None:
            told["adds"].append([self._put(entity, adds), version + 1])
        log.commit(version, told)
        self._frames.pop(entity.name, None)
        if len(told["adds"]) + len(told["gone"]) > FOLDERS:
            self.compact(entity)

    def replace(self, entity: Entity, rows: DataFrame) -> None:
        """rows: physical names; all that the table has from now on."""
        self.commit(entity, self.writable(entity), rows, None, whole=True)

    def compact(self, entity: Entity) -> None:
        """Put a table's folders together."""
        version = self.writable(entity)
        self.commit(entity, version, self.rows(entity, version), None, whole=True)

    def vacuum(self, table: str) -> list[str]:
        """Delete the folders of a table that no longer count; readers that still hold them fail."""
        log = self.log(table)
        told = log.read(log.version())
        held = {n for n, _ in [*told.get("adds", []), *told.get("gone", [])]}
        old = [n for n in self.files.names(f"{self.root}/{table}") if n != "log" and n not in held]
        for n in old:
            self.files.delete(f"{self.root}/{table}/{n}")
        log.prune()
        return old

    def drop(self, table: str) -> None:
        self.files.delete(f"{self.root}/{table}")

    def rename(self, old: str, new: str) -> None:
        fs, p = self.files._at(f"{self.root}/{old}")
        if fs.exists(p):
            fs.rename(p, self.files._at(f"{self.root}/{new}")[1])

    def forget(self) -> None:
        """Open all tables anew."""
        self._frames.clear()

    # introspection

    def columns(self, entity: Entity) -> list[str]:
        return [f.column for f in entity.stored]

    def index_names(self, entity: Entity) -> list[str]:
        return sorted(entity.indexes())
