"""Append-only series: open points as Parquet batches, sealed points as compressed segments.

A log of small manifests names the batches and segment tables that count; it moves only when all of an append or flush is
written, and of two writers that began from one version the second is refused. Appends must not go back in time for their key, within a batch or across batches; equal times keep their
order. Sealing deals out runs of whole segments by range, so that one long series is the work of many tasks and no border
between tasks cuts a segment.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError, StoreError
from ..functions.predicates import instant, seconds
from ..schema.model import Entity, Field
from ..sources.store import EntityStore, Log
from . import codec

_OF = [("type", T.StringType()), ("field", T.StringType()), ("key", T.StringType())]
POINTS = T.StructType([T.StructField(*c) for c in [*_OF, ("ts", T.LongType()), ("value", T.DoubleType()), ("seq", T.LongType())]])
SEGMENTS = T.StructType([T.StructField(*c) for c in [*_OF, ("min_ts", T.LongType()), ("max_ts", T.LongType()), ("n", T.IntegerType()), ("first_seq", T.LongType()), ("blob", T.BinaryType())]])
SEGMENT_POINTS = 512
#: Arrivals whose order one window checks, as a power of two.
BLOCK_BITS = 20
#: Points of one key that one task seals together, and arrivals that one window numbers for it, as a power of two.
RUN_BITS = 17
#: Bytes that a segment's own numbers and an open point count for in the stats.
SEGMENT_BYTES, POINT_BYTES = 32, 16


@dataclass
class SeriesBinding:
    """Measurements that live elsewhere; append is refused."""

    source: str | DataFrame
    key: str
    ts: str
    value: str


class SeriesStore:
    def __init__(self, store: EntityStore, bindings: dict[tuple[str, str], SeriesBinding] | None = None, segment_points: int = SEGMENT_POINTS):
        if segment_points < 1:
            raise StoreError("a segment holds a point or more")
        self.store, self.spark = store, store.spark
        self.bindings, self.segment_points = bindings or {}, segment_points

    # manifest

    @property
    def root(self) -> str:
        return f"{self.store.root}/_series"

    @property
    def log(self) -> Log:
        return Log(self.store.files, f"{self.root}/log")

    def _manifest(self) -> dict[str, Any]:
        """since: where the points of a series begin that was dropped before; streams: their last batch."""
        version = 0 if self.store._root is None else self.log.version()
        return {"version": version, "next": 0, "points": [], "segments": [], "since": {}, "streams": {}, **(self.log.read(version) if version else {})}

    def _commit(self, manifest: dict[str, Any]) -> None:
        self.log.commit(manifest["version"], {k: v for k, v in manifest.items() if k != "version"})

    def _open(self, kind: str, schema: T.StructType, manifest: dict[str, Any]) -> DataFrame:
        folders = manifest[kind]
        if not folders:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(*[f"{self.root}/{kind}/{f}" for f in folders])
        seq = "seq" if kind == "points" else "first_seq"
        for (type_, field, n) in manifest["since"].values():
            df = df.where(~((F.col("type") == type_) & (F.col("field") == field) & (F.col(seq) < n)))
        return df

    def open_points(self) -> DataFrame:
        return self._open("points", POINTS, self._manifest())

    def segments(self) -> DataFrame:
        return self._open("segments", SEGMENTS, self._manifest())

    def drop(self, names: list[tuple[str, str]]) -> None:
        """Points that the series of these types and fields have now don't count any more."""
        manifest = self._manifest()
        if names and manifest["version"]:
            manifest["since"].update({f"{t}.{f}": [t, f, manifest["next"]] for t, f in names})
            self._commit(manifest)

    # reading

    def overlapping(self, entity: Entity, f: Field, start: int | None = None, end: int | None = None) -> DataFrame:
        """Sealed segments that may hold points of the range."""
        out = self.segments().where((F.col("type") == entity.name) & (F.col("field") == f.name))
        if start is not None:
            out = out.where(F.col("max_ts") >= start)
        return out if end is None else out.where(F.col("min_ts") <= end)

    def points(self, entity: Entity, f: Field, start: int | None = None, end: int | None = None, key: Any = None) -> DataFrame:
        """key, ts, value and seq; both ends of the range belong to it."""
        bound = self.bindings.get((entity.name, f.name))
        kind = entity[f.keys[0]].spark
        if bound:
            return self._bound(bound, kind, start, end, key)
        manifest = self._manifest()
        own = self._open("points", POINTS, manifest).where((F.col("type") == entity.name) & (F.col("field") == f.name))
        sealed = self.overlapping(entity, f, start, end)
        if key is not None:
            own, sealed = own.where(F.col("key") == str(key)), sealed.where(F.col("key") == str(key))
        out = own.select("key", "ts", "value", "seq")
        if manifest["segments"]:
            out = out.unionByName(sealed.select("key", "first_seq", "blob").mapInArrow(_decoded, "key string, ts bigint, value double, seq bigint"))
        if start is not None:
            out = out.where(F.col("ts") >= start)
        if end is not None:
            out = out.where(F.col("ts") <= end)
        return out.withColumn("key", F.col("key").cast(kind))

    def _bound(self, b: SeriesBinding, kind: T.DataType, start, end, key) -> DataFrame:
        df = self.spark.read.parquet(b.source) if isinstance(b.source, str) else b.source
        clock = df.schema[b.ts].dataType.typeName()
        clock = clock if clock.startswith("timestamp") else None
        ts = F.col(f"`{b.ts}`")
        if start is not None:  # the bound has the column's type, so that it reaches the scan
            df = df.where(ts >= (instant(start, clock) if clock else start))
        if end is not None:  # a fraction of the last second belongs to it
            df = df.where(ts < instant(end + 1, clock) if clock else ts <= end)
        if key is not None:
            df = df.where(F.col(f"`{b.key}`") == key)
        whole = seconds(ts, clock) if clock else ts.cast("bigint")
        order = F.unix_micros(ts.cast("timestamp")) if clock else F.lit(0).cast("bigint")
        return df.select(F.col(f"`{b.key}`").cast(kind).alias("key"), whole.alias("ts"), F.col(f"`{b.value}`").cast("double").alias("value"), order.alias("seq"))

    # writing

    def latest(self, entity: Entity, f: Field) -> DataFrame:
        """key (as text) and the last time it holds, from the segments' bounds and the open points."""
        held = self.open_points().where((F.col("type") == entity.name) & (F.col("field") == f.name)).select("key", F.col("ts").alias("last"))
        held = held.unionByName(self.overlapping(entity, f).select("key", F.col("max_ts").alias("last")))
        return held.groupBy("key").agg(F.max("last").alias("last"))

    def seen(self, stream: str) -> int:
        """The last batch of a stream that was appended, -1 if none."""
        return self._manifest()["streams"].get(stream, -1)

    def append(self, entity: Entity, f: Field, rows: DataFrame | list[tuple[Any, int, float]], stream: tuple[str, int] | None = None) -> None:
        """rows: key, ts, value, in the order of arrival; with a DataFrame, of its partitions and their rows.

        stream: the name and batch number that are recorded with it.
        """
        if (entity.name, f.name) in self.bindings:
            raise StoreError(f"{entity.name}.{f.name} is bound to a source that can't be written")
        manifest = self._manifest()
        if isinstance(rows, DataFrame):
            new = rows.select(F.col(rows.columns[0]).cast("string").alias("key"), F.col(rows.columns[1]).cast("bigint").alias("ts"), F.col(rows.columns[2]).cast("double").alias("value"), F.monotonically_increasing_id().alias("n"))
        else:
            told = [(str(k), int(t), float(v), n) for n, (k, t, v) in enumerate(rows)]
            if not told:
                return
            new = self.spark.createDataFrame(told, "key string, ts bigint, value double, n bigint")
        folder = f"b-{uuid.uuid4().hex}"
        path = f"{self.root}/points/{folder}"
        # each partition of a batch has 2^33 places; a batch has its own range
        new.select(F.lit(entity.name).alias("type"), F.lit(f.name).alias("field"), "key", "ts", "value", (F.col("n") + manifest["next"]).alias("seq")).write.parquet(path)
        batch = self.spark.read.schema(POINTS).parquet(path)
        self._refuse_disorder(entity, f, batch)
        last = batch.agg(F.max("seq")).first()[0]
        if last is None:
            return
        manifest["points"].append(folder)
        manifest["next"] = last + 1
        if stream:
            manifest["streams"][stream[0]] = stream[1]
        self._commit(manifest)

    def _refuse_disorder(self, entity: Entity, f: Field, batch: DataFrame) -> None:
        # in order of arrival, a point isn't before the latest of those before it: first within blocks of arrivals, so
        # that a long series is the work of many tasks, then from block to block
        blocks = batch.withColumn("block", F.shiftright("seq", BLOCK_BITS))
        before = F.lag("ts").over(W.partitionBy("key", "block").orderBy("seq"))
        back = blocks.withColumn("before", before).where("ts < before or ts is null or value is null or key is null")
        ends = blocks.groupBy("key", "block").agg(F.min_by("ts", "seq").alias("ts"), F.max("ts").alias("last"))
        past = F.max("last").over(W.partitionBy("key").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
        across = ends.withColumn("before", past).where("ts < before")
        found = back.select("key", "ts", "before").union(across.select("key", "ts", "before")).limit(1).collect()
        if found:
            raise StoreError(f"{entity.name}.{f.name} of {found[0]['key']!r}: {found[0]['ts']} comes after {found[0]['before']}")
        first = batch.groupBy("key").agg(F.min("ts").alias("ts"))
        back = first.join(self.latest(entity, f), "key").where("ts < last").limit(1).collect()
        if back:
            raise StoreError(f"{entity.name}.{f.name} of {back[0]['key']!r}: {back[0]['ts']} comes after {back[0]['last']}")

    def flush(self) -> None:
        """Seal all open points."""
        manifest = self._manifest()
        if not manifest["points"]:
            return
        folder = f"s-{uuid.uuid4().hex}"
        self.encoded(self.open_points()).write.parquet(f"{self.root}/segments/{folder}")
        manifest["points"] = []
        manifest["segments"].append(folder)
        self._commit(manifest)

    def encoded(self, points: DataFrame) -> DataFrame:
        return encode_segments(points, self.segment_points)

    def stats(self) -> dict[str, float]:
        sealed = self.segments().agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.octet_length("blob") + SEGMENT_BYTES), F.lit(0))).first()
        own = self.open_points()
        open_ = own.count()
        series = self.segments().select("type", "field", "key").union(own.select("type", "field", "key")).distinct().count()
        points, size = sealed[0] + open_, sealed[2] + POINT_BYTES * open_
        return {"series": series, "points": points, "segments": sealed[1], "encoded_bytes": size, "raw_bytes": POINT_BYTES * points, "ratio": POINT_BYTES * points / size if size else 0.0}


def _runs(points: DataFrame, segment_points: int) -> DataFrame:
    """points with the run of whole segments that each belongs to, counted from its key's first point; a short key is one run."""
    of = [c for c, _ in _OF]
    size = segment_points * max(1, (1 << RUN_BITS) // segment_points)
    long = F.broadcast(points.groupBy(of).count().where(F.col("count") > size).select(of))
    short = points.join(long, of, "left_anti").select(*POINTS.names, F.lit(0).cast("bigint").alias("run"))
    # a long key's points are numbered within blocks of arrivals, after the points of its blocks before
    blocks = points.join(long, of, "left_semi").withColumn("block", F.shiftright("seq", RUN_BITS))
    past = F.sum("count").over(W.partitionBy(of).orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    before = blocks.groupBy(*of, "block").count().select(*of, "block", F.coalesce(past, F.lit(0)).alias("before"))
    place = F.row_number().over(W.partitionBy(*of, "block").orderBy("ts", "seq")) - 1
    placed = blocks.withColumn("place", place).join(before, [*of, "block"])
    return short.unionByName(placed.select(*POINTS.names, F.expr(f"(before + place) div {size}").alias("run")))


def encode_segments(points: DataFrame, segment_points: int) -> DataFrame:
    """POINTS rows as SEGMENTS rows of segment_points each, the last of a key of what is left.

    A key's seq doesn't fall while its ts rises, as append sees to.
    """
    order = ["type", "field", "key", "ts", "seq"]

    def seal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def cut(table: pa.Table, last: bool) -> tuple[list[dict], pa.Table | None]:
            ts, value, seq = (table.column(c).to_numpy() for c in ("ts", "value", "seq"))
            same = np.ones(table.num_rows, bool)
            for c in ("type", "field", "key"):
                codes = table.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
                same[1:] &= codes[1:] == codes[:-1]
            starts = np.flatnonzero(~np.r_[False, same[1:]])
            out, rest = [], None
            for a, b in zip(starts, np.r_[starts[1:], table.num_rows]):
                for x in range(a, b, segment_points):
                    y = min(b, x + segment_points)
                    if y == table.num_rows and y - x < segment_points and not last:
                        rest = table.slice(x)
                        break
                    out.append({"type": table.column("type")[x].as_py(), "field": table.column("field")[x].as_py(), "key": table.column("key")[x].as_py(), "min_ts": int(ts[x]), "max_ts": int(ts[y - 1]), "n": y - x, "first_seq": int(seq[x]), "blob": codec.encode(ts[x:y], value[x:y])})
            return out, rest

        def made(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            if rows:
                kinds = {"min_ts": pa.int64(), "max_ts": pa.int64(), "n": pa.int32(), "first_seq": pa.int64(), "blob": pa.binary()}
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in SEGMENTS.names], SEGMENTS.names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            rows, held = cut(pa.concat_tables([held, table]) if held is not None else table, False)
            yield from made(rows)
        if held is not None:
            yield from made(cut(held, True)[0])

    dealt = _runs(points.select(POINTS.names), segment_points).repartitionByRange("type", "field", "key", "run")
    return dealt.select(POINTS.names).sortWithinPartitions(*order).mapInArrow(seal, SEGMENTS)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            keys, seqs, blobs = (batch.column(c).slice(k, 256).to_pylist() for c in range(3))
            told = [codec.decode(b) for b in blobs]
            if told:
                sizes = [len(t) for t, _ in told]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array(keys, object), sizes), pa.string()), pa.array(np.concatenate([t for t, _ in told])), pa.array(np.concatenate([v for _, v in told])), pa.array(np.concatenate([s + np.arange(n) for s, n in zip(seqs, sizes)]))],
                    ["key", "ts", "value", "seq"],
                )


def check_series(entity: Entity, name: str) -> Field:
    if name not in entity or entity[name].kind != "timeseries":
        raise QueryError(f"{entity.name}.{name} isn't a series")
    return entity[name]
