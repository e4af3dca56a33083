"""Measurements from a stream into a series (an extension: batch appends are the plain way).

Each micro-batch is sorted by time and appended whole, with its number, so that one that is replayed after a failure
isn't appended again; points that are older than what their key already holds are late and go to `late`, if given, since a
series only grows forwards.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.series import check_series
from ..session import Session


def ingest(session: Session, entity: str, field: str, stream: DataFrame, checkpoint: str, late: Callable[[DataFrame], None] | None = None, **trigger) -> StreamingQuery:
    """stream: key, ts and value. trigger: as for DataStreamWriter.trigger, available now if not given."""
    e = session.entity(entity).entity
    f = check_series(e, field)

    def append(batch: DataFrame, number: int) -> None:
        if number <= session.series.seen(checkpoint):
            return
        rows = batch.select(F.col(batch.columns[0]).alias("key"), F.col(batch.columns[1]).cast("bigint").alias("ts"), F.col(batch.columns[2]).cast("double").alias("value")).persist()
        try:
            last = session.series.latest(e, f).withColumn("key", F.col("key").cast(rows.schema["key"].dataType))
            placed = rows.join(last, "key", "left")
            if late is not None:
                late(placed.where("ts < last").select("key", "ts", "value"))
            good = placed.where("last is null or ts >= last").select("key", "ts", "value")
            n = int(session.spark.conf.get("spark.sql.shuffle.partitions"))
            session.series.append(e, f, good.repartition(n, "key").sortWithinPartitions("key", "ts"), (checkpoint, number))
        finally:
            rows.unpersist()

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def windowed(stream: DataFrame, ts: str, delay: str, length: str, slide: str | None = None, keys: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Count, sum, least and greatest of each window and key; rows later than `delay` are left out."""
    window = F.window(ts, length, slide) if slide else F.window(ts, length)
    sums = [F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("greatest")]
    return stream.withWatermark(ts, delay).groupBy(window.alias("w"), *keys).agg(*sums).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "least", "greatest")
