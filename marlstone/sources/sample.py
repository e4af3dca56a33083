"""Rows made by rule for tests and timings: districts, their water meters, repairs and a day curve for each meter.

All columns are expressions of a row number and a seed, so that any number of rows is made in parallel and comes out the
same each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = """
entity type District { id: int, name: string, zone: string, devices: [Device](districtId, id), repairs: [Repair](districtId, id) }
abstract entity type Device { id: int, districtId: int, state: string = "new", district: District(districtId) }
@db(index="state")
entity type Meter extends Device schema name "METER" {
  flow: double schema name "MAX_FLOW"
  installed: datetime
  repairs: [Repair](deviceId, id)
  litres: timeseries<double>(id)
}
entity type Valve extends Device { bore: double }
entity type Repair { id: long, districtId: int, deviceId: int, opened: datetime, kind: string, minutes: int, device: Meter(deviceId) }
"""
# What the drawn columns may hold.
ZONES, STATES, KINDS = ("hill", "shore", "town"), ("open", "shut", "worn", "new"), ("leak", "seal", "check", "swap")
START, STEP = 1_600_000_000, 900


def _drawn(seed: int, what: str, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), F.col("id")), F.lit(n))


def _one_of(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def entities(spark: SparkSession, districts: int, meters: int, repairs: int, seed: int = 0) -> dict[str, DataFrame]:
    """meters: of each district, beside one valve for ten of them; repairs: of each district."""
    d, m, v, r = (spark.range(n) for n in (districts, districts * meters, districts * max(1, meters // 10), districts * repairs))
    number = F.col("id").cast("int")
    return {
        "District": d.select(number.alias("id"), F.concat(F.lit("district "), "id").alias("name"), _one_of(ZONES, _drawn(seed, "zone", 3)).alias("zone")),
        "Meter": m.select(number.alias("id"), F.pmod(F.col("id"), F.lit(districts)).cast("int").alias("districtId"), _one_of(STATES, _drawn(seed, "state", 4)).alias("state"), F.when(_drawn(seed, "none", 20) > 0, _drawn(seed, "flow", 4000) / 8).alias("flow"), (START + _drawn(seed, "installed", 10_000_000)).alias("installed")),
        "Valve": v.select(number.alias("id"), F.pmod(F.col("id"), F.lit(districts)).cast("int").alias("districtId"), _one_of(STATES, _drawn(seed, "valve", 4)).alias("state"), (_drawn(seed, "bore", 90) / 4).alias("bore")),
        "Repair": r.select("id", F.pmod(F.col("id"), F.lit(districts)).cast("int").alias("districtId"), _drawn(seed, "device", districts * meters).cast("int").alias("deviceId"), (START + _drawn(seed, "opened", 30_000_000)).alias("opened"), _one_of(KINDS, _drawn(seed, "kind", 4)).alias("kind"), _drawn(seed, "minutes", 600).cast("int").alias("minutes")),
    }


def points(spark: SparkSession, meters: int, each: int, seed: int = 0) -> DataFrame:
    """key, ts and value of `each` points for each meter, in the order of time: a day's wave, a wander of the meter's own, and rounding."""
    meter, k = F.pmod(F.col("id"), F.lit(meters)), F.floor(F.col("id") / meters)
    phase = F.pmod(F.xxhash64(F.lit(seed), meter), F.lit(96))
    value = 40 + 15 * F.sin((k + phase) * 0.0654498) + (_drawn(seed, "noise", 2001) - 1000) / 800
    return spark.range(meters * each).select(meter.cast("int").alias("key"), (START + k * STEP).alias("ts"), F.round(value, 2).alias("value"))
