"""The driver's tables as a model, a query for each operator over them, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import EvolutionError, QueryError, StoreError
from ..operators import evolve
from ..operators.series import SEGMENT_POINTS, SeriesBinding, _decoded, encode_segments
from ..schema.model import load
from ..session import Session, connect
from ..sources.store import Binding

MODEL = """
entity type Region schema name "region" {
  id: int schema name "r_regionkey"
  name: string schema name "r_name"
  nations: [Nation](regionKey, id)
}
entity type Nation schema name "nation" {
  id: int schema name "n_nationkey"
  name: string schema name "n_name"
  regionKey: int schema name "n_regionkey"
  region: Region(regionKey)
  parties: [Party](nationKey, id)
}
abstract entity type Party {
  id: long
  name: string
  nationKey: int
  acctbal: double
  nation: Nation(nationKey)
}
entity type Customer extends Party schema name "customer" {
  id: long schema name "c_custkey"
  name: string schema name "c_name"
  nationKey: int schema name "c_nationkey"
  acctbal: double schema name "c_acctbal"
  segment: string schema name "c_mktsegment"
  orders: [Order](custKey, id)
  activity: timeseries<double>(id)
}
entity type Supplier extends Party schema name "supplier" {
  id: long schema name "s_suppkey"
  name: string schema name "s_name"
  nationKey: int schema name "s_nationkey"
  acctbal: double schema name "s_acctbal"
  lines: [Line](suppKey, id)
}
entity type Part schema name "part" {
  id: long schema name "p_partkey"
  name: string schema name "p_name"
  brand: string schema name "p_brand"
  type_: string schema name "p_type"
  size: int schema name "p_size"
  retailPrice: double schema name "p_retailprice"
}
entity type Order schema name "orders" {
  id: long schema name "o_orderkey"
  custKey: long schema name "o_custkey"
  status: string schema name "o_orderstatus"
  totalPrice: double schema name "o_totalprice"
  orderDate: datetime schema name "o_orderdate"
  priority: string schema name "o_orderpriority"
  customer: Customer(custKey)
  lines: [Line](orderKey, id)
}
entity type Line schema name "lineitem" {
  id: long schema name "l_id"
  orderKey: long schema name "l_orderkey"
  partKey: long schema name "l_partkey"
  suppKey: long schema name "l_suppkey"
  lineNumber: int schema name "l_linenumber"
  quantity: double schema name "l_quantity"
  price: double schema name "l_extendedprice"
  discount: double schema name "l_discount"
  tax: double schema name "l_tax"
  returnFlag: string schema name "l_returnflag"
  lineStatus: string schema name "l_linestatus"
  shipDate: datetime schema name "l_shipdate"
  order: Order(orderKey)
  part: Part(partKey)
  supplier: Supplier(suppKey)
}
"""
_MODEL = load(MODEL)
_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
T0 = 1_704_067_200  # 2024-01-01


def open_tables(spark: SparkSession, sf_dir: str) -> Session:
    bindings = {e.name: Binding(f"{sf_dir}/{e.table}.parquet", {"l_id": F.xxhash64(*_LINE)} if e.name == "Line" else None) for e in _MODEL.concrete}
    return connect(spark, _MODEL, bindings=bindings, series={("Customer", "activity"): SeriesBinding(f"{sf_dir}/events.parquet", "user_id", "ts", "value")})


def open_nulls(s: Session) -> Session:
    """Orders of which some have no priority, price or customer, as a bound DataFrame."""
    none = {
        "o_orderpriority": F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")),
        "o_totalprice": F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")),
        "o_custkey": F.when(F.col("o_custkey") % 7 != 3, F.col("o_custkey")),
    }
    return connect(s.spark, _MODEL, bindings={"Order": Binding(s.store.raw(_MODEL["Order"]), none), "Customer": s.store.raw(_MODEL["Customer"])})


_NULLS = "(SELECT * REPLACE (nullif(o_orderpriority, '5-LOW') AS o_orderpriority, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, CASE WHEN o_custkey % 7 <> 3 THEN o_custkey END AS o_custkey) FROM orders)"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a session over the driver's tables under its name, with the SQL of its rows."""

    def register(f: Callable[[Session], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(open_tables(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register



def _rule(name: str, entity: str, filter: str, columns: list[str], where: str) -> None:
    """A query of a filter on a type's own fields; columns come under their logical names."""

    def run(s: Session) -> DataFrame:
        return s[entity].fetch(filter, columns=columns).df

    run.__name__ = name
    e = _MODEL[entity]
    told = ", ".join(f"{e[c].column} AS {c}" if c != "orderDate" else f"CAST(epoch({e[c].column}) AS BIGINT) AS {c}" for c in dict.fromkeys(["id", *columns]))
    query(f"SELECT {told} FROM {e.table} WHERE {where}")(run)


@query("SELECT o_orderkey AS id, o_totalprice AS totalPrice, c_name AS customer_name, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND o_totalprice > 100000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def flagship(s):
    df = s["Order"].fetch('status == "F" and totalPrice > 100000', include=["customer"], order=["-totalPrice", "id"], limit=20).df
    return df.select("id", "totalPrice", F.col("customer.name").alias("customer_name"), F.col("customer.segment").alias("segment"))


# F: filters
_rule("filter_eq", "Order", 'status == "P"', ["status", "totalPrice"], "o_orderstatus = 'P'")
_rule("filter_ne", "Order", 'status != "F"', ["status"], "o_orderstatus <> 'F'")
_rule("filter_range", "Order", "totalPrice >= 50000 and totalPrice < 60000", ["totalPrice"], "o_totalprice >= 50000 AND o_totalprice < 60000")
_rule("filter_datetime", "Order", "orderDate >= 852076800 and orderDate < 883612800", ["orderDate"], "o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'")
_rule("filter_literal_left", "Order", "400000 < totalPrice", ["totalPrice"], "o_totalprice > 400000")
_rule("filter_field_field", "Order", "custKey > id and totalPrice != id", ["custKey"], "o_custkey > o_orderkey AND o_totalprice <> o_orderkey")
_rule("filter_in", "Part", 'size in [1, 7, 50] and brand in ["Brand#11", "Brand#23"]', ["size", "brand"], "p_size IN (1, 7, 50) AND p_brand IN ('Brand#11', 'Brand#23')")
_rule("filter_like", "Part", 'name like "%a_e%"', ["name"], "p_name LIKE '%a_e%'")
_rule("filter_and_or", "Order", 'status == "P" or status == "F" and totalPrice < 5000', ["status", "totalPrice"], "o_orderstatus = 'P' OR o_orderstatus = 'F' AND o_totalprice < 5000")
_rule("filter_not", "Order", 'not (status == "F" or totalPrice < 200000)', ["status", "totalPrice"], "NOT (o_orderstatus = 'F' OR o_totalprice < 200000)")
_rule("filter_paren", "Order", '(status == "P" or status == "F") and totalPrice < 5000', ["status", "totalPrice"], "(o_orderstatus = 'P' OR o_orderstatus = 'F') AND o_totalprice < 5000")
_rule("project_columns", "Customer", "acctbal < 0", ["acctbal", "segment"], "c_acctbal < 0")


def _null_rule(name: str, filter: str, where: str) -> None:
    """A filter over orders with nulls."""

    def run(s: Session) -> DataFrame:
        return open_nulls(s)["Order"].fetch(filter, columns=["priority", "totalPrice"]).df

    run.__name__ = name
    query(f"SELECT o_orderkey AS id, o_orderpriority AS priority, o_totalprice AS totalPrice FROM {_NULLS} o WHERE {where}")(run)


_null_rule("filter_null", "priority != null", "o_orderpriority IS NOT NULL")
_null_rule("filter_is_null", "null == priority", "o_orderpriority IS NULL")
_null_rule("filter_ne_nulls", 'priority != "1-URGENT"', "o_orderpriority <> '1-URGENT'")
_null_rule("filter_not_nulls", 'not (priority == "1-URGENT" or totalPrice < 200000)', "NOT (o_orderpriority = '1-URGENT' OR o_totalprice < 200000)")
_null_rule("filter_or_nulls", 'priority in ["2-HIGH"] or totalPrice == null', "o_orderpriority IN ('2-HIGH') OR o_totalprice IS NULL")
_null_rule("filter_like_nulls", 'not (priority like "%-N%")', "NOT (o_orderpriority LIKE '%-N%')")


@query("SELECT 0 AS n")
def filter_in_empty(s):
    return s["Order"].evaluate(metrics={"n": "count()"}, filter="status in []").df.select(F.col("n").cast("int").alias("n"))


@query("SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nationKey, s_acctbal AS acctbal FROM supplier")
def rename_physical(s):
    return s["Supplier"].fetch().df


# J: includes and residual conditions
@query("SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def include_nested_reference(s):
    return s["Customer"].fetch(include=["nation.region"], columns=[]).df.select("id", F.col("nation.name").alias("nation"), F.col("nation.region.name").alias("region"))


@query("SELECT o_orderkey AS id, c_name AS customer FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def include_reference(s):
    return s["Order"].fetch(include=["customer"], columns=["customer.name"]).df.select("id", F.col("customer.name").alias("customer"))


@query("SELECT c_custkey AS id, count(o_orderkey) AS n_orders, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def include_collection_count(s):
    df = s["Customer"].fetch(include=["orders"], columns=["orders.id"]).df
    return df.select("id", F.size("orders").cast("bigint").alias("n_orders"), F.get("orders", 0)["id"].alias("first_order"))


@query("SELECT c_custkey AS id, count(DISTINCT o_orderkey) AS n_orders, count(l_orderkey) AS n_lines FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1")
def include_nested(s):
    df = s["Customer"].fetch('segment == "BUILDING"', include=["orders.lines"], columns=["orders.id", "orders.lines.id"]).df
    lines = F.aggregate("orders", F.lit(0).cast("bigint"), lambda n, o: n + F.size(o["lines"]))
    return df.select("id", F.size("orders").cast("bigint").alias("n_orders"), lines.alias("n_lines"))


@query("""SELECT n_nationkey AS id, p.kind, p.key, p.name FROM nation JOIN (SELECT 'Customer' AS kind, c_custkey AS key, c_name AS name, c_nationkey AS n FROM customer
UNION ALL SELECT 'Supplier', s_suppkey, s_name, s_nationkey FROM supplier) p ON p.n = n_nationkey""")
def include_polymorphic(s):
    # a key that both types have is two children
    df = s["Nation"].fetch(include=["parties"], columns=["parties.name"]).df.select("id", F.explode("parties").alias("p"))
    return df.select("id", F.col("p._type").alias("kind"), F.col("p.id").alias("key"), F.col("p.name").alias("name"))


@query("""SELECT o_orderkey AS id, p.kind, p.name FROM orders LEFT JOIN (SELECT 'Customer' AS kind, c_custkey AS key, c_name AS name FROM customer ANTI JOIN supplier ON c_custkey = s_suppkey
UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier) p ON p.key = o_custkey""")
def include_polymorphic_reference(s):
    # a reference has one row: of a key that both types have, that of the last type by name
    text = MODEL.replace("customer: Customer(custKey)", "party: Party(custKey)")
    own = connect(s.spark, text, bindings={e.name: s.store.bindings[e.name] for e in _MODEL.concrete})
    return own["Order"].fetch(include=["party"], columns=["party.name"]).df.select("id", F.col("party._type").alias("kind"), F.col("party.name").alias("name"))


@query(f"SELECT o_orderkey AS id, c_mktsegment AS segment FROM {_NULLS} o LEFT JOIN customer ON o_custkey = c_custkey")
def include_reference_nulls(s):
    return open_nulls(s)["Order"].fetch(include=["customer"], columns=["customer.segment"]).df.select("id", F.col("customer.segment").alias("segment"))


@query(f"SELECT o_orderkey AS id FROM {_NULLS} o LEFT JOIN customer ON o_custkey = c_custkey WHERE coalesce(c_mktsegment <> 'BUILDING', true)")
def residual_two_valued(s):
    # behind a reference null differs from every value
    return open_nulls(s)["Order"].fetch('customer.segment != "BUILDING"', columns=[]).df


_WINDOW = (T0 + 5 * 86400, T0 + 10 * 86400)
_IN_WINDOW = "epoch(ts) >= 1704499200 AND floor(epoch(ts)) <= 1704931200"


@query(f"SELECT c_custkey AS id, count(event_id) AS n, round(coalesce(sum(value), 0), 6) AS total, CAST(min(floor(epoch(ts))) AS BIGINT) AS first_ts FROM customer LEFT JOIN events ON user_id = c_custkey AND {_IN_WINDOW} GROUP BY 1")
def include_series_window(s):
    df = s["Customer"].fetch(include=["activity"], window=_WINDOW, columns=[]).df
    total = F.round(F.aggregate("activity", F.lit(0.0), lambda t, p: t + p["value"]), 6)
    return df.select("id", F.size("activity").cast("bigint").alias("n"), total.alias("total"), F.get("activity", 0)["ts"].alias("first_ts"))


@query("SELECT o_orderkey AS id FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def residual_path(s):
    return s["Order"].fetch('customer.segment == "BUILDING"', columns=[]).df


@query("SELECT o_orderkey AS id, o_totalprice AS totalPrice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND n_name <> 'FRANCE' AND c_acctbal > 5000")
def residual_mixed_split(s):
    return s["Order"].fetch('status == "F" and customer.nation.name != "FRANCE" and customer.acctbal > 5000', columns=["totalPrice"]).df


@query("SELECT o_orderkey AS id FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 450000 OR c_mktsegment = 'MACHINERY'")
def residual_or(s):
    return s["Order"].fetch('totalPrice > 450000 or customer.segment == "MACHINERY"', columns=[]).df


# O: order, limit, single rows
@query("SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS totalPrice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey LIMIT 50")
def order_multi(s):
    return s["Order"].fetch(order=["status", "-totalPrice", "id"], limit=50, columns=["status", "totalPrice"]).df


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 100")
def limit_offset(s):
    return s["Order"].fetch(order="id", limit=30, offset=100, columns=[]).df


@query("SELECT p_partkey AS id, p_retailprice AS retailPrice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk(s):
    return s["Part"].fetch(order=["-retailPrice", "id"], limit=25, columns=["retailPrice"]).df


@query("SELECT o_orderkey AS id, o_totalprice AS totalPrice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'AUTOMOBILE' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def limit_after_residual(s):
    return s["Order"].fetch('customer.segment == "AUTOMOBILE"', order=["-totalPrice", "id"], limit=10, offset=5, columns=["totalPrice"]).df


@query(f"SELECT o_orderkey AS id, o_totalprice AS totalPrice FROM {_NULLS} o ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey LIMIT 60")
def order_nulls_first(s):
    return open_nulls(s)["Order"].fetch(order=["totalPrice", "id"], limit=60, columns=["totalPrice"]).df


@query(f"SELECT o_orderkey AS id, o_orderpriority AS priority FROM {_NULLS} o ORDER BY o_orderpriority DESC NULLS LAST, o_orderkey DESC LIMIT 50 OFFSET 10")
def order_nulls_last(s):
    return open_nulls(s)["Order"].fetch(order=[("priority", "desc"), "-id"], limit=50, offset=10, columns=["priority"]).df


def _rows(s: Session, rows: list[dict | None], schema: str) -> DataFrame:
    """Rows that came to the driver."""
    names = [c.split()[0] for c in schema.split(", ")]
    return s.spark.createDataFrame([tuple(r[n] for n in names) for r in rows if r], schema)


@query("SELECT o_orderkey AS id, o_custkey AS custKey, o_orderstatus AS status FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'P')")
def fetch_one(s):
    return _rows(s, [s["Order"].fetch_one('status == "P"', order="id"), s["Order"].fetch_one("totalPrice < 0")], "id long, custKey long, status string")


@query("SELECT c_custkey AS id, c_name AS name, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 7")
def get_by_id(s):
    found = [s["Customer"].get(k, include=["nation"]) for k in (7, -1)]
    return _rows(s, [r and {**r, "nation": r["nation"]["name"]} for r in found], "id long, name string, nation string")


# A: aggregates
@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def count_filtered(s):
    return _rows(s, [{"n": s["Order"].count('status == "F" and totalPrice > 100000')}], "n long")


@query(f"SELECT o_orderpriority AS priority, count(*) AS n, sum(CAST(o_custkey AS BIGINT))::BIGINT AS keys, max(o_totalprice) AS hi, count(DISTINCT o_custkey) AS customers FROM {_NULLS} o GROUP BY 1")
def agg_nulls(s):
    return open_nulls(s)["Order"].evaluate(["priority"], {"n": "count()", "keys": "sum(custKey)", "hi": "max(totalPrice)", "customers": "countDistinct(custKey)"}).df


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def agg_count(s):
    return s["Order"].evaluate(["status"], {"n": "count()"}).df


@query("SELECT l_returnflag AS returnFlag, l_linestatus AS lineStatus, sum(l_quantity) AS qty, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM lineitem GROUP BY 1, 2")
def agg_sum(s):
    return s["Line"].evaluate(["returnFlag", "lineStatus"], {"qty": "sum(quantity)", "numbers": "sum(lineNumber)"}).df


@query("SELECT l_returnflag AS returnFlag, sum(l_quantity) / count(l_quantity) AS qty FROM lineitem GROUP BY 1")
def agg_avg(s):
    return s["Line"].evaluate(["returnFlag"], {"qty": "avg(quantity)"}).df


@query("SELECT c_mktsegment AS segment, min(c_acctbal) AS lo, max(c_acctbal) AS hi, min(c_name) AS first FROM customer GROUP BY 1")
def agg_min_max(s):
    return s["Customer"].evaluate(["segment"], {"lo": "min(acctbal)", "hi": "max(acctbal)", "first": "min(name)"}).df


@query("SELECT o_orderpriority AS priority, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def agg_count_distinct(s):
    return s["Order"].evaluate(["priority"], {"customers": "countDistinct(custKey)"}).df


@query("SELECT count(*) AS n, max(o_totalprice) AS hi, CAST(epoch(min(o_orderdate)) AS BIGINT) AS first FROM orders")
def agg_global(s):
    return s["Order"].evaluate(metrics={"n": "count()", "hi": "max(totalPrice)", "first": "min(orderDate)"}).df


@query("SELECT o_custkey AS custKey, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def agg_filtered(s):
    return s["Order"].evaluate(["custKey"], {"n": "count()"}, filter='status in ["F", "P"]').df


@query("SELECT l_suppkey AS suppKey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agg_order_limit(s):
    return s["Line"].evaluate(["suppKey"], {"qty": "sum(quantity)", "n": "count()"}, order=["-qty", "suppKey"], limit=10).df


# T and S: series
@query(f"SELECT CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events WHERE user_id = 3 AND {_IN_WINDOW}")
def series_range(s):
    return s["Customer"].series("activity", 3, *_WINDOW)


@query("SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events WHERE floor(epoch(ts)) <= 1704153600")
def series_range_open_start(s):
    return s["Customer"].series("activity", end=T0 + 86400)


def _as_points(s: Session) -> DataFrame:
    e = s.model["Customer"]
    points = s.series.points(e, e["activity"])
    return points.select(F.lit(e.name).alias("type"), F.lit("activity").alias("field"), F.col("key").cast("string").alias("key"), "ts", "value", "seq")


@query("SELECT count(*) AS n, count(DISTINCT user_id) AS keys, CAST(min(floor(epoch(ts))) AS BIGINT) AS lo, CAST(max(floor(epoch(ts))) AS BIGINT) AS hi FROM events")
def segment_index(s):
    return encode_segments(_as_points(s), SEGMENT_POINTS).agg(F.sum("n").alias("n"), F.count_distinct("key").alias("keys"), F.min("min_ts").alias("lo"), F.max("max_ts").alias("hi"))


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events")
def codec_roundtrip(s):
    segments = encode_segments(_as_points(s), SEGMENT_POINTS).select("key", "first_seq", "blob")
    return segments.mapInArrow(_decoded, "key string, ts bigint, value double, seq bigint").select("key", "ts", "value")


def _appended(s: Session) -> Session:
    """The events as a series of one's own, appended in two batches; the first one is sealed."""
    own = connect(s.spark, "entity type Meter { id: long, power: timeseries<double>(id) }", segment_points=64)
    events = s["Customer"].series("activity")
    half = T0 + 15 * 86400
    for part in (events.where(F.col("ts") < half), events.where(F.col("ts") >= half)):
        own["Meter"].append_series("power", rows=part.repartition("key").sortWithinPartitions("key", "ts"))
        if not own.series.segments().take(1):
            own.flush()
    return own


@query("SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events")
def series_append(s):
    return _appended(s)["Meter"].series("power")


@query(f"SELECT user_id AS key, CAST(floor(epoch(ts)) AS BIGINT) AS ts, value FROM events WHERE {_IN_WINDOW}")
def series_sealed_window(s):
    # segments are found by their least and greatest time before any is decoded
    return _appended(s)["Meter"].series("power", start=_WINDOW[0], end=_WINDOW[1])


@query(f"""WITH p AS (SELECT user_id, floor(epoch(ts)) AS ts, (row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1) // 64 AS k FROM events WHERE floor(epoch(ts)) < {T0 + 15 * 86400}),
g AS (SELECT user_id, k, min(ts) AS lo, max(ts) AS hi FROM p GROUP BY 1, 2) SELECT user_id AS key, CAST(lo AS BIGINT) AS min_ts, CAST(hi AS BIGINT) AS max_ts FROM g WHERE hi >= {_WINDOW[0]} AND lo <= {_WINDOW[1]}""")
def segments_scanned(s):
    own = _appended(s)
    e = own.model["Meter"]
    return own.series.overlapping(e, e["power"], *_WINDOW).select(F.col("key").cast("bigint").alias("key"), "min_ts", "max_ts")


@query("SELECT count(DISTINCT user_id) AS series, count(*) AS points, 16 * count(*) AS raw_bytes FROM events")
def series_stats(s):
    told = _appended(s).stats()["series"]
    return s.spark.createDataFrame([(told["series"], told["points"], told["raw_bytes"])], "series bigint, points bigint, raw_bytes bigint")


# S: writes through the session's verbs, as the rows that they leave
_CUSTOMER = 'entity type Customer { id: long, name: string, nationKey: int, acctbal: double = 0.5, segment: string }'


def _customers(s: Session, mark: str = "") -> Session:
    """A store of one's own with all customers."""
    own = connect(s.spark, mark + _CUSTOMER)
    own["Customer"].create(s["Customer"].fetch().df)
    return own


_OLD = "SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationKey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer"


@query("SELECT c_custkey AS id, c_name || '*' AS name, NULL::INTEGER AS nationKey, c_acctbal + 1 AS acctbal, NULL::VARCHAR AS segment FROM customer UNION ALL SELECT c_custkey + 100000000, 'new', NULL, 0.5, NULL FROM customer")
def upsert_result(s):
    own = _customers(s)
    old = s["Customer"].fetch().df
    own["Customer"].upsert(old.select("id", F.concat("name", F.lit("*")).alias("name"), (F.col("acctbal") + 1).alias("acctbal")))
    own["Customer"].upsert(old.select((F.col("id") + 100000000).alias("id"), F.lit("new").alias("name")))
    return own["Customer"].fetch().df


@query("SELECT c_custkey AS id, c_name || '*' AS name, c_nationkey AS nationKey, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer UNION ALL SELECT -1, 'more', NULL, 0.5, NULL")
def merge_result(s):
    own = _customers(s)
    own["Customer"].merge(s["Customer"].fetch().df.select("id", F.concat("name", F.lit("*")).alias("name"), F.lit(None).cast("double").alias("acctbal")))
    own["Customer"].merge({"id": -1, "name": "more"})
    return own["Customer"].fetch().df


@query(f"{_OLD} WHERE c_mktsegment <> 'BUILDING' AND c_custkey <> 7")
def remove_result(s):
    own = _customers(s)
    own["Customer"].remove(s["Customer"].fetch('segment == "BUILDING"').df.select("id"))
    own["Customer"].remove([7, -5])
    return own["Customer"].fetch().df


@query(f"{_OLD} UNION ALL SELECT c_custkey + 100000000, c_name, c_nationkey, 0.5, NULL FROM customer")
def create_result(s):
    own = _customers(s)
    own["Customer"].create(s["Customer"].fetch().df.select((F.col("id") + 100000000).alias("id"), "name", "nationKey"))
    return own["Customer"].fetch().df


def _refused(error: type[Exception], f: Callable) -> bool:
    try:
        f()
    except error:
        return True
    return False


@query("SELECT * FROM (VALUES ('abstract type'), ('id is there'), ('id twice'), ('no id'), ('unique key'), ('unknown field'), ('wrong type')) t(refused)")
def write_refusals(s):
    own = _customers(s, '@db(unique="name") ')
    old = own["Customer"].fetch(order="id", limit=1).to_dicts()[0]
    cases = {
        "id is there": (StoreError, lambda: own["Customer"].create({"id": old["id"]})), "id twice": (StoreError, lambda: own["Customer"].create([{"id": -1}, {"id": -1}])), "no id": (StoreError, lambda: own["Customer"].upsert({"name": "x"})),
        "unique key": (StoreError, lambda: own["Customer"].upsert({"id": -1, "name": old["name"]})), "unknown field": (QueryError, lambda: own["Customer"].create({"id": -1, "nope": 1})), "wrong type": (StoreError, lambda: own["Customer"].create({"id": -1, "name": 5})),
        "abstract type": (QueryError, lambda: s["Party"]),
    }
    told = [(k,) for k, (error, f) in cases.items() if _refused(error, f)]
    if own["Customer"].count() != s["Customer"].count():
        raise StoreError("a refused write left rows")
    return s.spark.createDataFrame(told, "refused string")


_BAD = ["nope == 1", "status", "totalPrice == true", "status > null", "customer == 1", "lines.id == 1", "status like 5", "1 == 1"]


@query(f"SELECT unnest({_BAD}) AS filter")
def query_refusals(s):
    return s.spark.createDataFrame([(c,) for c in _BAD if _refused(QueryError, lambda c=c: s["Order"].fetch(c))], "filter string")


@query("SELECT count(*) FILTER (o_orderstatus = 'P') AS root, count(*) FILTER (o_orderstatus = 'P' AND c_mktsegment = 'BUILDING') AS result, 1 AS joined, 2 AS scans, true AS residual, 1 AS requests FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def plan_report(s):
    got = s["Order"].fetch('status == "P" and customer.segment == "BUILDING"', columns=[], observe=True)
    got.count()
    told = got.report.counts()
    return s.spark.createDataFrame([(told["root"], told["result"], len(got.report.joined), got.report.scans, got.report.residual_filter, s.counters["requests"])], "root long, result long, joined int, scans int, residual boolean, requests int")


@query("SELECT 'orders' AS t, unnest(['id', 'custKey']) AS c, 1 AS pushed")
def explain_pushdown(s):
    # conditions on own fields are in the scan
    told = s["Order"].fetch("id > 5 and custKey <= 100", columns=[]).pushed_filters()
    found = [(c, int(any(f"{op}({p}," in x for x in told))) for c, op, p in (("id", "GreaterThan", "o_orderkey"), ("custKey", "LessThanOrEqual", "o_custkey"))]
    return s.spark.createDataFrame([("orders", c, n) for c, n in found], "t string, c string, pushed int")


# M: what the model tells
@query("SELECT 'CREATE TABLE `' || table_name || '` (' || string_agg('`' || column_name || '` ' || CASE data_type WHEN 'VARCHAR' THEN 'STRING' WHEN 'INTEGER' THEN 'INT' ELSE data_type END, ', ' ORDER BY column_index) || ') USING PARQUET' AS statement FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part') GROUP BY table_name")
def model_ddl(s):
    return s.spark.createDataFrame([(e.ddl(),) for e in s.model.concrete if e.table not in ("orders", "lineitem")], "statement string")


@query("SELECT table_name AS t, column_name AS c FROM duckdb_columns() WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders')")
def model_columns(s):
    return s.spark.createDataFrame([(e.table, c) for e in s.model.concrete if e.table != "lineitem" for c in s.store.columns(e)], "t string, c string")


@query("SELECT * FROM (VALUES ('ix_e_y_n', false, 'y,n'), ('ux_e_x', true, 'x')) t(name, is_unique, columns)")
def model_indexes(s):
    own = connect(s.spark, '@db(unique="v", index="w, n") entity type E { id: int, v: int schema name "x", w: int schema name "y", n: int }')
    e = own.model["E"]
    return s.spark.createDataFrame([(n, u, ",".join(c)) for n, (u, c) in e.indexes().items() if n in own.store.index_names(e)], "name string, is_unique boolean, columns string")


@query("SELECT unnest(['Customer', 'Supplier']) AS name")
def model_subtypes(s):
    return s.spark.createDataFrame([(e.name,) for e in s.model.concrete_of("Party")], "name string")


@query("SELECT * FROM (VALUES ('column', false), ('default', true), ('index', false), ('order', true), ('relation', true), ('same', true)) t(change, same)")
def model_fingerprint(s):
    one = 'entity type A { id: int, x: int = 1 } entity type B { id: int }'
    others = {
        "same": one, "order": 'entity type B { id: int } entity type A { x: int = 1, id: int }', "default": one.replace("= 1", "= 2"), "relation": one.replace("B { id: int", "B { id: int, many: [A](x, id)"),
        "index": '@db(index="x") ' + one, "column": one.replace("x: int", "x: long"),
    }
    return s.spark.createDataFrame([(k, load(one).fingerprint() == load(t).fingerprint()) for k, t in others.items()], "change string, same boolean")


# G: changes of model over rows written here
def _evolved(s: Session, before: str, after: str, allow: bool = False) -> DataFrame:
    own = connect(s.spark, f"entity type Part {{ {before} }}")
    own["Part"].create(s["Part"].fetch(columns=["size", "retailPrice"]).df)
    own.evolve(f"entity type Part {{ {after} }}", allow)
    return own["Part"].fetch().df


@query("SELECT p_partkey AS id, p_size AS size, p_retailprice AS retailPrice, 0.5::DOUBLE AS weight FROM part")
def migrate_add_column(s):
    return _evolved(s, "id: long, size: int, retailPrice: double", "id: long, size: int, retailPrice: double, weight: double = 0.5")


@query("SELECT p_partkey AS id, p_size::DOUBLE AS size, p_retailprice AS retailPrice FROM part")
def migrate_widen_column(s):
    return _evolved(s, "id: long, size: int, retailPrice: double", "id: long, size: double, retailPrice: double")


@query("SELECT p_partkey AS id, p_size AS size, trunc(p_retailprice)::INTEGER AS retailPrice FROM part")
def migrate_narrow_column(s):
    return _evolved(s, "id: long, size: int, retailPrice: double", "id: long, size: int, retailPrice: int", True)


@query("SELECT p_partkey AS id, p_size AS size FROM part")
def migrate_drop_column(s):
    return _evolved(s, "id: long, size: int, retailPrice: double", "id: long, size: int", True)


@query("SELECT p_partkey AS id, p_size AS size FROM part")
def migrate_rename_table(s):
    own = connect(s.spark, "entity type Part { id: long, size: int }")
    own["Part"].create(s["Part"].fetch(columns=["size"]).df)
    own.evolve('entity type Part schema name "ITEMS" { id: long, size: int }', True)
    return connect(s.spark, own.model, own.store.root)["Part"].fetch().df


@query("SELECT 0::BIGINT AS parts, 0::BIGINT AS points, true AS refused")
def migrate_drop_type(s):
    # rows and points of a dropped type don't come back with a type of its name
    text = "entity type Part { id: long, size: int, wear: timeseries<double>(id) } "
    own = connect(s.spark, text + "entity type Other { id: long }")
    own["Part"].create(s["Part"].fetch(columns=["size"]).df)
    own["Part"].append_series("wear", 1, [(1, 1.0), (2, 2.0)])
    refused = _refused(EvolutionError, lambda: own.evolve("entity type Other { id: long }"))
    own.evolve("entity type Other { id: long }", True)
    own.evolve(text + "entity type Other { id: long }")
    return s.spark.createDataFrame([(own["Part"].count(), own["Part"].series("wear").count(), refused)], "parts long, points long, refused boolean")


@query("SELECT * FROM (VALUES ('add_column', true), ('add_index', true), ('create_type', true), ('drop_type', false), ('narrow_column', false), ('widen_column', true)) t(kind, safe)")
def migrate_diff(s):
    old = load("entity type A { id: int, x: int, y: double } entity type B { id: int }")
    new = load('@db(index="x") entity type A { id: int, x: long, y: int, z: string } entity type C { id: int }')
    return s.spark.createDataFrame([(c.kind, c.safe) for c in evolve.diff(old, new)], "kind string, safe boolean")
