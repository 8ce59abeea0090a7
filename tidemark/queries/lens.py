"""Market tables derived from the given tables, as DataFrames and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.resample import bars_from_trades
from tidemark.plans.blocks import DAY, Axis, stored

SHIP_SEQ = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
SHIPMENTS = Axis(("asset",), "ts", SHIP_SEQ, width=180 * DAY)
FILLS = Axis(("account", "asset"), "ts", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "price"), width=365 * DAY)

# Keeps derived prices off decimal rounding ties, where engines differ in the last digit.
ODD = 1.00031415926


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table; its zone-less stamps are read as UTC instants, so time filters reach the scan."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.parquet.inferTimestampNTZ.enabled", "false")
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """events: five heavy assets, one month of trades."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("asset"),
        "ts",
        F.col("value").alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1).alias("size"),
        F.col("event_id").alias("seq"),
    )


TICKS = """ticks AS (SELECT event_type AS asset, ts, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) + 1 AS size, event_id AS seq FROM events)"""


def bars(spark: SparkSession, sf: str, step: str = "1h") -> DataFrame:
    return bars_from_trades(ticks(spark, sf), step)


def bars_sql(step: str = "1 hour", name: str = "bars") -> str:
    return f"""{name} AS (SELECT asset, time_bucket(INTERVAL '{step}', ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (ts, seq)) AS close,
  sum(size) AS volume FROM ticks GROUP BY 1, 2)"""


BARS = f"{TICKS}, {bars_sql()}"
DAYS = f"{TICKS}, {bars_sql('1 day', 'days')}"


def shipments(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as trades of 100s of assets over seven years, stamped by day."""
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("asset"),
        F.col("l_shipdate").alias("ts"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("size"),
        *SHIP_SEQ,
    )


SHIPMENTS_SQL = """shipments AS (SELECT CAST(l_suppkey AS VARCHAR) AS asset, l_shipdate AS ts,
  l_extendedprice / l_quantity AS price, l_quantity AS size,
  l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM lineitem)"""
SHIP_RANK = "(ts, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice)"


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    """Month bars of the shipments."""
    rank = F.struct("ts", *SHIP_SEQ)
    return (
        shipments(spark, sf)
        .groupBy("asset", F.date_trunc("month", "ts").alias("m"))
        .agg(
            F.min_by("price", rank).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", rank).alias("close"),
            F.sum("size").alias("volume"),
        )
        .withColumnRenamed("m", "ts")
    )


MONTHLY = f"""{SHIPMENTS_SQL}, monthly AS (SELECT asset, date_trunc('month', s.ts) AS ts,
  arg_min(price, {SHIP_RANK}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {SHIP_RANK}) AS close,
  sum(size) AS volume FROM shipments s GROUP BY asset, date_trunc('month', s.ts))""".replace("(ts, l_", "(s.ts, l_")


def fills(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as fills: accounts trading five assets, returns sell. The join is stored: operators go over fills
    several times (row counts of blocks, their totals, the rows), and each time would exchange both tables anew."""
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    used = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_returnflag", "l_shipdate")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).select(*used, (F.col("o_custkey") % 100).alias("account"))
    return stored(joined, "fills").select(
        "account",
        (F.col("l_suppkey") % 5).alias("asset"),
        F.col("l_shipdate").alias("ts"),
        F.when((F.col("l_returnflag") == "R") | (F.col("l_linenumber") % 3 == 0), "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity") * ODD).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax") * ODD).alias("fee"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
    )


FILLS_SQL = f"""fills AS (SELECT o_custkey % 100 AS account, l_suppkey % 5 AS asset, l_shipdate AS ts,
  CASE WHEN l_returnflag = 'R' OR l_linenumber % 3 = 0 THEN 'sell' ELSE 'buy' END AS side, l_quantity AS quantity,
  l_extendedprice / l_quantity * {ODD} AS price, l_extendedprice * l_tax * {ODD} AS fee,
  l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
FILL_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, quantity, price"


def cash_totals(spark: SparkSession, sf: str) -> DataFrame:
    """orders as account curves: value, and external money in and out running up."""
    return table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).cast("string").alias("run_id"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + F.col("o_orderkey") * 1_000).alias("ts"),
        F.col("o_totalprice").alias("portfolio_value"),
        F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") / 10).alias("external_flow_total"),
    )


CURVE_SQL = """curve AS (SELECT CAST(o_custkey % 20 AS VARCHAR) AS run_id, o_orderdate + to_microseconds(o_orderkey * 1000) AS ts,
  o_totalprice AS portfolio_value,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 10 END AS external_flow_total FROM orders)"""
