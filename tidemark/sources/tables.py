"""Reading and writing series, trades, payloads, SQL views and results tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.joins import upsert
from tidemark.plans.blocks import latest_by, settle

# Columns of the trades export, in order.
TRADE_COLUMNS = (
    "time", "side", "status", "filled_quantity", "symbol", "asset.asset_type", "asset.right", "asset.strike",
    "asset.expiration", "price", "type", "asset.multiplier", "trade_cost", "trade_slippage", "event_kind", "event_id",
    "cash_event_type", "cash_event_amount", "cash_event_currency", "cash_event_description", "cash_event_direction",
    "cash_event_reason", "is_external_cash_flow", "cash_event_raw_type", "cash_event_raw_subtype",
    "cash_event_broker_name", "cash_event_broker_event_id",
)

CSV_BARS = "Date DATE, Open DOUBLE, High DOUBLE, Low DOUBLE, Close DOUBLE, `Adj Close` DOUBLE, Volume DOUBLE, Dividends DOUBLE, `Stock Splits` DOUBLE"


def read_series(spark: SparkSession, path: str, time: str = "ts") -> DataFrame:
    """Stored series: time as a UTC timestamp, rows without one dropped, ``missing`` false by default."""
    raw = spark.read.parquet(path)
    out = raw.withColumn("ts", F.col(time).cast("timestamp")) if time != "ts" or not isinstance(raw.schema["ts"].dataType, T.TimestampType) else raw
    out = out.filter(F.col("ts").isNotNull())
    gap = F.coalesce(F.col("missing"), F.lit(False)) if "missing" in raw.columns else F.lit(False)
    return out.withColumn("missing", gap)


def write_series(df: DataFrame, path: str, partition: Sequence[str] = ("day",), mode: str = "overwrite") -> None:
    """Store a series by day; readers prune the days they do not need."""
    stored = df.withColumn("day", F.to_date("ts")) if "day" in partition and "day" not in df.columns else df
    stored.write.mode(mode).partitionBy(*partition).parquet(path)


def merge_series(spark: SparkSession, path: str, update: DataFrame, target: str | None = None, keys: Sequence[str] = ("asset", "ts")) -> None:
    """Merge newer rows into the stored series. Only the days that the update touches are read and merged; in place
    (without ``target``) only their partitions are replaced, and all other files stay as they are. With a ``target`` the
    whole series is written there, untouched days as copies."""
    stored = spark.read.parquet(path)
    update = update.withColumn("day", F.to_date("ts"))
    touched = update.select("day").distinct()
    merged = upsert(stored.join(touched, "day", "left_semi"), update, list(keys))
    if target is None:
        # Settled first: the files that are read are the ones that get replaced.
        settle(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(path)
    else:
        rest = stored.join(touched, "day", "left_anti")
        write_series(merged.unionByName(rest, allowMissingColumns=True), target)


def write_stats(df: DataFrame, path: str) -> None:
    """zstd parquet with nested columns as JSON text, for readers that know flat tables only."""
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_csv_bars(spark: SparkSession, path: str, asset: str | None = None) -> DataFrame:
    """Daily bars CSV (Date, OHLC, Adj Close, Volume, Dividends, Stock Splits)."""
    raw = spark.read.schema(CSV_BARS).csv(path, header=True)
    name = F.lit(asset) if asset else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv", 1)
    return raw.select(
        name.alias("asset"), F.col("Date").cast("timestamp").alias("ts"), F.col("Open").alias("open"), F.col("High").alias("high"),
        F.col("Low").alias("low"), F.col("Close").alias("close"), F.col("Adj Close").alias("adj_close"), F.col("Volume").alias("volume"),
        F.col("Dividends").alias("dividend"), F.col("Stock Splits").alias("stock_splits"),
    )


def header_payload(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """JSON ``{"header": {"format": [names]}, "response": [[values], ...]}`` to one row per record. ``fields``
    maps the wanted names to types; a name the header lacks is null."""
    kind = "struct<header: struct<format: array<string>>, response: array<array<string>>>"
    rest = [c for c in df.columns if c != column]
    rows = df.withColumn("_j", F.from_json(column, kind)).select(*rest, F.col("_j.header.format").alias("_f"), F.explode("_j.response").alias("_r"))
    place = lambda n: F.array_position(F.col("_f"), n).cast("int")
    return rows.select(*rest, *[F.try_element_at(F.col("_r"), F.nullif(place(n), F.lit(0))).try_cast(t).alias(n) for n, t in fields.items()])


def columnar_payload(df: DataFrame, column: str, fields: Mapping[str, str]) -> DataFrame:
    """JSON ``{"name": [values], ...}`` to one row per position."""
    kind = "struct<" + ", ".join(f"`{n}`: array<{t}>" for n, t in fields.items()) + ">"
    rest = [c for c in df.columns if c != column]
    rows = df.withColumn("_j", F.from_json(column, kind))
    return rows.select(*rest, F.inline(F.arrays_zip(*[F.col(f"_j.{n}").alias(n) for n in fields])))


def trades_export(events: DataFrame) -> DataFrame:
    """Trade and cash events in the fixed export layout; columns they lack are null."""
    return events.select(*[F.col(f"`{c}`") if c in events.columns else F.lit(None).cast("string").alias(c) for c in TRADE_COLUMNS])


def append_rows(*frames: DataFrame) -> DataFrame:
    """Stack user tables (chart lines, markers, custom rows) by name; absent columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def register(frames: Mapping[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """A read-only query over registered views, with its whole result. Only SELECT and WITH are let through."""
    if not text.lstrip().lower().startswith(("select", "with")):
        raise ValueError("only SELECT queries are allowed")
    return spark.sql(text)


def run_sql_head(spark: SparkSession, text: str, limit: int = 200) -> tuple[DataFrame, int, bool]:
    """The first rows of such a query for display, the number of all its rows, and whether rows were left out."""
    rows = run_sql(spark, text)
    total = rows.count()
    return rows.limit(limit), total, total > limit


def visible_rows(df: DataFrame, as_of, last: int, keys: Sequence[str] = ("asset",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """What a reader may see at ``as_of``: the last rows of every asset up to then."""
    from tidemark.operators.resample import tail

    return tail(df.filter(F.col("ts") <= F.lit(as_of)), last, keys, order)


def read_results(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_results(df: DataFrame, url: str, name: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()


def newest_rows(df: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    return latest_by(df, keys, F.col(version))
