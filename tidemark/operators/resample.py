"""OHLCV aggregation: trades to bars, bars to coarser bars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import MARKET_ZONE, local_date, step_seconds
from tidemark.plans.blocks import SECOND

OHLC = ("open", "high", "low", "close")


def bucket(ts: Column, step: str, offset_us: int = 0) -> Column:
    """Start of the left-closed bucket that holds ts; buckets are counted from 1970-01-01 UTC + offset."""
    width = step_seconds(step) * SECOND
    pos = F.unix_micros(ts)
    return F.timestamp_micros(pos - F.pmod(pos - offset_us, F.lit(width)))


def bars_from_trades(
    trades: DataFrame,
    step: str,
    keys: Sequence[str] = ("asset",),
    seq: Sequence[str] = ("seq",),
    offset_us: int = 0,
) -> DataFrame:
    """Trades (price, size) to bars. Everything is a partial aggregate, so a hot asset or bucket is combined
    before the exchange; (ts, *seq) must order the trades of an asset."""
    rank = F.struct("ts", *seq)
    return (
        trades.withColumn("_b", bucket(F.col("ts"), step, offset_us))
        .groupBy(*keys, F.col("_b").alias("bucket"))
        .agg(
            F.min_by("price", rank).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", rank).alias("close"),
            F.sum("size").alias("volume"),
        )
        .dropna(subset=list(OHLC))
        .withColumnRenamed("bucket", "ts")
    )


def resample(
    bars: DataFrame,
    step: str,
    keys: Sequence[str] = ("asset",),
    seq: Sequence[str] = (),
    offset_us: int = 0,
    at: Column | None = None,
) -> DataFrame:
    """Bars to coarser bars: first open, highest high, lowest low, last close, summed volume and dividends,
    last of every other column. Buckets with a null price are dropped, empty ones are not made.
    ``at`` overrides the bucket expression (a local day, say)."""
    rank = F.struct("ts", *seq)
    aggs = []
    for c in bars.columns:
        if c in (*keys, "ts", *seq):
            continue
        if c == "open":
            agg = F.min_by(c, rank)
        elif c in ("high", "low"):
            agg = (F.max if c == "high" else F.min)(c)
        elif c in ("volume", "dividend"):
            agg = F.sum(c)
        else:
            agg = F.max_by(c, rank)
        aggs.append(agg.alias(c))
    where = at if at is not None else bucket(F.col("ts"), step, offset_us)
    out = bars.withColumn("_b", where).groupBy(*keys, F.col("_b").alias("bucket")).agg(*aggs)
    return out.dropna(subset=[c for c in OHLC if c in bars.columns]).withColumnRenamed("bucket", "ts")


def tail(df: DataFrame, n: int, keys: Sequence[str] = ("asset",), order: Sequence[str] = ("ts",)) -> DataFrame:
    """The last n rows of every key. Spark limits the group on the map side (window group limit), so at most
    n rows per key and task are exchanged."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def history(
    bars: DataFrame,
    as_of,
    length: int,
    step: str,
    base_step: str,
    keys: Sequence[str] = ("asset",),
    daily: bool = False,
) -> DataFrame:
    """The last ``length`` complete bars known at ``as_of``. Intraday history leaves the current bar out,
    daily history includes it; a bucket counts once its whole width is covered by base bars."""
    known = bars.filter(F.col("ts") <= F.lit(as_of) if daily else F.col("ts") < F.lit(as_of))
    b, q = step_seconds(base_step), step_seconds(step)
    out = resample(known, step, keys)
    if q > b:
        newest = known.groupBy(*keys).agg(F.max("ts").alias("_max"))
        whole = F.unix_micros("ts") <= F.unix_micros("_max") + (b - q) * SECOND
        out = out.join(newest, list(keys)).filter(whole).drop("_max")
    return tail(out, length, keys)


def between(bars: DataFrame, start, end, step: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    return resample(bars.filter(F.col("ts").between(F.lit(start), F.lit(end))), step, keys)


def multi_timeframe(
    trades: DataFrame,
    steps: Sequence[str] = ("5m", "15m", "30m", "1h", "2h", "4h", "1d"),
    keys: Sequence[str] = ("asset",),
    seq: Sequence[str] = ("seq",),
) -> DataFrame:
    """Bars of several widths in one table. The finest ones come from the trades; every coarser width is a
    multiple of it and is built from those few rows, not from the trades again."""
    finest = min(steps, key=step_seconds)
    base = bars_from_trades(trades, finest, keys, seq)
    labels = F.array(*[F.struct(F.lit(s).alias("name"), F.lit(step_seconds(s) * SECOND).alias("us")) for s in steps])
    pos = F.unix_micros("ts")
    spread = base.withColumn("_s", F.explode(labels)).select(
        *base.columns,
        F.col("_s.name").alias("interval"),
        F.timestamp_micros(pos - F.pmod(pos, F.col("_s.us"))).alias("_at"),
    )
    return resample(spread, finest, (*keys, "interval"), at=F.col("_at")).drop("_at")


def daily_local(bars: DataFrame, keys: Sequence[str] = ("asset",), zone: str = MARKET_ZONE) -> DataFrame:
    """Daily bars by local calendar day; volume is null where every part is."""
    return resample(bars, "1d", keys, at=local_date(F.col("ts"), zone)).withColumnRenamed("ts", "day")


def total_volume(bars: DataFrame, start, end, keys: Sequence[str] = ("asset",)) -> DataFrame:
    inside = F.when(F.col("ts").between(F.lit(start), F.lit(end)), F.col("volume"))
    return bars.groupBy(*keys).agg(F.coalesce(F.sum(inside), F.lit(0.0)).alias("total_volume"))


def event_totals(events: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Per event day: summed dividends and multiplied split ratios."""
    return events.groupBy(*keys, "event_date").agg(
        F.sum("cash_amount").alias("dividend"), F.product("ratio").alias("split_ratio")
    )


def sessions_from_data(df: DataFrame, zone: str = MARKET_ZONE) -> DataFrame:
    """First and last stamp of every local day seen in the data."""
    return df.groupBy(local_date(F.col("ts"), zone).alias("session_date")).agg(
        F.min("ts").alias("open_ts"), F.max("ts").alias("close_ts")
    )


def last_of_day(df: DataFrame, value: str, keys: Sequence[str] = ("run_id",), seq: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*keys, F.to_date("ts").alias("day")).agg(F.max_by(value, F.struct("ts", *seq)).alias(value))


def time_axis(df: DataFrame) -> DataFrame:
    """All stamps of all assets, once each."""
    return df.select("ts").distinct()
