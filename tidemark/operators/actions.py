"""Splits and dividends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import split_ratio
from tidemark.functions.symbols import side_sign
from tidemark.operators.joins import actions_join, later_ratio
from tidemark.plans.blocks import DAY, Axis, asof, latest_by, scan

OHLC = ("open", "high", "low", "close")


def normalize_dividends(raw: DataFrame, order: Column) -> DataFrame:
    """(asset, event_date, cash_amount): special adjustments (less_amount > 0) dropped, first row per date."""
    plain = raw.filter(F.coalesce(F.col("less_amount"), F.lit(0.0)) <= 0).withColumn("_o", order)
    return latest_by(plain, ["asset", "event_date"], F.col("_o"), newest=False).select("asset", "event_date", "cash_amount")


def normalize_splits(raw: DataFrame) -> DataFrame:
    """(asset, event_date, ratio): rows whose date is the split date, ratio resolved, no-ops dropped."""
    ratio = split_ratio(F.col("numerator"), F.col("denominator"), F.col("ratio_text"))
    real = raw.filter(F.col("split_date") == F.col("event_date"))
    return real.select("asset", "event_date", ratio.alias("ratio")).filter(F.col("ratio") != 1.0)


def back_adjust(bars: DataFrame, splits: DataFrame, strikes: bool = False) -> DataFrame:
    """Prices divided, volume multiplied and dividends divided by the ratios of all later splits; the day's own
    ratio is kept in ``stock_splits``. Rows flagged ``split_adjusted`` pass unchanged, so a second run does
    nothing. ``strikes`` also divides the option strike."""
    done = F.coalesce(F.col("split_adjusted"), F.lit(False)) if "split_adjusted" in bars.columns else F.lit(False)
    flagged = bars.withColumn("_done", done).withColumn("day", F.to_date("ts"))
    rated = later_ratio(flagged, splits)
    on_day = splits.groupBy("asset", "event_date").agg(F.product("ratio").alias("_own"))
    rated = actions_join(rated, on_day, ["_own"])
    f = F.when(F.col("_done"), 1.0).otherwise(F.col("later_ratio"))
    cols = {c: F.col(c) / f for c in (*OHLC, "dividend") if c in bars.columns}
    if "volume" in bars.columns:
        cols["volume"] = F.col("volume") * f
    if strikes:
        cols["strike"] = F.col("strike") / f
    cols["stock_splits"] = F.col("_own")
    cols["split_adjusted"] = F.lit(True)
    return rated.withColumns(cols).drop("_done", "day", "later_ratio", "_own")


def normalize_strikes(chain: DataFrame, by: tuple[str, ...] = ("underlying", "expiration", "right")) -> DataFrame:
    """Per chain the distinct strikes, each taken raw or split-adjusted, whichever lies nearer the reference
    price in log terms."""
    raw, adj = F.col("strike"), F.col("strike") / F.col("ratio")
    gap = lambda s: F.abs(F.log(s / F.col("reference")))
    pick = F.when(gap(adj) < gap(raw), adj).otherwise(raw)
    return chain.groupBy(*by).agg(F.array_sort(F.collect_set(F.round(pick, 4))).alias("strikes"))


def dividend_cash(fills: DataFrame, dividends: DataFrame, ax: Axis) -> DataFrame:
    """Cash per account and ex-date: the position held before the day times the amount per share; one payment
    per (account, asset, date), options left out beforehand. Fills: account, asset, ts, side, quantity."""
    # Only the position after the last fill of a stamp counts, so fills are summed by stamp before they are exchanged.
    flow = side_sign(F.col("side")) * F.col("quantity")
    net = fills.groupBy("account", "asset", "ts").agg(F.sum(flow).alias("_q"))
    eod = scan(net, Axis(ax.keys, "ts", (), ax.width, ax.max_rows, ax.measured), {"held": ("sum", F.col("_q"))})
    pays = dividends.groupBy("asset", "event_date").agg(F.max("cash_amount").alias("cash_amount"))
    # Accounts that ever traded the asset, times its dividends: the rows the answer is made of.
    due = fills.select("account", "asset").distinct().join(pays, "asset")
    due = due.withColumn("_at", F.col("event_date").cast("timestamp"))
    hit = asof(due, eod.select("account", "asset", F.col("ts").alias("_fts"), "held"), ["account", "asset"], "_at", "_fts",
               strict=True, width=365 * DAY)
    paid = hit.filter(F.col("held") != 0)
    return paid.select("account", "asset", "event_date", "held", (F.col("held") * F.col("cash_amount")).alias("amount"))
