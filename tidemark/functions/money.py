"""Prices, ticks, ladders, ratios and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tick sizes tried in turn; the first is also the default.
TICKS = (0.01, 0.05, 0.1)


def positive(price: Column) -> Column:
    return F.when((price > 0) & ~F.isnan(price), price)


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def infer_tick(bid: Column, ask: Column) -> Column:
    """Smallest listed tick that both sides are multiples of."""
    fits = lambda v, t: F.abs(v / t - F.round(v / t)) <= 1e-6
    out = F.when(bid.isNull() | ask.isNull(), F.lit(None).cast("double"))
    for t in TICKS:
        out = out.when(fits(bid, t) & fits(ask, t), F.lit(t))
    return out.otherwise(F.lit(TICKS[0]))


def round_to_tick(price: Column, tick: Column, side: Column | None = None) -> Column:
    """Up for buys, down for sells, half up otherwise."""
    exact = price.cast("decimal(24,10)") / tick.cast("decimal(12,6)")
    near = F.round(exact, 0)
    if side is not None:
        near = F.when(side == "buy", F.ceil(exact)).when(side == "sell", F.floor(exact)).otherwise(near)
    stepped = (near.cast("decimal(24,0)") * tick.cast("decimal(12,6)")).cast("double")
    return F.when(tick.isNull() | (tick <= 0), price).otherwise(stepped)


def mid(bid: Column, ask: Column) -> Column:
    return (bid + ask) / 2


def final_price(bid: Column, ask: Column, side: Column, pct: Column) -> Column:
    """Share ``pct`` (0..1) of the way from mid to the far side."""
    share = F.least(F.greatest(pct, F.lit(0.0)), F.lit(1.0))
    m = mid(bid, ask)
    return m + (F.when(side == "buy", ask).otherwise(bid) - m) * share


def ladder(start: Column, end: Column, steps: Column) -> Column:
    """Evenly spaced prices from start to end; a single step is the end price."""
    last = steps - 1
    rungs = F.transform(F.sequence(F.lit(0).cast("int"), F.greatest(last, F.lit(0)).cast("int")), lambda i: start + (end - start) / last * i)
    return F.when(steps <= 1, F.array(end)).otherwise(rungs)


def expected_fill(m: Column, slippage: Column, side: Column) -> Column:
    return F.when(side == "buy", m + slippage).otherwise(m - slippage)


def quantize(x: Column, digits: int) -> Column:
    """Half-even on the decimal text of the number."""
    return F.bround(x.cast("decimal(30,12)"), digits).cast("double")


def has_excess_decimals(x: Column, digits: int) -> Column:
    return x.cast("decimal(30,12)") != F.round(x.cast("decimal(30,12)"), digits)


def parse_ratio(text: Column) -> Column:
    """'4:1' or a number; null if neither, or if the right part is 0."""
    parts = F.split(F.trim(text), ":", 2)
    left, right = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    return F.when(F.instr(text, ":") > 0, F.when(right != 0, left / right)).otherwise(F.trim(text).try_cast("double"))


def split_ratio(numerator: Column, denominator: Column, text: Column) -> Column:
    """numerator/denominator when both are usable, else the ratio text, else 1."""
    return F.coalesce(F.when(denominator != 0, numerator / denominator), parse_ratio(text), F.lit(1.0))


def parse_money(text: Column) -> Column:
    """'$1,234.50' -> 1234.5; not a finite number -> null."""
    return finite(F.regexp_replace(F.trim(text), r"[$,\s]", "").try_cast("double"))


def parse_observation(text: Column) -> Column:
    """Macro value; '.' and blanks stand for missing."""
    return F.when(~F.trim(text).isin(".", ""), F.trim(text).try_cast("double"))


def spread_pct(bid: Column, ask: Column) -> Column:
    m = mid(bid, ask)
    return F.when(m > 0, (ask - bid) / m)


def quote_flags(bid: Column, ask: Column, last: Column, max_spread: float) -> Column:
    """Names of the data problems of a quote."""
    flag = lambda cond, name: F.when(cond, F.lit(name))
    return F.array_compact(
        F.array(
            flag(bid.isNull() | (bid <= 0), "bid_missing"),
            flag(ask.isNull() | (ask <= 0), "ask_missing"),
            flag(last.isNull(), "last_missing"),
            flag((bid > 0) & (ask > 0) & (bid > ask), "crossed"),
            flag((bid > 0) & (ask > 0) & (spread_pct(bid, ask) > max_spread), "spread_too_wide"),
        )
    )


def snapshot_price(
    trade: Column, trade_age: Column, bid: Column, bid_age: Column, ask: Column, ask_age: Column, max_age: float, any_price: bool = False
) -> Column:
    """Fresh trade, else mid of fresh quotes, else the fresh side, else the stale trade; only those above 0, unless
    ``any_price``."""
    usable = (lambda p: p) if any_price else positive
    b = F.when(bid_age <= max_age, usable(bid))
    a = F.when(ask_age <= max_age, usable(ask))
    return F.coalesce(F.when(trade_age <= max_age, usable(trade)), mid(b, a), b, a, usable(trade))
