"""Option chains: prices, greeks, implied volatility, selection, spreads, settlement.

Rates, yields and volatility are in percent and time in days of a 365-day year, as option traders quote them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.money import quote_flags, spread_pct
from tidemark.functions.normal import cdf, cdf_array, pdf
from tidemark.plans.blocks import DAY, asof

# Volatility assumed by the model strike search, and bounds of the implied volatility search.
INDEX_SIGMA = 0.25
OTHER_SIGMA = 0.35
IV_HIGH = 500.0
IV_DEEP = 0.001
IV_FLOOR = 0.00001
IV_ROUNDS = 64


def greeks(
    df: DataFrame,
    model: str = "bs",
    spot: str = "spot",
    strike: str = "strike",
    rate: str = "rate",
    vol: str = "volatility",
    days: str = "days",
    carry: str | None = None,
) -> DataFrame:
    """Price and greeks of both rights per row: Black-Scholes ("bs"), Merton with a dividend yield ("merton",
    ``carry`` = yield) or Garman-Kohlhagen ("gk", ``rate`` domestic, ``carry`` foreign).

    Vega is per volatility point except in "gk"; theta is per day, rho per rate point. Without time or
    volatility a row gives intrinsic value and a delta of 0 or 1.
    """
    if model not in ("bs", "merton", "gk"):
        raise ValueError(f"unknown model {model!r}")
    q = F.col(carry) / 100 if carry else F.lit(0.0)
    s, k = F.col(spot), F.col(strike)
    step = df.withColumns({"_r": F.col(rate) / 100, "_q": q, "_v": F.col(vol) / 100, "_t": F.col(days) / 365})
    live = (F.col("_t") > 0) & (F.col("_v") > 0)
    step = step.withColumn("_a", F.when(live, F.col("_v") * F.sqrt("_t")))
    drift = (F.col("_r") - F.col("_q") + F.col("_v") * F.col("_v") / 2) * F.col("_t")
    step = step.withColumn("_d1", (F.log(s / k) + drift) / F.col("_a"))
    step = step.withColumn("_d2", F.col("_d1") - F.col("_a"))
    step = step.withColumns(
        {
            "_n1": cdf(F.col("_d1")),
            "_n2": cdf(F.col("_d2")),
            "_p1": pdf(F.col("_d1")),
            "_b": F.exp(-F.col("_r") * F.col("_t")),
            "_f": F.exp(-F.col("_q") * F.col("_t")),
        }
    )
    n1, n2, b, f, t = F.col("_n1"), F.col("_n2"), F.col("_b"), F.col("_f"), F.col("_t")
    m1, m2 = 1 - n1, 1 - n2
    r, y = F.col("_r"), F.col("_q")
    itm_call, itm_put = F.greatest(s - k, F.lit(0.0)), F.greatest(k - s, F.lit(0.0))
    decay = -s * f * F.col("_p1") * F.col("_v") / (2 * F.sqrt(t))
    vega = s * f * F.col("_p1") * F.sqrt(t)
    out = {
        "call_price": F.when(live, f * s * n1 - b * k * n2).otherwise(itm_call),
        "put_price": F.when(live, b * k * m2 - f * s * m1).otherwise(itm_put),
        "call_delta": F.when(live, f * n1).otherwise(F.when(s > k, 1.0).otherwise(0.0)),
        "put_delta": F.when(live, -f * m1).otherwise(F.when(s < k, -1.0).otherwise(0.0)),
        "call_dual_delta": F.when(live, -b * n2).otherwise(F.when(s > k, -1.0).otherwise(0.0)),
        "put_dual_delta": F.when(live, b * m2).otherwise(F.when(s < k, 1.0).otherwise(0.0)),
        "vega": F.when(live, vega if model == "gk" else vega / 100).otherwise(0.0),
        "call_theta": F.when(live, (decay + y * s * f * n1 - r * k * b * n2) / 365).otherwise(0.0),
        "put_theta": F.when(live, (decay - y * s * f * m1 + r * k * b * m2) / 365).otherwise(0.0),
        "call_rho": F.when(live, k * t * b * n2 / 100).otherwise(0.0),
        "put_rho": F.when(live, -k * t * b * m2 / 100).otherwise(0.0),
        "gamma": F.when(live, F.col("_p1") * f / (s * F.col("_a"))).otherwise(0.0),
        "exercise_probability": F.when(live, n2).otherwise(F.when(s > k, 1.0).otherwise(0.0)),
    }
    if model == "gk":
        out["call_rho_foreign"] = F.when(live, -s * t * f * n1 / 100).otherwise(0.0)
        out["put_rho_foreign"] = F.when(live, s * t * f * m1 / 100).otherwise(0.0)
    return step.select(*df.columns, *[c.alias(n) for n, c in out.items()])


def put_call_parity(
    call: Column, put: Column, spot: Column, strike: Column, rate: Column, days: Column, foreign: Column | None = None
) -> Column:
    """call - put - spot + discounted strike; the currency model discounts the spot as well."""
    t = days / 365
    s = spot if foreign is None else spot / F.pow(1 + foreign / 100, t)
    return call - put - s + strike / F.pow(1 + rate / 100, t)


def implied_volatility(df: DataFrame, price: str = "price", right: str = "right", carry: str | None = None) -> DataFrame:
    """Column ``implied_volatility`` (percent) from columns spot, strike, rate, days, a price and a right.

    Bisection on [0, 500], a fixed number of rounds over a whole Arrow batch. A price above the model at 500
    gives 500, one below intrinsic value 0.001, as a quote that no volatility explains.
    """
    import numpy as np

    @F.pandas_udf("double")
    def solve(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for s, k, r, t, q, p, call in batches:
            s, k, p = s.to_numpy(float), k.to_numpy(float), p.to_numpy(float)
            r, q, t = r.to_numpy(float) / 100, q.to_numpy(float) / 100, t.to_numpy(float) / 365
            call = call.to_numpy(bool)
            b, f, root = np.exp(-r * t), np.exp(-q * t), np.sqrt(t)

            def value(vol, s=s, k=k, r=r, q=q, t=t, b=b, f=f, root=root, call=call):
                a = vol / 100 * root
                d1 = (np.log(s / k) + (r - q + (vol / 100) ** 2 / 2) * t) / a
                n1, n2 = cdf_array(d1), cdf_array(d1 - a)
                return np.where(call, f * s * n1 - b * k * n2, b * k * (1 - n2) - f * s * (1 - n1))

            with np.errstate(all="ignore"):
                lo, hi = np.zeros_like(s), np.full_like(s, IV_HIGH)
                for _ in range(IV_ROUNDS):
                    mid = np.maximum((lo + hi) / 2, IV_FLOOR)
                    over = value(mid) > p
                    hi, lo = np.where(over, mid, hi), np.where(over, lo, mid)
                out = np.maximum((lo + hi) / 2, IV_FLOOR)
                out = np.where(np.where(call, s > k + p, k > s + p), IV_DEEP, out)
                out = np.where(value(np.full_like(s, IV_HIGH)) < p, IV_HIGH, out)
                out = np.where((t > 0) & (p > 0) & np.isfinite(p) & np.isfinite(s), out, np.nan)
            yield pd.Series(out)

    is_call = F.coalesce(F.upper(F.substring(F.col(right), 1, 1)) == "C", F.lit(False))
    q = F.col(carry) if carry else F.lit(0.0)
    iv = solve(
        F.coalesce("spot", F.lit(float("nan"))), F.col("strike"), F.col("rate"), F.col("days"), q,
        F.coalesce(F.col(price), F.lit(float("nan"))), is_call,
    )
    return df.withColumn("_iv", iv).withColumn(
        "implied_volatility", F.when(~F.isnan("_iv"), F.col("_iv"))
    ).drop("_iv")


def days_to_expiry(now: Column, expiration: Column, hour: int = 16, zone: str = times.MARKET_ZONE) -> Column:
    """Days, with fraction, until the local close of the expiration date."""
    close = times.to_utc(F.timestamp_micros(F.unix_micros(expiration.cast("timestamp")) + hour * 3_600_000_000), zone)
    return (F.unix_micros(close) - F.unix_micros(now)) / float(DAY)


def greeks_as_of(quotes: DataFrame, underlying: DataFrame, rate: float) -> DataFrame:
    """Option prices (underlying, ts, expiration, strike, right, price) with implied volatility and the greeks
    of their own right, on the underlying price known at ts. Every row is kept; expired contracts and those without
    a price or an underlying price have nulls."""
    spot = underlying.select(F.col("asset").alias("underlying"), F.col("ts").alias("_uts"), F.col("close").alias("spot"))
    priced = asof(quotes, spot, ["underlying"], "ts", "_uts").drop("_uts")
    ready = priced.withColumns({"rate": F.lit(float(rate)), "days": days_to_expiry(F.col("ts"), F.col("expiration"))})
    full = greeks(implied_volatility(ready), vol="implied_volatility")
    call = F.upper(F.substring("right", 1, 1)) == "C"
    known = F.col("implied_volatility").isNotNull()
    if_known = lambda value, name: F.when(known, value).alias(name)
    own = lambda name: F.when(call, F.col(f"call_{name}")).otherwise(F.col(f"put_{name}"))
    return full.select(
        *quotes.columns, "spot", "days", "implied_volatility", if_known(own("price"), "model_price"),
        *[if_known(own(n), n) for n in ("delta", "theta", "rho")], *[if_known(F.col(n), n) for n in ("vega", "gamma")],
    )


def explode_chain(chains: DataFrame) -> DataFrame:
    """Nested chains (underlying, chain: map right -> map expiration -> strikes) to one row per contract."""
    by_right = chains.select("underlying", F.explode("chain").alias("right", "_e"))
    by_date = by_right.select("underlying", "right", F.explode("_e").alias("_d", "_s"))
    day = F.coalesce(F.try_to_timestamp("_d", F.lit("yyyy-MM-dd")), F.try_to_timestamp("_d", F.lit("yyyyMMdd"))).cast("date")
    return by_date.select("underlying", "right", day.alias("expiration"), F.explode("_s").alias("strike"))


def chain_table(chains: DataFrame, prices: DataFrame, underlying: DataFrame, rate: float, low=None, high=None) -> DataFrame:
    """Every contract of a chain in a strike range with its price (underlying, expiration, strike, right, ts,
    price) and greeks, sorted by strike."""
    rows = explode_chain(chains)
    if low is not None:
        rows = rows.filter(F.col("strike") >= low)
    if high is not None:
        rows = rows.filter(F.col("strike") <= high)
    on = ["underlying", "expiration", "strike", "right"]
    priced = greeks_as_of(rows.join(prices, on), underlying, rate)
    extra = [c for c in priced.columns if c not in on]
    return rows.join(priced.select(*on, *extra), on, "left").orderBy("underlying", "expiration", "right", "strike")


def chain_summary(contracts: DataFrame) -> DataFrame:
    """Per (underlying, right, expiration): lowest and highest strike, and the strike list."""
    return contracts.groupBy("underlying", "right", "expiration").agg(
        F.min("strike").alias("min_strike"),
        F.max("strike").alias("max_strike"),
        F.array_sort(F.collect_set("strike")).alias("strikes"),
    )


def model_delta(spot: Column, strike: Column, days: Column, call: Column, index_like: Column) -> Column:
    """Delta at zero rate and an assumed volatility, at least one day out."""
    t = F.greatest(days / 365, F.lit(1 / 365))
    sigma = F.when(index_like, INDEX_SIGMA).otherwise(OTHER_SIGMA)
    d1 = (F.log(spot / strike) + sigma * sigma / 2 * t) / (sigma * F.sqrt(t))
    return cdf(d1) - F.when(call, 0.0).otherwise(1.0)


def strike_by_delta(contracts: DataFrame, by: Sequence[str] = ("underlying", "expiration", "right")) -> DataFrame:
    """Per chain the strike whose model delta is nearest ``target_delta`` (the lower strike on a tie). Columns:
    spot, strike, days, right, index_like, target_delta."""
    call = F.upper(F.substring("right", 1, 1)) == "C"
    delta = model_delta(F.col("spot"), F.col("strike"), F.col("days"), call, F.col("index_like"))
    rows = contracts.withColumn("_delta", delta)
    rank = F.struct(F.abs(F.col("_delta") - F.col("target_delta")), "strike")
    best = rows.groupBy(*by).agg(F.min_by(F.struct("strike", "_delta"), rank).alias("_b"))
    return best.select(*by, F.col("_b.strike").alias("strike"), F.col("_b._delta").alias("delta"))


def weekend_to_friday(day: Column) -> Column:
    wd = F.weekday(day)
    return F.date_sub(day, F.when(wd >= 5, wd - 4).otherwise(0))


def expiration_on_or_after(requests: DataFrame, contracts: DataFrame, priced: DataFrame, allow_prior: bool = False) -> DataFrame:
    """First expiration on or after each (underlying, date) that has a priced contract; weekend expirations count
    as the Friday before. ``allow_prior`` falls back to the last earlier one."""
    traded = contracts.join(priced, ["underlying", "expiration", "strike", "right"], "left_semi")
    # Expirations of one underlying: at most a few hundred dates.
    dates = traded.groupBy("underlying").agg(F.array_sort(F.collect_set(weekend_to_friday(F.col("expiration")))).alias("_d"))
    out = requests.join(dates, "underlying", "left")
    nxt = F.get(F.filter("_d", lambda d: d >= F.col("date")), F.lit(0))
    prior = F.try_element_at(F.filter("_d", lambda d: d < F.col("date")), F.lit(-1))
    return out.withColumn("expiration", F.coalesce(nxt, prior) if allow_prior else nxt).drop("_d")


def next_monthly_expiration(days: DataFrame, calendar: DataFrame, market: str = "NYSE") -> DataFrame:
    """Third Friday after each ``date``, or the last open session before it if the market is shut that day."""
    d = F.col("date")
    this, following = times.third_friday(d), times.third_friday(F.add_months(F.trunc(d, "month"), 1))
    rows = days.withColumn("_x", F.when(this > d, this).otherwise(following)).withColumn("market", F.lit(market))
    sessions = calendar.select("market", F.col("session_date").alias("_s"), F.col("session_date").alias("expiration"))
    return asof(rows, sessions, ["market"], "_x", "_s", width=3650 * DAY, measured=False).drop("_x", "_s", "market")


def evaluate_market(quotes: DataFrame, max_spread: float) -> DataFrame:
    """Tradeability of quotes (bid, ask, last): spread, too-wide flag, price to buy and to sell at (the last
    price where neither side is quoted) and data problems."""
    live = lambda c: F.when(F.col(c) > 0, F.col(c))
    bid, ask, last = live("bid"), live("ask"), live("last")
    none = bid.isNull() & ask.isNull()
    spread = spread_pct(bid, ask)
    return quotes.withColumns(
        {
            "has_bid_ask": bid.isNotNull() & ask.isNotNull(),
            "spread_pct": spread,
            "spread_too_wide": F.coalesce(spread > max_spread, F.lit(False)),
            "buy_price": F.when(none, last).otherwise(ask),
            "sell_price": F.when(none, last).otherwise(bid),
            "used_last_price": none & last.isNotNull(),
            "flags": quote_flags(F.col("bid"), F.col("ask"), F.col("last"), max_spread),
        }
    )


def _leg(side: str, right: Column | str, strike: str, expiry: str = "expiration", quantity: Column | int = 1) -> Column:
    right = F.lit(right) if isinstance(right, str) else right
    q = F.lit(quantity) if isinstance(quantity, int) else quantity
    return F.struct(
        F.lit(side).alias("side"), right.alias("right"), F.col(strike).cast("double").alias("strike"),
        F.col(expiry).alias("expiration"), q.cast("long").alias("quantity"),
    )


def spread_legs(packages: DataFrame) -> DataFrame:
    """Spread orders to leg rows. Columns: package_id, kind, right, low_strike, mid_strike, high_strike,
    expiration, far_expiration, ratio; which are used depends on the kind."""
    right = F.col("right")
    call = F.upper(right) == "CALL"
    up = F.array(_leg("buy", right, "low_strike"), _leg("sell", right, "high_strike"))
    down = F.array(_leg("buy", right, "high_strike"), _leg("sell", right, "low_strike"))
    legs = (
        F.when(F.col("kind") == "vertical", F.when(call, up).otherwise(down))
        .when(F.col("kind") == "calendar", F.array(_leg("sell", right, "mid_strike"), _leg("buy", right, "mid_strike", "far_expiration")))
        .when(
            F.col("kind") == "butterfly",
            F.array(_leg("buy", right, "low_strike"), _leg("sell", right, "mid_strike", quantity=2), _leg("buy", right, "high_strike")),
        )
        .when(F.col("kind") == "straddle", F.array(_leg("buy", "CALL", "mid_strike"), _leg("buy", "PUT", "mid_strike")))
        .when(F.col("kind") == "strangle", F.array(_leg("buy", "PUT", "low_strike"), _leg("buy", "CALL", "high_strike")))
        .when(F.col("kind") == "diagonal", F.array(_leg("buy", right, "low_strike", "far_expiration"), _leg("sell", right, "high_strike")))
        .when(F.col("kind") == "ratio", F.array(_leg("buy", right, "low_strike"), _leg("sell", right, "high_strike", quantity=F.col("ratio"))))
    )
    return packages.withColumn("_legs", legs).select(
        "package_id", "kind", F.posexplode("_legs").alias("leg", "_l")
    ).select("package_id", "kind", F.col("leg").cast("long").alias("leg"), "_l.*")


def net_price(legs: DataFrame) -> DataFrame:
    """Net price of a package by mid, best (join the queue) and fastest (cross the spread), sells counted
    negative; legs without a quote are skipped, a package without any is null."""
    buy = F.lower("side").startswith("buy")
    quoted = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    signed = lambda b, s: F.sum(F.when(quoted, F.when(buy, b).otherwise(-s)))
    m = (F.col("bid") + F.col("ask")) / 2
    return legs.groupBy("package_id").agg(
        signed(m, m).alias("mid"),
        signed(F.col("bid"), F.col("ask")).alias("best"),
        signed(F.col("ask"), F.col("bid")).alias("fastest"),
    )


def spread_profit(legs: DataFrame, multiplier: int = 100) -> DataFrame:
    """Profit of a package in percent of its initial cost; null if a leg has no price. Columns: package_id,
    price, quantity, initial_cost."""
    value = F.sum(F.col("price") * F.col("quantity") * multiplier)
    agg = legs.groupBy("package_id").agg(
        value.alias("_v"), F.bool_and(F.col("price").isNotNull()).alias("_all"), F.max("initial_cost").alias("_c")
    )
    pct = (F.col("_v") - F.col("_c")) / F.nullif("_c", F.lit(0.0)) * 100
    return agg.select("package_id", F.when(F.col("_all"), pct).alias("profit_pct"))


def portfolio_greeks(positions: DataFrame, contract_greeks: DataFrame, on: Sequence[str]) -> DataFrame:
    names = ("delta", "gamma", "theta", "vega")
    held = positions.join(contract_greeks.select(*on, *names), list(on))
    return held.groupBy("account").agg(*[F.sum(F.col(n) * F.col("quantity")).alias(n) for n in names])


def intrinsic(right: Column, spot: Column, strike: Column) -> Column:
    call = F.upper(F.substring(right, 1, 1)) == "C"
    return F.greatest(F.when(call, spot - strike).otherwise(strike - spot), F.lit(0.0))


def settle_expiring(positions: DataFrame) -> DataFrame:
    """Expiry events and underlying deliveries of option positions.

    Columns: account, underlying, right, strike, expiration, quantity, multiplier, spot, is_index, cash, shares. Out
    of the money expires; an index settles in cash; a long is exercised if the account can carry the delivery (enough
    cash to buy, enough ``shares`` of the underlying to deliver), else settled in cash; a short is assigned. Delivery
    trades at the strike.
    """
    value = intrinsic(F.col("right"), F.col("spot"), F.col("strike"))
    call = F.upper(F.substring("right", 1, 1)) == "C"
    q, units = F.col("quantity"), F.abs(F.col("quantity")) * F.col("multiplier")
    affordable = F.when(call, F.col("cash") >= units * F.col("strike")).otherwise(F.coalesce(F.col("shares") >= units, F.lit(False)))
    event = (
        F.when(value <= 0, "expired")
        .when(F.col("is_index"), "cash_settled")
        .when((q > 0) & ~affordable, "cash_settled")
        .when(q > 0, "exercised")
        .otherwise("assigned")
    )
    base = positions.filter(q != 0).withColumns({"_value": value, "event": event})
    delivers = F.col("event").isin("exercised", "assigned")
    buys = call == (q > 0)
    option = F.struct(
        F.lit("option").alias("leg"), F.when(q > 0, "sell").otherwise("buy").alias("side"), F.abs(q).cast("double").alias("units"),
        F.when(F.col("event") == "expired", 0.0).otherwise(F.col("_value")).alias("price"),
        F.when(F.col("event") == "cash_settled", F.col("_value") * q * F.col("multiplier")).otherwise(0.0).alias("cash_change"),
    )
    stock = F.struct(
        F.lit("underlying").alias("leg"), F.when(buys, "buy").otherwise("sell").alias("side"), units.cast("double").alias("units"),
        F.col("strike").cast("double").alias("price"),
        (F.when(buys, -1.0).otherwise(1.0) * units * F.col("strike")).alias("cash_change"),
    )
    rows = base.withColumn("_legs", F.when(delivers, F.array(option, stock)).otherwise(F.array(option)))
    return rows.select("account", "underlying", "right", "strike", "expiration", "event", F.explode("_legs").alias("_l")).select(
        "account", "underlying", "right", "strike", "expiration", "event", "_l.*"
    )


def early_assignment(positions: DataFrame, today: Column, max_days: int, max_extrinsic: float) -> DataFrame:
    """Short in-the-money options near expiry with almost no time value, index options excepted."""
    dte = F.datediff(F.col("expiration"), today)
    value = intrinsic(F.col("right"), F.col("spot"), F.col("strike"))
    extra = F.greatest(F.col("price") - value, F.lit(0.0))
    return positions.withColumns({"intrinsic": value, "extrinsic": extra}).filter(
        (F.col("quantity") < 0) & (dte > 0) & (dte <= max_days) & (value > 0) & (extra <= max_extrinsic) & ~F.col("is_index")
    )


