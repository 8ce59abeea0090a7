"""Matching orders against historical bars and quotes.

Whether an order fills depends on the first bar that reaches its price. Bars are boxed into one row per
(asset, block), and each asset also has a short list of its blocks with their lows and highs. An order first
looks through the bars of its own block; only if that leaves it open does it search the block list for the
next blocks that can fill it. Orders meet boxes by equi-join, so no order-bar pairs are formed and the
number of orders of an asset does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.money import expected_fill, final_price, infer_tick, mid, round_to_tick
from tidemark.functions.times import local_date, to_utc
from tidemark.operators.joins import asof_within
from tidemark.plans.blocks import DAY, SECOND, settle

DAY_ORDERS = ("day", "good_for_day", "gfd")
DATED_ORDERS = ("gtd", "good_till_date", "good_til_date")
CLOSE_HOUR = 16
IMMEDIATE = ("ioc", "immediate_or_cancel", "fok", "fill_or_kill")


def _usable(open_: Column, high: Column, low: Column, any_price: bool) -> Column:
    """Open, high and low are above 0; with ``any_price`` it is enough that they are there."""
    one = lambda p: p.isNotNull() if any_price else p > 0
    return one(open_) & one(high) & one(low)


def limit_fill(limit: Column, side: Column, open_: Column, high: Column, low: Column, any_price: bool = False) -> Column:
    """Open if the limit is already met there (a sell at or below 0 always is), the limit if the bar spans it."""
    valid = _usable(open_, high, low, any_price)
    at_open = ((side == "sell") & ((limit <= 0) | (limit <= open_))) | ((side == "buy") & (limit >= open_))
    return F.when(valid & at_open, open_).when(valid & (low <= limit) & (limit <= high), limit)


def stop_fill(stop: Column, side: Column, open_: Column, high: Column, low: Column, any_price: bool = False) -> Column:
    """Open if the bar opens beyond the stop, the stop if the bar spans it."""
    valid = _usable(open_, high, low, any_price) & (stop > 0)
    at_open = ((side == "sell") & (stop >= open_)) | ((side == "buy") & (stop <= open_))
    return F.when(valid & at_open, open_).when(valid & (low <= stop) & (stop <= high), stop)


def deadline(tif: Column, submitted: Column, good_till: Column, close: Column | None = None) -> Column:
    """When an order stops working: the close of its session, its date, or never. ``close`` is the close_ts of the
    session that ends after the order came in, from the market's calendar; without it, the next 16:00 local time."""
    day = local_date(submitted)
    at = lambda d: to_utc(F.timestamp_micros(F.unix_date(d).cast("long") * DAY + CLOSE_HOUR * 3600 * SECOND))
    regular = F.when(submitted < at(day), at(day)).otherwise(at(F.date_add(day, 1)))
    return F.when(F.lower(tif).isin(*DAY_ORDERS), regular if close is None else close).when(F.lower(tif).isin(*DATED_ORDERS), good_till)


def valid_bar(b, any_price: bool = False) -> Column:
    """Whether a bar can trade: open, high and low above 0, or merely there."""
    return F.coalesce(_usable(b["open"], b["high"], b["low"], any_price), F.lit(False))


def _block(ts: Column, width: int) -> Column:
    pos = F.unix_micros(ts)
    return pos - F.pmod(pos, F.lit(width))


def _fold(bars: Column, state: Column, o: str = "", any_price: bool = False) -> Column:
    """Run an order over the bars of one box. State: fill ts, fill price, stop already triggered, best price
    since submission (trailing), any bar seen."""
    c = lambda n: F.col(o + n)
    side, kind = c("side"), c("type")

    def step(acc, b):
        live = (
            acc["ts"].isNull()
            & (b["ts"] >= c("submitted_ts"))
            & (c("deadline_ts").isNull() | (b["ts"] < c("deadline_ts")))
            & ~(c("immediate") & acc["seen"])
        )
        lim = limit_fill(c("limit_price"), side, b["open"], b["high"], b["low"], any_price)
        stp = stop_fill(c("stop_price"), side, b["open"], b["high"], b["low"], any_price)
        # On its trigger bar a stop-limit order tests the limit as if the bar opened at the stop fill.
        first = limit_fill(c("limit_price"), side, stp, b["high"], b["low"], any_price)
        away = F.when(side == "sell", acc["mark"] - c("trail_price")).otherwise(acc["mark"] + c("trail_price"))
        rel = F.when(side == "sell", acc["mark"] * (1 - c("trail_percent"))).otherwise(acc["mark"] * (1 + c("trail_percent")))
        trail = stop_fill(F.coalesce(away, rel), side, b["open"], b["high"], b["low"], any_price)
        price = (
            F.when(kind == "market", b["open"] if any_price else F.when(b["open"] > 0, b["open"]))
            .when(kind == "limit", lim)
            .when(kind == "stop", stp)
            .when(kind == "stop_limit", F.when(acc["trig"], lim).otherwise(first))
            .when(kind == "trail", trail)
        )
        hit = live & price.isNotNull()
        mark = F.when(side == "sell", F.greatest(acc["mark"], b["high"])).otherwise(F.least(acc["mark"], b["low"]))
        mark = F.when(valid_bar(b, any_price), mark).otherwise(acc["mark"])
        return F.struct(
            F.when(hit, b["ts"]).otherwise(acc["ts"]).alias("ts"),
            F.when(hit, price).otherwise(acc["price"]).alias("price"),
            (acc["trig"] | (live & stp.isNotNull())).alias("trig"),
            F.when(live, mark).otherwise(acc["mark"]).alias("mark"),
            (acc["seen"] | live).alias("seen"),
        )

    return F.aggregate(bars, state, step)


def _state(trig: Column, mark: Column, seen: Column) -> Column:
    return F.struct(
        F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("double").alias("price"), trig.alias("trig"), mark.alias("mark"), seen.alias("seen")
    )


def _later_blocks(blocks: Column, acc: Column) -> Column:
    """Blocks after the own one that may hold the fill, each with the state to start from.

    A block whose range reaches a limit or stop is certain to fill it, so one block is enough (two for a
    stop-limit order: the trigger and the first limit hit after it). A trailing stop may or may not hit in a
    block, depending on the order of its bars; those blocks are all listed up to the first certain one. Ranges are
    those of the valid bars of a block, null where it has none; an immediate order looks at the next block of any
    bars, a market order at the next one with an open.
    """
    side, kind = F.col("side"), F.col("type")
    lim, stp = F.col("limit_price"), F.col("stop_price")
    ends = F.col("deadline_ts")
    ahead = F.filter(blocks, lambda b: (b["t"] > F.col("_blk")) & (ends.isNull() | (b["t"] < F.unix_micros(ends))))
    lim_hit = lambda b: b["lo"].isNotNull() & F.when(side == "buy", b["lo"] <= lim).otherwise((lim <= 0) | (b["hi"] >= lim))
    stp_hit = lambda b: F.when(side == "buy", b["hi"] >= stp).otherwise(b["lo"] <= stp)
    none = F.lit(None).cast("double")
    no, yes = F.lit(False), F.lit(True)
    pick = lambda b, trig, mark: F.struct(b["t"].alias("t"), trig.alias("trig"), mark.alias("mark"))
    first = lambda cond, trig: F.transform(F.slice(F.filter(ahead, cond), 1, 1), lambda b: pick(b, trig, none))

    triggered = F.get(F.filter(ahead, stp_hit), F.lit(0))["t"]
    after = F.filter(ahead, lambda b: (b["t"] > triggered) & lim_hit(b))
    stop_limit = F.when(acc["trig"], first(lim_hit, yes)).otherwise(
        F.concat(first(stp_hit, no), F.transform(F.slice(after, 1, 1), lambda b: pick(b, yes, none)))
    )

    sell = side == "sell"
    level = lambda m: F.coalesce(
        F.when(sell, m - F.col("trail_price")).otherwise(m + F.col("trail_price")),
        F.when(sell, m * (1 - F.col("trail_percent"))).otherwise(m * (1 + F.col("trail_percent"))),
    )

    def walk(a, b):
        mark = F.when(sell, F.greatest(a["mark"], b["hi"])).otherwise(F.least(a["mark"], b["lo"]))
        may = F.when(sell, b["lo"] <= level(mark)).otherwise(b["hi"] >= level(mark))
        reached = F.when(sell, b["lo"] <= level(a["mark"])).otherwise(b["hi"] >= level(a["mark"]))
        sure = F.coalesce(reached & (level(a["mark"]) > 0), no)
        return F.struct(
            F.when(~a["done"] & may, F.array_append(a["out"], pick(b, no, a["mark"]))).otherwise(a["out"]).alias("out"),
            mark.alias("mark"),
            (a["done"] | sure).alias("done"),
        )

    empty = F.array().cast("array<struct<t:bigint,trig:boolean,mark:double>>")
    start = F.struct(empty.alias("out"), acc["mark"].alias("mark"), no.alias("done"))
    trailing = F.aggregate(ahead, start, walk, lambda a: a["out"])

    always = lambda b: yes
    found = (
        F.when(F.col("immediate"), F.when(acc["seen"], empty).otherwise(first(always, no)))
        .when(kind == "market", first(lambda b: b["opens"], no))
        .when(kind == "limit", first(lim_hit, no))
        .when(kind == "stop", first(stp_hit, no))
        .when(kind == "stop_limit", stop_limit)
        .when(kind == "trail", trailing)
    )
    return F.coalesce(found, empty)


def match_orders(orders: DataFrame, bars: DataFrame, width: int = DAY, any_price: bool = False) -> DataFrame:
    """First fill of every order: adds ``fill_ts`` and ``fill_price`` (null if it never fills).

    Orders: order_id, asset, side (buy, sell), type (market, limit, stop, stop_limit, trail), limit_price,
    stop_price, trail_price, trail_percent, submitted_ts, deadline_ts, immediate (only its first bar counts).
    Valid bars (open, high and low above 0) must satisfy low <= open <= high; others fill nothing but market orders
    at their open. ``any_price``: bars of 0 trade like others. ``width`` is the block and changes the effort only: a
    day of minute bars is 1440 rows.
    """
    boxed = bars.filter(F.col("open").isNotNull()).withColumn("_blk", _block(F.col("ts"), width))
    valid = valid_bar({c: F.col(c) for c in ("open", "high", "low")}, any_price)
    per_block = boxed.groupBy("asset", "_blk").agg(
        F.array_sort(F.collect_list(F.struct("ts", "open", "high", "low"))).alias("_bars"),
        F.min(F.when(valid, F.col("low"))).alias("_lo"),
        F.max(F.when(valid, F.col("high"))).alias("_hi"),
        F.max(F.col("open").isNotNull() if any_price else F.col("open") > 0).alias("_opens"),
    )
    # One entry per block of an asset: its calendar, not its rows.
    ranges = per_block.groupBy("asset").agg(
        F.array_sort(F.collect_list(F.struct(F.col("_blk").alias("t"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), F.col("_opens").alias("opens")))).alias("_ranges")
    )
    rows = orders.withColumn("_blk", _block(F.col("submitted_ts"), width))
    none = F.lit(None).cast("double")
    own = rows.join(per_block.select("asset", "_blk", "_bars"), ["asset", "_blk"], "left")
    fresh = _state(F.lit(False), none, F.lit(False))
    own = own.withColumn("_acc", F.coalesce(_fold(F.col("_bars"), fresh, any_price=any_price), fresh)).drop("_bars")
    own = settle(own)
    filled = own.filter(F.col("_acc")["ts"].isNotNull()).select(*orders.columns, F.struct(F.col("_acc")["ts"].alias("ts"), F.col("_acc")["price"].alias("price")).alias("_f"))
    listed = own.filter(F.col("_acc")["ts"].isNull()).join(ranges, "asset", "left")
    listed = listed.withColumn("_next", _later_blocks(F.col("_ranges"), F.col("_acc"))).drop("_ranges")
    spread = listed.withColumn("_n", F.explode_outer("_next")).withColumn("_nb", F.col("_n")["t"])
    boxes = per_block.select("asset", F.col("_blk").alias("_nb"), "_bars")
    there = spread.join(boxes, ["asset", "_nb"], "left")
    carried = _state(F.col("_n")["trig"], F.col("_n")["mark"], F.lit(False))
    there = there.withColumn("_late", _fold(F.col("_bars"), carried, any_price=any_price))
    late = F.col("_late")
    best = there.select(*orders.columns, F.struct(late["ts"].alias("ts"), late["price"].alias("price")).alias("_f")).unionByName(filled)
    keys = ["order_id"]
    rest = [c for c in orders.columns if c not in keys]
    done = best.groupBy(*keys).agg(F.any_value(F.struct(*rest)).alias("_o"), F.min(F.when(F.col("_f")["ts"].isNotNull(), F.col("_f"))).alias("_f"))
    return done.select(*keys, *[F.col("_o")[c].alias(c) for c in rest], F.col("_f")["ts"].alias("fill_ts"), F.col("_f")["price"].alias("fill_price"))


def match_brackets(orders: DataFrame, bars: DataFrame, width: int = DAY, any_price: bool = False) -> DataFrame:
    """Orders with ``parent_id`` and ``oco_group``: children start working after their parent's fill; within an
    OCO group the first fill wins (lowest order_id on the same bar) and the others are canceled. ``status`` is
    fill, canceled or open."""
    parents = match_orders(orders.filter(F.col("parent_id").isNull()), bars, width, any_price)
    started = parents.filter(F.col("fill_ts").isNotNull()).select(F.col("order_id").alias("parent_id"), F.col("fill_ts").alias("_from"))
    children = orders.filter(F.col("parent_id").isNotNull()).join(started, "parent_id", "left")
    active = children.filter(F.col("_from").isNotNull())
    active = active.withColumn("submitted_ts", F.greatest("submitted_ts", F.timestamp_micros(F.unix_micros("_from") + 1)))
    matched = match_orders(active.select(*orders.columns), bars, width, any_price)
    waiting = children.filter(F.col("_from").isNull()).select(*orders.columns)
    every = parents.unionByName(matched).unionByName(waiting, allowMissingColumns=True)
    first = (
        every.filter(F.col("oco_group").isNotNull() & F.col("fill_ts").isNotNull())
        .groupBy("oco_group")
        .agg(F.min(F.struct("fill_ts", "order_id"))["order_id"].alias("_winner"))
    )
    out = every.join(first, "oco_group", "left")
    lost = F.col("_winner").isNotNull() & (F.col("_winner") != F.col("order_id"))
    status = F.when(lost, "canceled").when(F.col("fill_ts").isNotNull(), "fill").otherwise("open")
    return out.withColumns(
        {"status": status, "fill_ts": F.when(~lost, F.col("fill_ts")), "fill_price": F.when(~lost, F.col("fill_price"))}
    ).drop("_winner")


def quote_fills(orders: DataFrame, quotes: DataFrame, tolerance_us: int, max_spread: float | None = None, any_price: bool = False) -> DataFrame:
    """Fill price of orders at ``ts`` from the latest fresh quote.

    Market crosses the spread. A limit at or beyond the far side takes it, one at or inside the near side rests
    there. A stop triggers on the far side. ``max_spread`` (share of mid) holds back market orders and limits
    filled at their own price. ``any_price``: fills at 0 count.
    """
    hit = asof_within(orders, quotes, tolerance_us)
    buy = F.col("side") == "buy"
    far, near = F.when(buy, F.col("ask")).otherwise(F.col("bid")), F.when(buy, F.col("bid")).otherwise(F.col("ask"))
    beyond = lambda p, q: F.when(buy, p >= q).otherwise(p <= q)
    lim, stp = F.col("limit_price"), F.col("stop_price")
    price = (
        F.when(F.col("type") == "market", far)
        .when((F.col("type") == "limit") & beyond(lim, far), far)
        .when((F.col("type") == "limit") & beyond(lim, near), lim)
        .when((F.col("type") == "stop") & F.when(buy, far >= stp).otherwise(far <= stp), far)
    )
    crossed = (F.col("type") == "stop") | ((F.col("type") == "limit") & beyond(lim, far))
    out = hit.withColumn("_p", price if any_price else F.when(price > 0, price))
    if max_spread is not None:
        m = mid(F.col("bid"), F.col("ask"))
        share = F.when(m != 0, (F.col("ask") - F.col("bid")) / m > max_spread)
        # A mid of 0 has no spread to speak of: as a price it is too wide a market.
        wide = F.coalesce(share, m == 0) if any_price else (m > 0) & share
        out = out.withColumn("_p", F.when(F.coalesce(~(wide & ~crossed), F.lit(True)), F.col("_p")))
    return out.withColumnRenamed("_p", "fill_price")


def smart_limit_price(
    bid: Column, ask: Column, side: Column, slippage: Column, final_pct: Column, open_: Column, tick: Column | None = None, any_price: bool = False
) -> Column:
    """Mid plus slippage, held inside the quote, rounded to the tick (buys up, sells down); nothing if that is
    beyond the final price. Without a quote (sides of 0 are one only with ``any_price``) the bar's open."""
    m = mid(bid, ask)
    raw = expected_fill(m, slippage, side)
    held = F.when(side == "buy", F.least(raw, ask)).otherwise(F.greatest(raw, bid))
    fill = round_to_tick(held, tick if tick is not None else infer_tick(bid, ask), side)
    last = final_price(bid, ask, side, final_pct)
    fine = F.when(side == "buy", fill <= last).otherwise(fill >= last)
    quoted = bid.isNotNull() & ask.isNotNull() if any_price else (bid > 0) & (ask > 0)
    return F.when(quoted, F.when(fine, fill)).otherwise(open_)


def smart_limit_fills(orders: DataFrame, quotes: DataFrame, tolerance_us: int, any_price: bool = False) -> DataFrame:
    """Smart-limit orders (side, slippage, final_pct, open) at ``ts`` against the latest fresh quote."""
    hit = asof_within(orders, quotes, tolerance_us)
    price = smart_limit_price(F.col("bid"), F.col("ask"), F.col("side"), F.col("slippage"), F.col("final_pct"), F.col("open"), any_price=any_price)
    return hit.withColumn("fill_price", price)


def package_fills(legs: DataFrame, quotes: DataFrame, bars: DataFrame, tolerance_us: int) -> DataFrame:
    """Multi-leg orders: each leg fills at its quote side, else at the open of its bar; the parent price is the
    signed sum and exists only if all legs fill. Legs: parent_id, asset, side, ts."""
    quoted = asof_within(legs, quotes, tolerance_us)
    opens = bars.select("asset", F.col("ts").alias("_bts"), F.col("open"))
    from tidemark.plans.blocks import asof

    both = asof(quoted, opens, right_ts="_bts")
    buy = F.col("side") == "buy"
    price = F.coalesce(F.when(buy, F.col("ask")).otherwise(F.col("bid")), F.col("open"))
    filled = both.withColumn("leg_price", price)
    signed = F.when(buy, F.col("leg_price")).otherwise(-F.col("leg_price"))
    return filled.groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("legs"),
        F.bool_and(F.col("leg_price").isNotNull()).alias("filled"),
        F.when(F.bool_and(F.col("leg_price").isNotNull()), F.sum(signed)).alias("price"),
    )


# Order types that take and make liquidity for fees; a trailing stop pays none.
TAKER_TYPES = ("market", "stop")
MAKER_TYPES = ("limit", "stop_limit", "smart_limit")


def trade_costs(fills: DataFrame, fees: DataFrame) -> DataFrame:
    """Cost of every fill: flat + percent of value + per contract, summed over the fees of its side that apply
    to its order type, in decimals. Fees: side, maker, taker, flat, percent, per_contract (a few rows)."""
    taker = F.col("taker") & F.col("type").isin(*TAKER_TYPES)
    maker = F.col("maker") & F.col("type").isin(*MAKER_TYPES)
    dec = lambda c: F.col(c).cast("decimal(18,6)")
    cost = dec("flat") + dec("price") * dec("quantity") * dec("percent") + dec("quantity") * dec("per_contract")
    schedule = fees.groupBy("side").agg(F.collect_list(F.struct("maker", "taker", "flat", "percent", "per_contract")).alias("_fees"))
    # Two rows at most, one per side.
    joined = fills.join(F.broadcast(schedule), "side", "left")
    exploded = joined.withColumn("_fee", F.explode_outer("_fees")).select(*fills.columns, "_fee.*")
    cost = F.when(F.coalesce(taker | maker, F.lit(False)), cost.cast("decimal(38,9)")).otherwise(F.lit(0).cast("decimal(38,9)"))
    rest = [c for c in fills.columns if c != "fill_id"]
    return exploded.groupBy("fill_id").agg(*[F.any_value(c).alias(c) for c in rest], F.sum(cost).alias("trade_cost"))


def average_fill(fills: DataFrame, keys: tuple[str, ...] = ("order_id",)) -> DataFrame:
    return fills.groupBy(*keys).agg(
        F.sum("quantity").alias("filled_quantity"),
        (F.sum(F.col("price") * F.col("quantity")) / F.nullif(F.sum("quantity"), F.lit(0.0))).alias("average_price"),
    )


# Steps and seconds per step of the smart-limit presets, and the hold after the last step.
PRESETS = {"fast": (3, 5), "normal": (4, 10), "patient": (5, 20)}
FINAL_HOLD_SECONDS = 120


def smart_limit_steps(orders: DataFrame) -> DataFrame:
    """Price path of live smart-limit orders: one row per step with its start, and the cancel time. Columns:
    order_id, submitted_ts, preset, side, bid, ask, final_pct."""
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for k, v in PRESETS.items() for x in (k, v[i])]), F.lower("preset"))
    bid, ask = F.col("bid"), F.col("ask")
    m, last = mid(bid, ask), final_price(bid, ask, F.col("side"), F.col("final_pct"))
    from tidemark.functions.money import ladder

    rows = orders.withColumns({"_n": pick(0), "_sec": pick(1)}).withColumn("_ladder", ladder(m, last, F.col("_n")))
    start = F.unix_micros("submitted_ts")
    cancel = F.timestamp_micros(start + (F.col("_sec") * (F.col("_n") - 1) + FINAL_HOLD_SECONDS) * SECOND)
    out = rows.withColumn("cancel_ts", cancel).select(*orders.columns, "cancel_ts", "_sec", F.posexplode("_ladder").alias("step", "_p"))
    at = F.timestamp_micros(F.unix_micros("submitted_ts") + F.col("_sec").cast("long") * F.col("step") * SECOND)
    tick = infer_tick(bid, ask)
    return out.select(*orders.columns, F.col("step").cast("long").alias("step"), at.alias("step_ts"), "cancel_ts", round_to_tick(F.col("_p"), tick, F.col("side")).alias("price"))
