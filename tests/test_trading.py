"""Orders, lots, options, futures, rebalancing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import money, symbols
from tidemark.operators import futures, ledger, options, orders
from tidemark.plans.blocks import DAY, HOUR, Axis

ORDER = (
    "order_id long, asset string, side string, type string, limit_price double, stop_price double, trail_price double, "
    "trail_percent double, submitted_ts timestamp, deadline_ts timestamp, immediate boolean"
)
T0 = dt.datetime(2024, 1, 1)
BAR = "asset string, ts timestamp, open double, high double, low double, close double"


def order(i, side="buy", kind="market", limit=None, stop=None, trail=None, pct=None, at=T0, until=None, now=False):
    return (i, "A", side, kind, limit, stop, trail, pct, at, until, now)


def one_bar(spark):
    return spark.createDataFrame([("A", T0, 100.0, 110.0, 90.0, 105.0)], BAR)


@pytest.mark.parametrize(
    "side,kind,price,want",
    [
        ("buy", "limit", 105.0, 100.0), ("sell", "limit", 109.0, 109.0), ("buy", "limit", 85.0, None), ("sell", "limit", 115.0, None),
        ("sell", "limit", 0.0, 100.0), ("buy", "limit", 95.0, 95.0), ("buy", "stop", 95.0, 100.0), ("sell", "stop", 105.0, 100.0),
        ("buy", "stop", 108.0, 108.0), ("sell", "stop", 92.0, 92.0), ("buy", "stop", 115.0, None), ("sell", "stop", 85.0, None),
    ],
)
def test_limit_and_stop_table(spark, side, kind, price, want):
    rows = spark.createDataFrame([order(1, side, kind, **{kind: price})], ORDER)
    assert orders.match_orders(rows, one_bar(spark)).collect()[0].fill_price == want


def simulate(o, bars):
    """Bar by bar, the way a backtest loop would."""
    side, kind, limit, stop, trail, pct = o[2], o[3], o[4], o[5], o[6], o[7]
    triggered, mark, seen = False, None, False

    def lim(p, op, hi, lo):
        if (side == "sell" and (p <= 0 or p <= op)) or (side == "buy" and p >= op):
            return op
        return p if lo <= p <= hi else None

    def stp(p, op, hi, lo):
        if p <= 0:
            return None
        if (side == "sell" and p >= op) or (side == "buy" and p <= op):
            return op
        return p if lo <= p <= hi else None

    for _, ts, op, hi, lo, _ in bars:
        if ts < o[8] or (o[9] and ts >= o[9]) or (o[10] and seen):
            continue
        seen = True
        price = None
        if kind == "market":
            price = op
        elif kind == "limit":
            price = lim(limit, op, hi, lo)
        elif kind == "stop":
            price = stp(stop, op, hi, lo)
        elif kind == "stop_limit":
            if triggered:
                price = lim(limit, op, hi, lo)
            else:
                price = stp(stop, op, hi, lo)
                if price is not None:
                    triggered = True
                    price = lim(limit, price, hi, lo)
        elif kind == "trail":
            if mark is not None:
                level = (mark - trail if side == "sell" else mark + trail) if trail else (mark * (1 - pct) if side == "sell" else mark * (1 + pct))
                price = stp(level, op, hi, lo)
            mark = (hi if mark is None else max(mark, hi)) if side == "sell" else (lo if mark is None else min(mark, lo))
        if price is not None:
            return ts, price
    return None, None


@pytest.mark.parametrize("width", [HOUR, 6 * HOUR, DAY, 30 * DAY])
def test_matching_equals_the_loop(spark, width):
    rng = random.Random(3)
    bars, p = [], 100.0
    for i in range(400):
        op = max(5.0, p + rng.uniform(-3, 3))
        close = max(5.0, op + rng.uniform(-4, 4))
        hi, lo = max(op, close) + rng.random() * 2, min(op, close) - rng.random() * 2
        bars.append(("A", T0 + dt.timedelta(minutes=30 * i + (200 if i > 150 else 0)), op, hi, max(lo, 1.0), close))
        p = close
    rows = []
    for i in range(300):
        kind = rng.choice(["market", "limit", "stop", "stop_limit", "trail"])
        at = T0 + dt.timedelta(minutes=rng.randrange(0, 12000))
        px = rng.uniform(60, 140)
        rows.append(
            order(
                i, rng.choice(["buy", "sell"]), kind, limit=px + rng.uniform(-5, 5) if "limit" in kind else None, stop=px if "stop" in kind else None,
                trail=rng.uniform(2, 25) if kind == "trail" and i % 2 else None, pct=0.1 if kind == "trail" and i % 2 == 0 else None, at=at,
                until=at + dt.timedelta(hours=rng.randrange(1, 60)) if rng.random() < 0.4 else None, now=rng.random() < 0.1,
            )
        )
    got = {r.order_id: (r.fill_ts, r.fill_price) for r in orders.match_orders(spark.createDataFrame(rows, ORDER), spark.createDataFrame(bars, BAR), width).collect()}
    for o in rows:
        ts, price = simulate(o, bars)
        assert got[o[0]][0] == ts, o
        assert got[o[0]][1] == (None if price is None else pytest.approx(price)), o


FILLS = Axis(("account", "asset"), "ts", ("fill_id",), width=30 * DAY, max_rows=16)


def test_fifo_equals_a_lot_queue_and_ignores_skew(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        who = "hot" if i % 3 else rng.choice("xy")
        # Half the fills of the hot account share one instant.
        ts = T0 if i % 2 else T0 + dt.timedelta(minutes=i)
        rows.append((who, "F", ts, i, rng.choice(["buy", "sell"]), float(rng.randrange(1, 20)), 100 + rng.random() * 10))
    df = spark.createDataFrame(rows, "account string, asset string, ts timestamp, fill_id long, side string, quantity double, price double")
    got = ledger.realised_pnl(ledger.fifo_lots(df, FILLS)).groupBy("account").agg(F.sum("pnl").alias("p"), F.sum("quantity").alias("q")).collect()
    want = {}
    for who in ("hot", "x", "y"):
        lots, pnl, closed = [], 0.0, 0.0
        for _, _, _, _, side, q, price in sorted((r for r in rows if r[0] == who), key=lambda r: (r[2], r[3])):
            sign = 1 if side == "buy" else -1
            while q > 0 and lots and lots[0][0] * sign < 0:
                take = min(q, abs(lots[0][0]))
                pnl += (price - lots[0][1]) * take * (1 if lots[0][0] > 0 else -1)
                closed += take
                lots[0][0] += sign * take
                q -= take
                if lots[0][0] == 0:
                    lots.pop(0)
            if q > 0:
                lots.append([sign * q, price])
        want[who] = (pnl, closed)
    assert {r.account: (pytest.approx(r.p), pytest.approx(r.q)) for r in got} == want


def test_bracket_first_child_cancels_the_other(spark):
    bars = spark.createDataFrame(
        [("A", T0 + dt.timedelta(hours=i), p, p + 2, p - 2, p) for i, p in enumerate([100.0, 100.0, 108.0, 90.0])], BAR
    )
    base = ORDER + ", parent_id long, oco_group string"
    rows = [
        (*order(1, "buy", "limit", limit=101.0), None, None),
        (*order(2, "sell", "limit", limit=109.0), 1, "g"),
        (*order(3, "sell", "stop", stop=92.0), 1, "g"),
    ]
    out = {r.order_id: r for r in orders.match_brackets(spark.createDataFrame(rows, base), bars).collect()}
    assert out[1].status == "fill" and out[2].status == "fill" and out[2].fill_price == 109.0
    assert out[3].status == "canceled" and out[3].fill_ts is None


def test_day_orders_end_at_the_close(spark):
    rows = [("day", dt.datetime(2024, 1, 2, h), None) for h in (3, 20, 21, 23)] + [("gtc", dt.datetime(2024, 1, 2), None), ("gtd", dt.datetime(2024, 1, 2), dt.datetime(2024, 2, 1))]
    frame = spark.createDataFrame(rows, "tif string, t timestamp, g timestamp")
    got = [r[0] for r in frame.select(orders.deadline(F.col("tif"), F.col("t"), F.col("g"))).collect()]
    # 03:00 UTC is the evening of January 1 in New York, 21:00 UTC its close on January 2
    assert got == [dt.datetime(2024, 1, d, 21) for d in (2, 2, 3, 3)] + [None, dt.datetime(2024, 2, 1)]


@pytest.mark.parametrize("width", [3_600_000_000, 86_400_000_000, 30 * 86_400_000_000])
def test_matching_does_not_depend_on_the_width(spark, width):
    days = [dt.datetime(2024, 1, 1, 15) + dt.timedelta(days=d) for d in range(6)]
    prices = [(100.0, 102.0, 99.0), (100.0, 101.0, 97.0), (0.0, 0.0, 0.0), (95.0, 96.0, 88.0), (90.0, 110.0, 89.0), (None, 9.0, 1.0)]
    bars = spark.createDataFrame([("A", t, o, h, lo, 1.0) for t, (o, h, lo) in zip(days, prices)], BAR)
    late = days[1] + dt.timedelta(hours=1)
    rows = [order(1, "buy", "limit", limit=90.0), order(2, "buy", "market"), order(3, "sell", "limit", limit=0.0), order(4, "sell", "trail", trail=5.0), order(5, "buy", "stop", stop=108.0)]
    frame = spark.createDataFrame(rows, ORDER).withColumn("submitted_ts", F.lit(late)).withColumn("deadline_ts", F.lit(None).cast("timestamp"))
    got = {r.order_id: (r.fill_ts, r.fill_price) for r in orders.match_orders(frame, bars, width).collect()}
    assert got[1] == (days[3], 90.0) and got[2] == (days[3], 95.0) and got[3] == (days[3], 95.0)
    assert got[4] == (days[4], 90.0)
    assert got[5] == (days[4], 108.0)


@pytest.mark.parametrize("model,carry", [("bs", None), ("merton", "carry"), ("gk", "carry")])
def test_implied_volatility_round_trip(spark, model, carry):
    rows = [(100.0, float(k), 3.0, 2.0, float(v), float(d), r) for k in (80, 100, 120) for v in (10, 35, 90) for d in (7, 180) for r in ("CALL", "PUT")]
    df = spark.createDataFrame(rows, "spot double, strike double, rate double, carry double, volatility double, days double, right string")
    g = options.greeks(df, model, carry=carry)
    priced = g.withColumn("price", F.when(F.col("right") == "CALL", F.col("call_price")).otherwise(F.col("put_price"))).filter("price > 0.001")
    out = options.implied_volatility(priced, carry=carry).filter(F.col("implied_volatility") > 0.01)
    bad = out.filter(F.abs(F.col("implied_volatility") - F.col("volatility")) > 1e-3)
    assert out.count() > 20 and bad.filter(F.col("vega") > 0.001).count() == 0


def test_greeks_known_value(spark):
    df = spark.createDataFrame([(100.0, 100.0, 5.0, 20.0, 365.0)], "spot double, strike double, rate double, volatility double, days double")
    r = options.greeks(df).collect()[0]
    assert r.call_price == pytest.approx(10.450583572185565, abs=1e-9)
    assert r.put_price == pytest.approx(5.573526022256971, abs=1e-9)
    assert r.call_delta == pytest.approx(0.6368306511756191, abs=1e-9)


def test_roll_dates(spark):
    rules = futures.roll_rules(spark).filter(F.col("root").isin("ES", "CL", "GC"))
    s = {r.contract: r.end_ts for r in futures.roll_schedule(rules, dt.date(2025, 1, 1), dt.date(2025, 12, 31)).collect()}
    # September 2025: third Friday the 19th, eight business days earlier the 9th, five past midnight New York.
    assert s["ESU25"] == dt.datetime(2025, 9, 9, 4, 5)
    # April 2025 crude: three business days before Tuesday 25 March is the 20th; five more is the 13th.
    assert s["CLJ25"] == dt.datetime(2025, 3, 13, 4, 5)
    # June 2025 gold: third last business day the 26th; seven earlier the 17th.
    assert s["GCM25"] == dt.datetime(2025, 6, 17, 4, 5)


def test_schedule_has_no_holes(spark):
    s = futures.roll_schedule(futures.roll_rules(spark).filter("root = 'MES'"), dt.date(2024, 1, 1), dt.date(2025, 12, 31)).orderBy("start_ts").collect()
    assert all(a.end_ts == b.start_ts for a, b in zip(s, s[1:]))


@pytest.mark.parametrize("text,want", [("MNQU5", ("MNQ", "U", "2025")), ("MNQU9", ("MNQ", "U", "2019")), ("ESZ24", ("ES", "Z", "2024")), ("MNQ.U25", ("MNQ", "U", "2025")), ("ESH2026", ("ES", "H", "2026")), ("MNQ.U5", None), ("SPY", None)])
def test_contract_symbols(spark, text, want):
    r = spark.createDataFrame([(text,)], "s string").select(symbols.parse_contract(F.col("s")).alias("c")).first().c
    assert (None if r is None else (r.root, r.month_code, r.year_4d)) == want


def test_ticks_and_ladder(spark):
    df = spark.createDataFrame([(1.1, 1.2, "buy"), (1.1, 1.2, "sell")], "bid double, ask double, side string")
    rows = df.select(
        money.infer_tick(F.col("bid"), F.col("ask")).alias("tick"), money.round_to_tick(F.lit(1.1501), F.lit(0.01), F.col("side")).alias("r"),
        money.ladder(F.lit(1.0), F.lit(2.0), F.lit(3)).alias("l"), money.ladder(F.lit(1.0), F.lit(2.0), F.lit(1)).alias("one"),
    ).collect()
    assert [r.tick for r in rows] == [0.01, 0.01] and [r.r for r in rows] == [1.16, 1.15]
    assert rows[0].l == [1.0, 1.5, 2.0] and rows[0].one == [2.0]


def test_rebalance_spends_cash_in_drift_order(spark):
    rows = [(1, "A", 10, 10.0, 0.0, False, 50.0), (1, "B", 0, 30.0, 0.6, False, 50.0), (1, "C", 0, 7.0, 0.4, False, 50.0)]
    b = spark.createDataFrame(rows, "account long, asset string, quantity long, price double, weight double, is_quote boolean, cash double")
    b = b.withColumns({"quantity": F.col("quantity").cast("decimal(38,9)"), "price": F.col("price").cast("decimal(12,2)"), "weight": F.col("weight").cast("decimal(38,9)")})
    out = {r.asset: (r.side, r.quantity, r.limit_price) for r in ledger.rebalance_orders(ledger.drift(b), 0.0).collect()}
    assert out == {"A": ("sell", 10.0, 10.0), "B": ("buy", 2.0, 30.0), "C": ("buy", 5.0, 7.0)}


def test_cash_interest_compounds_and_first_day_counts_one(spark):
    rows = [("r", dt.date(2024, 1, 1), 1000.0, 0.1, 0.2), ("r", dt.date(2024, 1, 3), 0.0, 0.1, 0.2)]
    out = ledger.finance_cash(spark.createDataFrame(rows, "run_id string, day date, flow double, credit_rate double, debit_rate double")).orderBy("day").collect()
    assert out[0].interest == 0.0 and out[1].interest == pytest.approx(1000 * ((1 + 0.1 / 365) ** 2 - 1))


def test_settlement_rules(spark):
    rows = [
        ("a", "U", "CALL", 100.0, dt.date(2024, 1, 5), 2.0, 100, 110.0, False, 1e6),
        ("b", "U", "CALL", 100.0, dt.date(2024, 1, 5), 2.0, 100, 110.0, False, 10.0),
        ("c", "U", "PUT", 100.0, dt.date(2024, 1, 5), -1.0, 100, 90.0, False, 0.0),
        ("d", "I", "PUT", 100.0, dt.date(2024, 1, 5), -1.0, 100, 90.0, True, 0.0),
        ("e", "U", "CALL", 100.0, dt.date(2024, 1, 5), 1.0, 100, 90.0, False, 0.0),
        ("f", "U", "PUT", 100.0, dt.date(2024, 1, 5), 1.0, 100, 90.0, False, 0.0),
        ("g", "U", "PUT", 100.0, dt.date(2024, 1, 5), 1.0, 100, 90.0, False, 1e6),
    ]
    rows = [(*r, 100 if r[0] == "f" else None) for r in rows]
    df = spark.createDataFrame(rows, "account string, underlying string, right string, strike double, expiration date, quantity double, multiplier int, spot double, is_index boolean, cash double, shares int")
    got = {(r.account, r.leg): (r.event, r.side, r.cash_change) for r in options.settle_expiring(df).collect()}
    assert got[("a", "underlying")] == ("exercised", "buy", -20000.0)
    assert got[("b", "option")] == ("cash_settled", "sell", 2000.0) and ("b", "underlying") not in got
    assert got[("c", "underlying")] == ("assigned", "buy", -10000.0)
    assert got[("d", "option")] == ("cash_settled", "buy", -1000.0)
    assert got[("e", "option")][0] == "expired"
    assert got[("f", "underlying")] == ("exercised", "sell", 10000.0)
    assert got[("g", "option")] == ("cash_settled", "sell", 1000.0) and ("g", "underlying") not in got


def test_greeks_keep_every_contract(spark):
    now = dt.datetime(2024, 1, 2, 15)
    rows = [("U", now, dt.date(2024, 3, 1), 100.0, "CALL", 5.0), ("U", now, dt.date(2023, 3, 1), 100.0, "CALL", 5.0), ("U", now, dt.date(2024, 3, 1), 100.0, "PUT", None), ("V", now, dt.date(2024, 3, 1), 100.0, "PUT", 5.0)]
    quotes = spark.createDataFrame(rows, "underlying string, ts timestamp, expiration date, strike double, right string, price double")
    spot = spark.createDataFrame([("U", now, 100.0)], "asset string, ts timestamp, close double")
    got = options.greeks_as_of(quotes, spot, 4.0).collect()
    assert len(got) == 4
    assert sorted(r.implied_volatility is not None for r in got) == [False, False, False, True]
    assert all((r.delta is None) == (r.implied_volatility is None) == (r.gamma is None) for r in got)


def test_rebalance_buys_equal_the_loop(spark):
    rng = random.Random(11)
    rows = []
    for account in (1, 2, 3):
        n = 120 if account == 1 else 25
        for i in range(n):
            rows.append((account, f"S{i:03d}", rng.choice([0, 0, 3, 40]), float(rng.randrange(3, 90)), rng.randrange(0, 30) / 1000, False, 150.0))
    kinds = "account long, asset string, quantity long, price double, weight double, is_quote boolean, cash double"
    b = spark.createDataFrame(rows, kinds).withColumns(
        {"quantity": F.col("quantity").cast("decimal(38,9)"), "price": F.col("price").cast("decimal(12,2)"), "weight": F.col("weight").cast("decimal(38,9)")}
    )
    d = ledger.drift(b).cache()
    got = {(r.account, r.asset): r.quantity for r in ledger.rebalance_orders(d, 0.0).collect() if r.side == "buy"}
    sold = {}
    for r in ledger.rebalance_orders(d, 0.0).collect():
        if r.side == "sell":
            sold[r.account] = sold.get(r.account, 0.0) + r.quantity * r.limit_price
    want = {}
    for account in (1, 2, 3):
        left = 150.0 + sold.get(account, 0.0)
        mine = [r for r in d.collect() if r.account == account and r.drift > 0]
        for r in sorted(mine, key=lambda r: (-abs(r.drift), r.asset)):
            limit = float(r.price)
            q = int(min(float(r.target_value - r.current_value), left) / limit + 1e-9)
            if q > 0:
                left -= q * limit
                want[(account, r.asset)] = float(q)
    assert got == want and len(want) > 10


def test_average_prices_through_flips(spark):
    """Adds, partial closes, exact closes and flips, also with one row a block."""
    import random

    from tidemark.operators import ledger
    from tidemark.plans.blocks import HOUR, Axis

    rnd, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(a, t0 + dt.timedelta(hours=k // 2), k, rnd.choice(("buy", "sell")), float(rnd.choice((1, 2, 2.5, 5, 9))), 100 + 10 * rnd.random()) for a in (1, 2) for k in range(120)]
    fills = spark.createDataFrame(rows, "account int, ts timestamp, n long, side string, quantity double, price double")
    want = {}
    for a in (1, 2):
        q, avg = 0.0, None
        for _, _, k, side, size, price in [r for r in rows if r[0] == a]:
            d = size if side == "buy" else -size
            if q * d >= 0:
                avg = (abs(q) * (avg or 0) + abs(d) * price) / abs(q + d)
            elif abs(d) > abs(q):
                avg = price
            q += d
            want[a, k] = (q, avg if q else None)
    for width in (HOUR, 24 * HOUR, 999 * HOUR):
        got = ledger.average_prices(fills, Axis(("account",), "ts", ("n",), width=width, measured=False)).filter("final").collect()
        assert len(got) == len(want)
        for r in got:
            q, avg = want[r.account, r.n]
            assert float(r.position) == q and (r.average_price is None) == (avg is None)
            assert avg is None or abs(r.average_price - avg) < 1e-9


def test_brackets_fill_at_prices_of_zero_where_any_price_counts(spark):
    prices = [(100.0, 101.0, 99.0), (100.0, 100.0, 0.0), (100.0, 101.0, 99.0)]
    bars = spark.createDataFrame([("A", T0 + dt.timedelta(days=i), o, h, lo, o) for i, (o, h, lo) in enumerate(prices)], BAR)
    rows = [(*order(3, "buy", "market"), None, None), (*order(4, "buy", "limit", limit=5.0), 3, "g"), (*order(5, "buy", "stop", stop=150.0), 3, "g")]
    frame = spark.createDataFrame(rows, ORDER + ", parent_id long, oco_group string")
    for any_price, want in ((True, 5.0), (False, None)):
        out = {r.order_id: r for r in orders.match_brackets(frame, bars, any_price=any_price).collect()}
        assert out[3].fill_price == 100.0 and out[4].fill_price == want


@pytest.fixture(scope="module")
def zero_quote(spark):
    return spark.createDataFrame([("A", T0, 0.0, 0.0)], "asset string, ts timestamp, bid double, ask double")


def test_quotes_of_zero_fill_where_any_price_counts(spark, zero_quote):
    rows = [(1, "A", T0, "buy", "market", None, None), (2, "A", T0, "buy", "limit", 5.0, None)]
    frame = spark.createDataFrame(rows, "order_id long, asset string, ts timestamp, side string, type string, limit_price double, stop_price double")
    fill = lambda *how, **more: [r.fill_price for r in orders.quote_fills(frame, zero_quote, 1, *how, **more).orderBy("order_id").collect()]
    assert fill() == [None, None]
    assert fill(any_price=True) == [0.0, 0.0]
    # a mid of 0 has no spread: only what crosses the market fills
    assert fill(0.01, any_price=True) == [None, 0.0]


def test_smart_limits_see_quotes_of_zero_where_any_price_counts(spark, zero_quote):
    frame = spark.createDataFrame([(1, "A", T0, "buy", 0.05, 0.5, 7.0)], "order_id long, asset string, ts timestamp, side string, slippage double, final_pct double, open double")
    got = [orders.smart_limit_fills(frame, zero_quote, 1, any_price=p).collect()[0].fill_price for p in (False, True)]
    assert got == [7.0, 0.0]


def test_snapshot_of_a_trade_at_zero(spark):
    one = lambda p: money.snapshot_price(F.lit(0.0), F.lit(1), F.lit(None).cast("double"), F.lit(1), F.lit(0.5), F.lit(1), 60, any_price=p)
    assert list(spark.range(1).select(one(False), one(True)).collect()[0]) == [0.5, 0.0]
