"""Cleaning, resampling, returns, indicators, coverage."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import actions, coverage, indicators, ingest, joins, resample, returns
from tidemark.plans.blocks import DAY, Axis

OHLC = ("open", "high", "low", "close")


def bars_of(spark, closes, asset="A", start="2024-01-02", step="1D"):
    ts = pd.date_range(start, periods=len(closes), freq=step)
    rows = [(asset, t.to_pydatetime(), c, c * 1.01, c * 0.99, c, 10.0) for t, c in zip(ts, closes)]
    return spark.createDataFrame(rows, "asset string, ts timestamp, open double, high double, low double, close double, volume double")


def test_resample_first_max_min_last_sum_and_extra_columns(spark):
    ts = pd.date_range("2024-01-01 09:30", periods=10, freq="1min")
    rows = [("A", t.to_pydatetime(), 100.0 + i, 101.0 + i, 99.0 + i, 100.5 + i, 10, i) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, open double, high double, low double, close double, volume long, signal long")
    out = resample.resample(df, "5minute").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.signal) for r in out] == [(100.0, 105.0, 99.0, 104.5, 50, 4), (105.0, 110.0, 104.0, 109.5, 50, 9)]


def test_resample_drops_buckets_with_a_null_price(spark):
    df = bars_of(spark, [1.0, 2.0]).withColumn("high", F.lit(None).cast("double"))
    assert resample.resample(df, "1d").count() == 0


def test_coarser_from_finer_is_the_same(spark):
    df = bars_of(spark, [float(i % 17 + 1) for i in range(500)], step="1min")
    direct = resample.resample(df, "1h")
    via = resample.resample(resample.resample(df, "5m"), "1h")
    assert direct.exceptAll(via).count() == 0


def test_history_drops_the_incomplete_bucket(spark):
    df = bars_of(spark, [float(i + 1) for i in range(12)], start="2024-01-01 10:00", step="1min")
    out = resample.history(df, dt.datetime(2024, 1, 1, 10, 8), 10, "5m", "1m").collect()
    assert [r.ts.minute for r in out] == [0]


@pytest.mark.parametrize("step,want", [("5minute", 300), ("1h", 3600), ("day", 86400), ("2 W", 1209600)])
def test_step_names(step, want):
    assert times.step_seconds(step) == want


def test_returns_null_first_and_dividend(spark):
    df = bars_of(spark, [100.0, 110.0]).withColumn("dividend", F.when(F.col("close") == 110.0, 1.1).otherwise(0.0))
    rows = returns.simple_returns(df).orderBy("ts").collect()
    assert rows[0]["return"] is None and rows[1]["return"] == pytest.approx(0.11)


def test_performance_of_known_series(spark):
    df = bars_of(spark, [100.0, 120.0, 90.0, 99.0], step="365D").withColumnRenamed("asset", "run_id")
    ax = Axis(("run_id",), width=365 * DAY, measured=False)
    r = returns.performance(returns.simple_returns(df, ax), ax=ax).collect()[0]
    years = 3 * 365 / 365.25
    assert r.total_return == pytest.approx(-0.01)
    assert r.cagr == pytest.approx(0.99 ** (1 / years) - 1)
    assert r.max_drawdown == pytest.approx(0.25)
    assert r.max_drawdown_ts == dt.datetime(2024, 1, 2) + dt.timedelta(days=730)


def test_single_row_has_no_drawdown(spark):
    df = bars_of(spark, [5.0]).withColumnRenamed("asset", "run_id")
    ax = Axis(("run_id",), width=365 * DAY, measured=False)
    r = returns.performance(returns.simple_returns(df, ax), ax=ax).collect()[0]
    assert (r.max_drawdown, r.cagr, r.volatility, r.sharpe) == (0.0, 0.0, 0.0, 0.0)


def test_indicators_do_not_look_ahead(spark):
    closes = [100 + (i * 37 % 23) - (i * 11 % 7) for i in range(120)]
    df = bars_of(spark, [float(c) for c in closes])
    studies = [indicators.sma(5), indicators.rsi(14), indicators.atr(14), indicators.macd(), indicators.bbands(20), indicators.stochastic()]
    full = indicators.compute(df, studies)
    cut = dt.datetime(2024, 3, 1)
    part = indicators.compute(df.filter(F.col("ts") <= F.lit(cut)), studies)
    known = full.filter(F.col("ts") <= F.lit(cut))
    digits = lambda d: d.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in d.dtypes])
    assert digits(known).exceptAll(digits(part)).count() == 0


def test_alternating_signals(spark):
    df = bars_of(spark, [float(c) for c in (1, 1, 9, 9, 1, 9, 1)])
    out = indicators.alternating_signals(df, F.col("close") < 5, F.col("close") > 5).orderBy("ts").collect()
    assert [r.signal for r in out] == [None, 1, None, -1, None, 1, -1]


@pytest.mark.parametrize(
    "closes,want",
    [
        ([100, 101, 202, 103, 104], [100, 101, 101, 103, 104]),
        ([100, 101, 50.5, 103, 104], [100, 101, 101, 103, 104]),
        ([100, 101, 202, 204, 206], [100, 101, 202, 204, 206]),
        ([100, 100, 101, 100, 200], [100, 100, 101, 100, 100]),
    ],
)
def test_split_spikes(spark, closes, want):
    out = ingest.repair_split_spikes(bars_of(spark, [float(c) for c in closes])).orderBy("ts").collect()
    assert [r.close for r in out] == pytest.approx(want)


def test_repair_copies_the_row_before_and_clears_quotes_after_a_pause(spark):
    b = spark.createDataFrame(
        [("A", dt.datetime(2024, 1, 1, 10), 1.0, 2.0, 0.5, 1.5, 7.0, 1.4, 1.6)],
        "asset string, ts timestamp, open double, high double, low double, close double, volume double, bid double, ask double",
    )
    hours = [dt.datetime(2024, 1, 1, h) for h in (10, 11, 16)]
    grid = spark.createDataFrame([("A", h) for h in hours], "asset string, ts timestamp")
    copied = ingest.repair(b, grid).orderBy("ts").collect()
    assert [(r.open, r.volume) for r in copied] == [(1.0, 7.0)] * 3
    assert [r.bid for r in copied] == [1.4, 1.4, None]
    flat = ingest.grid_fill(b, grid).orderBy("ts").collect()
    assert [(r.open, r.volume) for r in flat] == [(1.0, 7.0), (1.5, 0.0), (1.5, 0.0)]


def test_daily_fill_stops_after_three_days(spark):
    b = bars_of(spark, [5.0]).unionByName(bars_of(spark, [6.0], start="2024-01-08"))
    out = ingest.daily_with_limited_fill(b).orderBy("day").collect()
    assert [(r.close, r.missing) for r in out] == [(5.0, False)] * 4 + [(None, True)] * 2 + [(6.0, False)]


def test_auto_adjust_and_zero_rows(spark):
    b = bars_of(spark, [10.0]).withColumn("adj_close", F.lit(5.0))
    assert ingest.auto_adjust(b).collect()[0].open == 5.0
    z = b.withColumns({c: F.lit(0.0) for c in OHLC})
    r = ingest.blank_zero_bars(z).collect()[0]
    assert (r.close, r.volume, r.missing) == (None, 0.0, True)


def test_back_adjust_is_cumulative_and_idempotent(spark):
    b = bars_of(spark, [400.0, 400.0, 100.0, 50.0])
    s = spark.createDataFrame([("A", dt.date(2024, 1, 4), 4.0), ("A", dt.date(2024, 1, 5), 2.0)], "asset string, event_date date, ratio double")
    once = actions.back_adjust(b, s)
    twice = actions.back_adjust(once, s)
    assert [r.close for r in once.orderBy("ts").collect()] == [50.0, 50.0, 50.0, 50.0]
    assert [r.volume for r in once.orderBy("ts").collect()] == [80.0, 80.0, 20.0, 10.0]
    assert once.exceptAll(twice).count() == 0


def test_missing_windows(spark):
    r = spark.createDataFrame([("A", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 7)), ("A", dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 9))], "asset string, start_ts timestamp, end_ts timestamp")
    q = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 12)), ("B", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2))], "asset string, start_ts timestamp, end_ts timestamp")
    out = coverage.missing_windows(q, r, DAY).orderBy("asset", "missing_start").collect()
    got = [(x.asset, x.missing_start.day, x.missing_end.day) for x in out]
    assert got == [("A", 1, 4), ("A", 10, 12), ("B", 1, 2)]


def test_live_rows_replace_history_and_keep_its_columns(spark):
    h = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0, "x")], "asset string, ts timestamp, close double, note string")
    v = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 2.0)], "asset string, ts timestamp, close double")
    r = joins.history_with_tail(h, v).collect()[0]
    assert (r.close, r.note) == (2.0, "x")


def test_futures_closed(spark):
    t = spark.createDataFrame([(dt.datetime(2024, 1, 5, 21, 59),), (dt.datetime(2024, 1, 5, 22, 0),), (dt.datetime(2024, 1, 7, 22, 59),), (dt.datetime(2024, 1, 7, 23, 0),), (dt.datetime(2024, 1, 8, 22, 30),)], "ts timestamp")
    assert [r[0] for r in t.select(times.futures_closed(F.col("ts"))).collect()] == [False, True, True, False, True]


@pytest.mark.parametrize("every", [5, 40])
def test_recurrences_pass_over_nulls(spark, every):
    """Every fifth value missing, or all but every fortieth of a long series."""
    import math
    import random

    from tidemark.operators import indicators as ind

    rnd = random.Random(4)
    t0 = dt.datetime(2024, 1, 1)
    gone = (lambda k: k % 5 == 3 or k in (0, 7)) if every == 5 else (lambda k: k % 40)
    closes = [None if gone(k) else 100 + 10 * rnd.random() for k in range(400 if every == 5 else 9000)]
    rows = [("A", t0 + dt.timedelta(hours=k), c, None if c is None else c + 2, None if c is None else c - 3) for k, c in enumerate(closes)]
    bars = spark.createDataFrame(rows, "asset string, ts timestamp, close double, high double, low double")

    def recursion(values, n, alpha):
        seen, last, out = [], None, []
        for x in values:
            if x is not None:
                seen.append(x)
                if len(seen) == n:
                    last = sum(seen) / n
                elif len(seen) > n:
                    last = (1 - alpha) * last + alpha * x
            out.append(last)
        return out

    got = ind.compute(bars, [ind.ema(9), ind.rsi(14), ind.atr(14), ind.macd()]).orderBy("ts").collect()
    solid = [(k, c) for k, c in enumerate(closes) if c is not None]
    moves, ranges = [None] * len(closes), [None] * len(closes)
    for (_, before), (k, c) in zip([(None, None), *solid], solid):
        moves[k] = None if before is None else c - before
        ranges[k] = 5.0 if before is None else max(5.0, abs(c + 2 - before), abs(c - 3 - before))
    up = recursion([None if m is None else max(m, 0) for m in moves], 14, 1 / 14)
    down = recursion([None if m is None else max(-m, 0) for m in moves], 14, 1 / 14)
    fast, slow = recursion(closes, 12, 2 / 13), recursion(closes, 26, 2 / 27)
    line = [None if s is None else f - s for f, s in zip(fast, slow)]
    signal = recursion([None if c is None else x for c, x in zip(closes, line)], 9, 2 / 10)
    expected = {
        "ema_9": recursion(closes, 9, 2 / 10), "atr_14": recursion(ranges, 14, 1 / 14), "macd": line, "macd_signal": signal,
        "rsi_14": [None if u is None else 100 * u / (u + d) for u, d in zip(up, down)],
    }
    for name, values in expected.items():
        for k, (row, value) in enumerate(zip(got, values)):
            assert (row[name] is None) == (value is None), (name, k)
            assert value is None or math.isclose(row[name], value, rel_tol=1e-9), (name, k)


def test_benchmark_comparison(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    b = rng.normal(0, 0.01, 50)
    r = 0.5 * b + rng.normal(0.001, 0.002, 50)
    rows = [("x", dt.date(2024, 1, 1) + dt.timedelta(days=k), float(p), float(q)) for k, (p, q) in enumerate(zip(r, b))]
    rows += [("flat", dt.date(2024, 1, k), 0.0, 0.0) for k in (1, 2, 3)] + [("one", dt.date(2024, 1, 1), 0.5, 0.5)]
    out = {x.run_id: x for x in returns.benchmark_comparison(spark.createDataFrame(rows, "run_id string, day date, return double, benchmark_return double")).collect()}
    r, b, x = r[1:], b[1:], out["x"]
    beta = np.cov(r, b)[0, 1] / b.var(ddof=1)
    want = {
        "days": 49, "total_return": np.prod(1 + r) - 1, "benchmark_total_return": np.prod(1 + b) - 1, "correlation": np.corrcoef(r, b)[0, 1], "beta": beta, "alpha": (r.mean() - beta * b.mean()) * 365,
        "tracking_error": (r - b).std(ddof=1) * 365**0.5, "information_ratio": (r - b).mean() / (r - b).std(ddof=1) * 365**0.5, "up_capture": r[b > 0].mean() / b[b > 0].mean(), "down_capture": r[b < 0].mean() / b[b < 0].mean(),
    }
    for name, value in want.items():
        assert x[name] == pytest.approx(value), name
    assert out["flat"].beta is None and out["flat"].information_ratio is None and "one" not in out


def test_growth_beyond_a_double_keeps_its_logarithm(spark):
    bars = bars_of(spark, [2.0**i for i in range(20)]).withColumn("dividend", F.col("close") * 1e20)
    top = max(r.log_growth for r in returns.symbol_returns(bars).collect())
    assert top == pytest.approx(19 * 20 * 2.302585092994046)


def test_limited_fill_joins_no_calendar(spark):
    days = [dt.datetime(2024, 1, d) for d in (1, 3, 8)]
    bars = spark.createDataFrame([("A", t, *[float(t.day)] * 4, 1.0) for t in days], "asset string, ts timestamp, open double, high double, low double, close double, volume double")
    out = ingest.daily_with_limited_fill(bars)
    assert [(r.day.day, r.close, r.volume, r.missing) for r in out.orderBy("day").collect()] == [
        (1, 1.0, 1.0, False), (2, 1.0, 0.0, False), (3, 3.0, 1.0, False), (4, 3.0, 0.0, False), (5, 3.0, 0.0, False), (6, 3.0, 0.0, False), (7, None, None, True), (8, 8.0, 1.0, False),
    ]
    # one join, of the few block totals
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_fills_are_joined_once(spark):
    from tidemark.queries import lens

    assert "Join" not in lens.fills(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
