"""Bars, returns and indicators."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import resample, returns
from tidemark.plans.blocks import DAY, Axis
from tidemark.queries import lens
from tidemark.queries.registry import query

AS_OF = dt.datetime(2024, 1, 20, 12)
OHLC = ("open", "high", "low", "close")


def rounded(df, digits=6, skip=()):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(c, digits).alias(c) if kinds[c] == "double" and c not in skip else F.col(c) for c in df.columns])


# ---- aggregation -----------------------------------------------------------------------------------------
@query("ohlcv_daily", "A1", f"WITH {lens.DAYS} SELECT * FROM days")
def ohlcv_daily(spark, sf):
    return lens.bars(spark, sf, "1d")


@query("ohlcv_5min", "A1", f"WITH {lens.TICKS}, {lens.bars_sql('5 minutes')} SELECT * FROM bars")
def ohlcv_5min(spark, sf):
    return lens.bars(spark, sf, "5m")


@query("ohlcv_offset", "A1", f"""WITH {lens.TICKS} SELECT asset,
  time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01 00:30:00') AS ts, arg_min(price, ts) AS open, max(price) AS high,
  min(price) AS low, arg_max(price, ts) AS close, sum(size) AS volume FROM ticks GROUP BY 1, 2""".replace(
    "GROUP BY 1, 2", "GROUP BY asset, time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01 00:30:00')"))
def ohlcv_offset(spark, sf):
    return resample.bars_from_trades(lens.ticks(spark, sf), "2h", offset_us=1800 * 1_000_000)


@query("ohlcv_monthly_shipments", "A1", f"WITH {lens.MONTHLY} SELECT * FROM monthly")
def ohlcv_monthly_shipments(spark, sf):
    return lens.monthly(spark, sf)


@query("aggregate_bars", "A2 A23 F6", f"""WITH {lens.BARS} SELECT asset,
  time_bucket(INTERVAL '4 hours', b.ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, b.ts) AS open, max(high) AS high,
  min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume, round(sum(dividend), 6) AS dividend, arg_max(signal, b.ts) AS signal
  FROM (SELECT *, volume / 1000 AS dividend, CAST(close AS BIGINT) % 7 AS signal FROM bars) b
  GROUP BY asset, time_bucket(INTERVAL '4 hours', b.ts, TIMESTAMP '1970-01-01')""".replace("CAST(close AS BIGINT)", "CAST(floor(close) AS BIGINT)"))
def aggregate_bars(spark, sf):
    b = lens.bars(spark, sf).withColumns({"dividend": F.col("volume") / 1000, "signal": F.floor("close").cast("long") % 7})
    return resample.resample(b, "4 hrs").withColumn("dividend", F.round("dividend", 6))


@query("bars_history", "A3 S8", f"""WITH {lens.BARS}, known AS (SELECT * FROM bars WHERE ts < TIMESTAMP '2024-01-20 12:00:00'),
  newest AS (SELECT asset, max(ts) AS mx FROM known GROUP BY asset),
  agg AS (SELECT asset, time_bucket(INTERVAL '6 hours', k.ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, k.ts) AS open, max(high) AS high,
    min(low) AS low, arg_max(close, k.ts) AS close, sum(volume) AS volume FROM known k
    GROUP BY asset, time_bucket(INTERVAL '6 hours', k.ts, TIMESTAMP '1970-01-01'))
  SELECT agg.* FROM agg JOIN newest USING (asset) WHERE agg.ts <= mx - INTERVAL '5 hours'
  QUALIFY row_number() OVER (PARTITION BY asset ORDER BY agg.ts DESC) <= 10""")
def bars_history(spark, sf):
    return resample.history(lens.bars(spark, sf), AS_OF, 10, "6h", "1h")


@query("bars_between", "A4", f"""WITH {lens.BARS} SELECT asset, time_bucket(INTERVAL '1 day', b.ts, TIMESTAMP '1970-01-01') AS ts,
  arg_min(open, b.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, b.ts) AS close, sum(volume) AS volume
  FROM bars b WHERE b.ts BETWEEN '2024-01-05' AND '2024-01-20 12:00:00'
  GROUP BY asset, time_bucket(INTERVAL '1 day', b.ts, TIMESTAMP '1970-01-01')""")
def bars_between(spark, sf):
    return resample.between(lens.bars(spark, sf), dt.datetime(2024, 1, 5), AS_OF, "1d")


_STEPS = {"5m": "5 minutes", "15m": "15 minutes", "30m": "30 minutes", "1h": "1 hour", "2h": "2 hours", "4h": "4 hours", "1d": "1 day"}


@query("multi_timeframe", "A5", f"WITH {lens.TICKS} " + " UNION ALL ".join(
    f"""SELECT asset, '{k}' AS interval, time_bucket(INTERVAL '{v}', t.ts, TIMESTAMP '1970-01-01') AS ts, arg_min(price, t.ts) AS open,
    max(price) AS high, min(price) AS low, arg_max(price, t.ts) AS close, sum(size) AS volume FROM ticks t
    GROUP BY asset, time_bucket(INTERVAL '{v}', t.ts, TIMESTAMP '1970-01-01')""" for k, v in _STEPS.items()))
def multi_timeframe(spark, sf):
    return resample.multi_timeframe(lens.ticks(spark, sf), tuple(_STEPS))


@query("daily_local_bars", "A6 B3", f"""WITH {lens.BARS} SELECT asset, CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS day,
  arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY 1, 2""")
def daily_local_bars(spark, sf):
    return resample.daily_local(lens.bars(spark, sf))


@query("total_volume", "A7", f"""WITH {lens.BARS} SELECT asset,
  coalesce(sum(volume) FILTER (ts BETWEEN '2024-01-05' AND '2024-01-20 12:00:00'), 0) AS total_volume FROM bars GROUP BY 1""")
def total_volume(spark, sf):
    return resample.total_volume(lens.bars(spark, sf), dt.datetime(2024, 1, 5), AS_OF)


@query("sessions_from_data", "A21", f"""WITH {lens.TICKS} SELECT CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS session_date,
  min(ts) AS open_ts, max(ts) AS close_ts FROM ticks GROUP BY 1""")
def sessions_from_data(spark, sf):
    return resample.sessions_from_data(lens.ticks(spark, sf))


@query("time_axis", "J14", f"WITH {lens.BARS} SELECT DISTINCT ts FROM bars")
def time_axis(spark, sf):
    return resample.time_axis(lens.bars(spark, sf))


# ---- returns ---------------------------------------------------------------------------------------------
@query("returns", "W1", f"""WITH {lens.BARS}, r AS (SELECT asset, ts, close, volume / 1000 AS dividend,
  close / lag(close) OVER w - 1 AS price_change FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts))
  SELECT asset, ts, round(price_change, 6) AS price_change, round(dividend / close, 6) AS dividend_yield,
  round(dividend / close + price_change, 6) AS "return" FROM r""")
def simple_returns(spark, sf):
    b = lens.bars(spark, sf).select("asset", "ts", "close", (F.col("volume") / 1000).alias("dividend"))
    return rounded(returns.simple_returns(b).drop("close", "dividend"))


@query("symbol_growth", "P19", f"""WITH {lens.BARS}, r AS (SELECT asset, ts, close / lag(close) OVER w - 1 + volume / 1000 / close AS r FROM bars WINDOW w AS (PARTITION BY asset ORDER BY ts))
  SELECT asset, ts, round(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY asset ORDER BY ts), 6) AS log_growth FROM r""")
def symbol_growth(spark, sf):
    b = lens.bars(spark, sf).select("asset", "ts", "close", (F.col("volume") / 1000).alias("dividend"))
    return rounded(returns.symbol_returns(b).select("asset", "ts", "log_growth"))


# Month-to-month moves, damped so that products over years stay in range.
_MONTH_RET = f"""{lens.MONTHLY}, ret AS (SELECT asset AS run_id, ts, 0.05 * (close / lag(close) OVER (PARTITION BY asset ORDER BY ts) - 1) AS r
  FROM monthly)"""


def month_returns(spark, sf):
    m = returns.simple_returns(lens.monthly(spark, sf))
    return m.select(F.col("asset").alias("run_id"), "ts", (0.05 * F.col("return")).alias("r"))


_CUM = f"{_MONTH_RET}, cum AS (SELECT run_id, ts, r, product(1 + r) OVER (PARTITION BY run_id ORDER BY ts) AS cum FROM ret)"
_DD = f"{_CUM}, dd AS (SELECT *, max(cum) OVER (PARTITION BY run_id ORDER BY ts) AS hwm FROM cum)"


@query("equity_cum", "W2", f"WITH {_CUM} SELECT run_id, ts, round(cum, 6) AS cum FROM cum")
def equity_cum(spark, sf):
    return rounded(returns.cumulative(month_returns(spark, sf), "r").drop("r"))


@query("drawdown", "W3", f"""WITH {_DD} SELECT run_id, ts, round(cum, 6) AS cum, round(hwm, 6) AS hwm, round(hwm - cum, 6) AS dd_abs,
  round((hwm - cum) / hwm, 6) AS dd_pct, round(cum / hwm - 1, 6) AS dd FROM dd""")
def drawdown(spark, sf):
    return rounded(returns.drawdown(returns.cumulative(month_returns(spark, sf), "r").drop("r")))


@query("drawdown_episodes", "W4", f"""WITH {_DD}, e AS (SELECT *, (hwm - cum) / hwm AS dd_pct,
  sum(CASE WHEN cum >= hwm THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY ts) AS epi FROM dd)
  SELECT run_id, min(ts) AS start, arg_max(ts, (dd_pct, -epoch_us(ts))) AS valley, max(ts) AS "end", round(max(dd_pct), 6) AS depth,
  date_diff('day', min(ts), max(ts)) + 1 AS days FROM e WHERE dd_pct > 0 GROUP BY run_id, epi""")
def drawdown_episodes(spark, sf):
    return rounded(returns.drawdown_episodes(returns.cumulative(month_returns(spark, sf), "r")))


@query("performance_summary", "A9 P18", f"""WITH {_DD}, a AS (SELECT run_id, coalesce(product(1 + r), 1) AS g, stddev_samp(r) AS sd, count(r) AS n,
  date_diff('day', min(ts), max(ts)) / 365.25 AS y, coalesce(max((hwm - cum) / hwm), 0) AS mdd,
  arg_max(ts, ((hwm - cum) / hwm, -epoch_us(ts))) FILTER (cum IS NOT NULL) AS mdd_ts FROM dd GROUP BY run_id),
  b AS (SELECT *, CASE WHEN y > 0 THEN pow(g, 1 / y) - 1 ELSE 0 END AS cagr, CASE WHEN y > 0 THEN coalesce(sd * sqrt(n / y), 0) ELSE 0 END AS vol FROM a)
  SELECT run_id, round(g - 1, 6) AS total_return, round(cagr, 6) AS cagr, round(vol, 6) AS volatility,
  round(CASE WHEN vol <> 0 THEN (cagr - 0.02) / vol ELSE 0 END, 6) AS sharpe, round(mdd, 6) AS max_drawdown, mdd_ts AS max_drawdown_ts,
  round(CASE WHEN mdd <> 0 THEN cagr / mdd ELSE 0 END, 6) AS romad FROM b""")
def performance_summary(spark, sf):
    return rounded(returns.performance(month_returns(spark, sf), "r", 0.02))


_FLOW = f"""{lens.CURVE_SQL}, filled AS (SELECT *, coalesce(last_value(external_flow_total IGNORE NULLS) OVER
  (PARTITION BY run_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS tot FROM curve),
  flow AS (SELECT run_id, ts, portfolio_value, external_flow_total, tot - coalesce(lag(tot) OVER (PARTITION BY run_id ORDER BY ts), 0) AS flow FROM filled),
  fret AS (SELECT *, (portfolio_value - lag(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) - flow)
    / lag(portfolio_value) OVER (PARTITION BY run_id ORDER BY ts) AS ret FROM flow)"""


@query("period_flows", "W5 W6", f"""WITH {_FLOW} SELECT run_id, ts, round(flow, 4) AS flow,
  round(ret, 6) AS "return" FROM fret""")
def period_flows(spark, sf):
    flows = returns.period_flows(lens.cash_totals(spark, sf), "external_flow_total")
    out = returns.flow_adjusted_returns(flows, "portfolio_value", "flow")
    return out.select("run_id", "ts", F.round("flow", 4).alias("flow"), F.round("return", 6).alias("return"))


@query("cash_adjusted_curve", "W7", f"""WITH {_FLOW}, damp AS (SELECT run_id, ts, portfolio_value, tot FROM filled),
  d2 AS (SELECT run_id, ts, 400000 + 0.01 * portfolio_value AS v, 0.01 * tot AS tot FROM damp),
  d3 AS (SELECT *, tot - coalesce(lag(tot) OVER (PARTITION BY run_id ORDER BY ts), 0) AS flow FROM d2),
  d4 AS (SELECT *, (v - lag(v) OVER w - flow) / lag(v) OVER w AS ret, first_value(v - flow) OVER w AS base FROM d3
    WINDOW w AS (PARTITION BY run_id ORDER BY ts))
  SELECT run_id, ts, round(base * product(1 + coalesce(ret, 0)) OVER (PARTITION BY run_id ORDER BY ts), 3) AS adjusted_value FROM d4""")
def cash_adjusted_curve(spark, sf):
    c = lens.cash_totals(spark, sf).select(
        "run_id", "ts", (400000 + 0.01 * F.col("portfolio_value")).alias("v"), (0.01 * F.col("external_flow_total")).alias("total")
    )
    return returns.cash_adjusted_curve(c, "v", "total").select("run_id", "ts", F.round("adjusted_value", 3).alias("adjusted_value"))


_DAILY = f"""{lens.CURVE_SQL}, dv AS (SELECT run_id, CAST(ts AS DATE) AS day, arg_max(portfolio_value, ts) AS value,
  arg_max({{'t': external_flow_total}}, ts).t AS total FROM curve GROUP BY 1, 2),
  st AS (SELECT run_id, arg_min(portfolio_value, ts) AS v0, coalesce(arg_min({{'t': external_flow_total}}, ts).t, 0) AS f0, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM curve GROUP BY 1),
  grid AS (SELECT run_id, v0, f0, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM st),
  f AS (SELECT run_id, v0, f0, day, last_value(value IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v,
    last_value(total IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM grid LEFT JOIN dv USING (run_id, day)),
  p AS (SELECT *, coalesce(lag(v) OVER w, v0) AS pv, coalesce(lag(t) OVER w, f0) AS pt FROM f WINDOW w AS (PARTITION BY run_id ORDER BY day)),
  mark AS (SELECT CAST(l_shipdate AS DATE) AS day, sum(l_extendedprice) / sum(l_quantity) AS c FROM lineitem GROUP BY 1),
  bench AS (SELECT day, c / lag(c) OVER (ORDER BY day) - 1 AS br FROM mark),
  dt AS (SELECT run_id, day, v AS value, coalesce((v - pv - (coalesce(t, 0) - coalesce(pt, 0))) / nullif(pv, 0), 0) AS r, coalesce(br, 0) AS b FROM p LEFT JOIN bench USING (day))"""


def run_days(spark, sf):
    """Daily returns of the runs, external flows taken out, beside those of the mean price of all shipments."""
    li = lens.table(spark, sf, "lineitem")
    mark = li.groupBy(F.to_date("l_shipdate").alias("ts")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"))
    return returns.daily_table(lens.cash_totals(spark, sf), mark)


@query("daily_return_table", "A10 A24", f"""WITH {_DAILY} SELECT run_id, day, value, round(r, 6) AS "return", round(b, 6) AS benchmark_return FROM dt""")
def daily_return_table(spark, sf):
    return rounded(run_days(spark, sf))


@query("benchmark_comparison", "P18 A10", f"""WITH {_DAILY}, k AS (SELECT *, min(day) OVER (PARTITION BY run_id) AS d0 FROM dt),
  m AS (SELECT run_id, count(*) AS days, avg(r) AS mr, avg(b) AS mb, var_samp(b) AS vb, covar_samp(r, b) AS cov, corr(r, b) AS correlation, stddev_samp(r - b) * sqrt(365.0) AS te,
    product(1 + r) - 1 AS total_return, product(1 + b) - 1 AS bt, avg(r) FILTER (b > 0) / avg(b) FILTER (b > 0) AS up, avg(r) FILTER (b < 0) / avg(b) FILTER (b < 0) AS dn FROM k WHERE day > d0 GROUP BY 1)
  SELECT run_id, days, round(ln(abs(1 + total_return)), 6) AS log_growth, round(bt, 6) AS benchmark_total_return, round(correlation, 6) AS correlation, round(cov / vb, 6) AS beta,
    round((mr - 0.02 / 365 - cov / vb * (mb - 0.02 / 365)) * 365, 6) AS alpha, round(te, 6) AS tracking_error, round((mr - mb) * 365 / te, 6) AS information_ratio, round(up, 6) AS up_capture, round(dn, 6) AS down_capture FROM m""")
def benchmark_comparison(spark, sf):
    out = returns.benchmark_comparison(run_days(spark, sf), risk_free=0.02)
    return rounded(out.withColumn("log_growth", F.log(F.abs(1 + F.col("total_return")))).drop("total_return"))


@query("daily_from_returns", "A10", f"""WITH {_MONTH_RET} SELECT run_id, CAST(date_trunc('year', ts) AS DATE) AS day, round(product(1 + r) - 1, 6) AS "return"
  FROM ret GROUP BY 1, 2""")
def daily_from_returns(spark, sf):
    r = month_returns(spark, sf).withColumn("ts", F.date_trunc("year", "ts"))
    return rounded(returns.daily_from_returns(r, "r"))


@query("last_value_of_day", "A24 W18", f"""WITH {lens.CURVE_SQL} SELECT run_id, CAST(ts AS DATE) AS day, arg_max(portfolio_value, ts) AS portfolio_value
  FROM curve GROUP BY 1, 2""")
def last_value_of_day(spark, sf):
    return resample.last_of_day(lens.cash_totals(spark, sf), "portfolio_value")


@query("period_returns", "P20", f"""WITH {lens.CURVE_SQL}, k AS (SELECT * FROM curve WHERE ts <= TIMESTAMP '2001-07-31'),
  a AS (SELECT run_id, arg_max(portfolio_value, ts) AS v, arg_min(portfolio_value, ts) AS v0, min(ts) AS f,
  arg_min(portfolio_value, ts) FILTER (ts >= TIMESTAMP '2001-07-30') AS v1, arg_min(portfolio_value, ts) FILTER (ts >= TIMESTAMP '2001-07-24') AS v7,
  arg_min(portfolio_value, ts) FILTER (ts >= TIMESTAMP '2001-07-01') AS v30 FROM k GROUP BY 1)
  SELECT run_id, round(v / v1 - 1, 6) AS return_24h, round(v / v7 - 1, 6) AS return_7d, round(v / v30 - 1, 6) AS return_30d, round(v / v0 - 1, 6) AS return_total FROM a""")
def period_returns(spark, sf):
    return rounded(returns.period_returns(lens.cash_totals(spark, sf), F.lit(dt.datetime(2001, 7, 31)).cast("timestamp")))


@query("momentum_rank", "W8 W9", f"""WITH {lens.BARS}, m AS (SELECT asset, ts, close / lag(close, 5) OVER (PARTITION BY asset ORDER BY ts) - 1 AS m FROM bars),
  r AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY m DESC, asset) AS rank FROM m WHERE m IS NOT NULL)
  SELECT asset, ts, round(m, 6) AS momentum_5, rank FROM r WHERE rank <= 2""")
def momentum_rank(spark, sf):
    m = ind.compute(lens.bars(spark, sf).select("asset", "ts", "close"), [ind.momentum(5)])
    return rounded(returns.rank_by(m, "momentum_5", 2).drop("close"))


@query("percentile_of_score", "W10 W11", f"""WITH {lens.DAYS}, f AS (SELECT a.asset, a.ts, a.close, count(*) FILTER (b.close < a.close) AS lt,
  count(*) FILTER (b.close <= a.close) AS le, count(*) AS n FROM days a JOIN days b ON a.asset = b.asset AND b.ts BETWEEN a.ts - INTERVAL 14 DAY AND a.ts GROUP BY ALL)
  SELECT asset, ts, round((lt + le + CASE WHEN le > lt THEN 1 ELSE 0 END) * 50.0 / n, 6) AS percentile,
  (lt + le + CASE WHEN le > lt THEN 1 ELSE 0 END) * 50.0 / n > 90 AS percentile_above_max,
  (lt + le + CASE WHEN le > lt THEN 1 ELSE 0 END) * 50.0 / n < 10 AS percentile_below_min FROM f""")
def percentile_of_score(spark, sf):
    days = lens.bars(spark, sf, "1d").select("asset", "ts", "close")
    ranked = returns.percentile_of_score(days, "close", 14, Axis(width=20 * DAY, measured=False))
    return rounded(returns.threshold_flags(ranked, "percentile", 10, 90).drop("close"))


@query("valuation_price", "W12 B15", f"""WITH {lens.BARS}, b AS (SELECT asset, ts, CASE WHEN volume > 60 THEN close ELSE 0 END AS p FROM bars)
  SELECT asset, ts, last_value(CASE WHEN p > 0 THEN p END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS valuation_price FROM b""")
def valuation_price(spark, sf):
    b = lens.bars(spark, sf).select("asset", "ts", F.when(F.col("volume") > 60, F.col("close")).otherwise(0.0).alias("p"))
    return returns.valuation_price(b, "p").drop("p")


@query("latest_per_asset", "W18", f"WITH {lens.TICKS} SELECT * FROM ticks QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC, seq DESC) = 1")
def latest_per_asset(spark, sf):
    return returns.latest(lens.ticks(spark, sf), order=("ts", "seq"))


@query("last_price", "W19 J1", f"""WITH {lens.BARS}, p AS (SELECT event_type AS asset, CASE WHEN event_id % 10 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts, event_id FROM events)
  SELECT p.asset, p.ts, p.event_id, b.ts AS bar_ts, CASE WHEN p.ts > b.ts THEN b.close ELSE b.open END AS last_price
  FROM p ASOF LEFT JOIN bars b ON p.asset = b.asset AND p.ts >= b.ts""")
def last_price(spark, sf):
    p = lens.table(spark, sf, "events").select(
        F.col("event_type").alias("asset"),
        F.when(F.col("event_id") % 10 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts")).alias("ts"),
        "event_id",
    )
    return returns.last_price(p, lens.bars(spark, sf))


@query("alternating_signals", "W20 T5", f"""WITH {lens.BARS}, bb AS (SELECT asset, ts, CASE WHEN row_number() OVER w >= 20 THEN
  (close - (avg(close) OVER f - 2 * stddev_samp(close) OVER f)) / nullif(4 * stddev_samp(close) OVER f, 0) END AS p FROM bars
  WINDOW w AS (PARTITION BY asset ORDER BY ts), f AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
  s AS (SELECT asset, ts, lag(CASE WHEN p < 0.2 THEN 1 WHEN p > 0.9 THEN -1 END) OVER (PARTITION BY asset ORDER BY ts) AS s FROM bb),
  k AS (SELECT *, last_value(s IGNORE NULLS) OVER (PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM s)
  SELECT asset, ts, CASE WHEN s IS NOT NULL AND (was IS NULL OR was <> s) THEN s END AS signal FROM k""")
def alternating_signals(spark, sf):
    b = ind.compute(lens.bars(spark, sf).select("asset", "ts", "close"), [ind.bbands(20)])
    return ind.alternating_signals(b, F.col("bb_pct") < 0.2, F.col("bb_pct") > 0.9).select("asset", "ts", "signal")


# ---- indicators ------------------------------------------------------------------------------------------
def _frame(n):
    return f"(PARTITION BY asset ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


_N = "row_number() OVER (PARTITION BY asset ORDER BY ts)"


@query("rolling_indicators", "T1 T5 T8 T9 T13 T10", f"""WITH {lens.BARS}, a AS (SELECT asset, ts, close, {_N} AS rn,
  avg(close) OVER {_frame(10)} AS sma, avg(close) OVER {_frame(20)} AS m, stddev_samp(close) OVER {_frame(20)} AS sd,
  close / lag(close, 10) OVER (PARTITION BY asset ORDER BY ts) - 1 AS roc, min(low) OVER {_frame(14)} AS lo, max(high) OVER {_frame(14)} AS hi,
  sum(close * volume) OVER {_frame(20)} / sum(volume) OVER {_frame(20)} AS vw FROM bars),
  b AS (SELECT *, CASE WHEN rn >= 14 THEN 100 * (close - lo) / nullif(hi - lo, 0) END AS raw FROM a),
  c AS (SELECT *, CASE WHEN rn >= 16 THEN avg(raw) OVER {_frame(3)} END AS k FROM b),
  d AS (SELECT *, CASE WHEN rn >= 18 THEN avg(k) OVER {_frame(3)} END AS d FROM c)
  SELECT asset, ts, round(CASE WHEN rn >= 10 THEN sma END, 6) AS sma_10, round(100 * roc, 6) AS roc_10,
  round(CASE WHEN rn >= 20 THEN m END, 6) AS bb_mid, round(CASE WHEN rn >= 20 THEN m - 2 * sd END, 6) AS bb_lower,
  round(CASE WHEN rn >= 20 THEN m + 2 * sd END, 6) AS bb_upper, round(CASE WHEN rn >= 20 THEN 400 * sd / m END, 6) AS bb_width,
  round(CASE WHEN rn >= 20 THEN (close - (m - 2 * sd)) / (4 * sd) END, 6) AS bb_pct, round(k, 6) AS stoch_k, round(d, 6) AS stoch_d,
  round(CASE WHEN rn >= 20 THEN vw END, 6) AS vwma_20 FROM d""")
def rolling_indicators(spark, sf):
    studies = [ind.sma(10), ind.roc(10), ind.bbands(20), ind.stochastic(), ind.vwma(20)]
    return rounded(ind.compute(lens.bars(spark, sf), studies).drop(*OHLC, "volume"))


def _rec(src, n, alpha, start=1):
    """Recursive average over rows (asset, rn, x): seed = mean of x in rows start..start+n-1."""
    first = start + n - 1
    return f"""(WITH RECURSIVE y AS (SELECT asset, CAST({first} AS BIGINT) AS rn, avg(x) AS y FROM {src} WHERE rn BETWEEN {start} AND {first} GROUP BY asset HAVING count(*) = {n}
      UNION ALL SELECT s.asset, s.rn, y.y * (1 - {alpha}) + s.x * {alpha} FROM y JOIN {src} s ON s.asset = y.asset AND s.rn = y.rn + 1) SELECT * FROM y)"""


_NUM = f"""{lens.BARS}, num AS MATERIALIZED (SELECT *, {_N} AS rn, lag(close) OVER (PARTITION BY asset ORDER BY ts) AS pc FROM bars),
  px AS MATERIALIZED (SELECT asset, rn, close AS x FROM num)"""


@query("ema", "T2", f"WITH {_NUM} SELECT asset, ts, round(y, 6) AS ema_12 FROM num LEFT JOIN {_rec('px', 12, '(2.0/13)')} e USING (asset, rn)")
def ema(spark, sf):
    return rounded(ind.compute(lens.bars(spark, sf).select("asset", "ts", "close"), [ind.ema(12)]).drop("close"))


@query("rsi", "T3", f"""WITH {_NUM}, up AS MATERIALIZED (SELECT asset, rn, greatest(close - pc, 0) AS x FROM num WHERE rn > 1), dn AS MATERIALIZED (SELECT asset, rn, greatest(pc - close, 0) AS x FROM num WHERE rn > 1)
  SELECT asset, ts, round(100 * u.y / nullif(u.y + d.y, 0), 6) AS rsi_14 FROM num LEFT JOIN {_rec('up', 14, '(1.0/14)', 2)} u USING (asset, rn)
  LEFT JOIN {_rec('dn', 14, '(1.0/14)', 2)} d USING (asset, rn)""")
def rsi(spark, sf):
    return rounded(ind.compute(lens.bars(spark, sf).select("asset", "ts", "close"), [ind.rsi(14)]).drop("close"))


@query("macd", "T4", f"""WITH {_NUM}, line AS MATERIALIZED (SELECT f.asset, f.rn, f.y - s.y AS x FROM {_rec('px', 12, '(2.0/13)')} f JOIN {_rec('px', 26, '(2.0/27)')} s USING (asset, rn))
  SELECT asset, ts, round(x, 6) AS macd, round(g.y, 6) AS macd_signal, round(x - g.y, 6) AS macd_hist FROM num LEFT JOIN line USING (asset, rn)
  LEFT JOIN {_rec('line', 9, '(2.0/10)', 26)} g USING (asset, rn)""")
def macd(spark, sf):
    return rounded(ind.compute(lens.bars(spark, sf).select("asset", "ts", "close"), [ind.macd()]).drop("close"))


@query("atr", "T6", f"""WITH {_NUM}, tr AS MATERIALIZED (SELECT asset, rn, greatest(high - low, abs(high - pc), abs(low - pc)) AS x FROM num)
  SELECT asset, ts, round(y, 6) AS atr_14 FROM num LEFT JOIN {_rec('tr', 14, '(1.0/14)')} a USING (asset, rn)""")
def atr(spark, sf):
    return rounded(ind.compute(lens.bars(spark, sf), [ind.atr(14)]).select("asset", "ts", "atr_14"))


@query("session_vwap", "T7", f"""WITH {lens.BARS}, d AS (SELECT *, CAST(timezone('America/New_York', ts AT TIME ZONE 'UTC') AS DATE) AS session_date FROM bars)
  SELECT asset, ts, session_date, round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 6) AS vwap FROM d
  WINDOW w AS (PARTITION BY asset, session_date ORDER BY ts)""")
def session_vwap(spark, sf):
    return rounded(ind.session_vwap(lens.bars(spark, sf)).drop(*OHLC, "volume"))


@query("indicator_as_of", "T12 J1", f"""WITH {lens.BARS}, s AS (SELECT asset, ts, CASE WHEN {_N} >= 5 THEN avg(close) OVER {_frame(5)} END AS sma_5 FROM bars)
  SELECT p.asset, p.ts, p.seq, round(s.sma_5, 6) AS sma_5 FROM ticks p ASOF LEFT JOIN s ON p.asset = s.asset AND p.ts >= s.ts""")
def indicator_as_of(spark, sf):
    from tidemark.plans.blocks import asof

    s = ind.compute(lens.bars(spark, sf).select("asset", "ts", "close"), [ind.sma(5)])
    hit = asof(lens.ticks(spark, sf).select("asset", "ts", "seq"), s.select("asset", F.col("ts").alias("bar_ts"), "sma_5"), right_ts="bar_ts")
    return rounded(hit.drop("bar_ts"))


@query("custom_indicator", "T11 V1", f"""WITH {lens.BARS} SELECT asset, ts, round(CASE WHEN {_N} >= 10 THEN quantile_cont(close, 0.5) OVER {_frame(10)} END, 6) AS median_10 FROM bars""")
def custom_indicator(spark, sf):
    def rolling_median(pdf):
        return pdf[["asset", "ts"]].assign(median_10=pdf["close"].rolling(10).median().round(6))

    b = lens.bars(spark, sf).select("asset", "ts", "close")
    return ind.custom_blocked(b, rolling_median, "asset string, ts timestamp, median_10 double", 9)


