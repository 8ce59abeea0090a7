"""Option chains over the part table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators import options
from tidemark.queries import lens
from tidemark.queries.cleaning import _CAL, calendar
from tidemark.queries.registry import query
from tidemark.queries.series import rounded

DAY0 = dt.date(2024, 1, 2)


def contracts(spark, sf):
    """part as option contracts around a spot of 950: one underlying per brand."""
    p = lens.table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("contract_id"),
        F.col("p_brand").alias("underlying"),
        F.date_add(F.lit(DAY0), (F.col("p_size") * 7 - 4).cast("int")).alias("expiration"),
        (F.col("p_retailprice") * 1.0).alias("strike"),
        F.when(k % 2 == 0, "CALL").otherwise("PUT").alias("right"),
        F.lit(950.0).alias("spot"),
        (2.0 + k % 4).alias("rate"),
        (0.5 + k % 3).alias("carry"),
        (15.0 + k % 40).alias("volatility"),
        (F.col("p_size") * 7 - 4).cast("double").alias("days"),
    )


CON = """con AS (SELECT p_partkey AS contract_id, p_brand AS underlying, CAST(DATE '2024-01-02' + CAST(p_size * 7 - 4 AS INTEGER) AS DATE) AS expiration, p_retailprice AS strike,
  CASE WHEN p_partkey % 2 = 0 THEN 'CALL' ELSE 'PUT' END AS "right", 950.0::DOUBLE AS spot, (2 + p_partkey % 4)::DOUBLE AS rate, (0.5 + p_partkey % 3)::DOUBLE AS carry,
  (15 + p_partkey % 40)::DOUBLE AS volatility, (p_size * 7 - 4)::DOUBLE AS days FROM part)"""


def _poly(x, cs):
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def cdf_sql(x):
    a = f"abs({x})"
    bell = f"exp(-{a} * {a} / 2)"
    near = f"{bell} * {_poly(a, normal.UPPER)} / {_poly(a, normal.LOWER)}"
    far = f"{bell} / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + 0.65))))) / {normal.ROOT_TWO_PI!r}"
    return f"(CASE WHEN {x} > 0 THEN 1 - 1 * (CASE WHEN {a} < {normal.TAIL_FROM!r} THEN {near} ELSE {far} END) ELSE (CASE WHEN {a} < {normal.TAIL_FROM!r} THEN {near} ELSE {far} END) END)"


def greeks_sql(carry):
    y = "carry / 100" if carry else "0.0"
    return f"""{CON}, g1 AS (SELECT *, rate / 100 AS r, {y} AS y, volatility / 100 AS v, days / 365 AS t FROM con),
  g2 AS (SELECT *, v * sqrt(t) AS a, (ln(spot / strike) + (r - y + v * v / 2) * t) / (v * sqrt(t)) AS d1 FROM g1),
  g3 AS (SELECT *, d1 - a AS d2, exp(-d1 * d1 / 2) / {normal.ROOT_TWO_PI!r} AS p1, exp(-r * t) AS b, exp(-y * t) AS f FROM g2),
  g AS (SELECT *, {cdf_sql('d1')} AS n1, {cdf_sql('d2')} AS n2 FROM g3)"""


_COLS = """round(f * spot * n1 - b * strike * n2, 6) AS call_price, round(b * strike * (1 - n2) - f * spot * (1 - n1), 6) AS put_price, round(f * n1, 6) AS call_delta, round(-f * (1 - n1), 6) AS put_delta,
  round(-b * n2, 6) AS call_dual_delta, round(b * (1 - n2), 6) AS put_dual_delta, round(spot * f * p1 * sqrt(t) / {vega}, 6) AS vega,
  round((-spot * f * p1 * v / (2 * sqrt(t)) + y * spot * f * n1 - r * strike * b * n2) / 365, 6) AS call_theta, round((-spot * f * p1 * v / (2 * sqrt(t)) - y * spot * f * (1 - n1) + r * strike * b * (1 - n2)) / 365, 6) AS put_theta,
  round(strike * t * b * n2 / 100, 6) AS call_rho, round(-strike * t * b * (1 - n2) / 100, 6) AS put_rho, round(p1 * f / (spot * a), 8) AS gamma, round(n2, 6) AS exercise_probability"""
_DROP = ("underlying", "expiration", "strike", "right", "spot", "rate", "carry", "volatility", "days")


def shaped(df):
    return rounded(df.drop(*_DROP).withColumn("gamma", F.round("gamma", 8)), skip=("gamma",))


@query("greeks_bs", "O1 O8", f"WITH {greeks_sql(False)} SELECT contract_id, {_COLS.format(vega=100)} FROM g")
def greeks_bs(spark, sf):
    return shaped(options.greeks(contracts(spark, sf)))


@query("greeks_merton", "O3", f"WITH {greeks_sql(True)} SELECT contract_id, {_COLS.format(vega=100)} FROM g")
def greeks_merton(spark, sf):
    return shaped(options.greeks(contracts(spark, sf), "merton", carry="carry"))


@query("greeks_gk", "O2", f"""WITH {greeks_sql(True)} SELECT contract_id, {_COLS.format(vega=1)}, round(-spot * t * f * n1 / 100, 6) AS call_rho_foreign, round(spot * t * f * (1 - n1) / 100, 6) AS put_rho_foreign FROM g""")
def greeks_gk(spark, sf):
    return shaped(options.greeks(contracts(spark, sf), "gk", carry="carry"))


@query("put_call_parity", "O1", f"""WITH {greeks_sql(False)} SELECT contract_id, round(f * spot * n1 - b * strike * n2 - (b * strike * (1 - n2) - f * spot * (1 - n1)) - spot + strike / pow(1 + r, t), 6) AS parity FROM g""")
def put_call_parity(spark, sf):
    g = options.greeks(contracts(spark, sf))
    p = options.put_call_parity(F.col("call_price"), F.col("put_price"), F.col("spot"), F.col("strike"), F.col("rate"), F.col("days"))
    return rounded(g.select("contract_id", p.alias("parity")))


# The volatility that was put in must come out again, so the twin simply returns it.
@query("implied_volatility", "O4", f"""WITH {greeks_sql(False)} SELECT contract_id, round(volatility, 3) AS implied_volatility FROM g
  WHERE CASE WHEN "right" = 'CALL' THEN spot > strike + (f * spot * n1 - b * strike * n2) ELSE strike > spot + (b * strike * (1 - n2) - f * spot * (1 - n1)) END = false""")
def implied_volatility(spark, sf):
    g = options.greeks(contracts(spark, sf))
    price = F.when(F.col("right") == "CALL", F.col("call_price")).otherwise(F.col("put_price"))
    iv = options.implied_volatility(g.withColumn("price", price))
    return iv.filter(F.col("implied_volatility") > options.IV_DEEP).select("contract_id", F.round("implied_volatility", 3).alias("implied_volatility"))


def quoted(spark, sf):
    """Contracts priced at one moment, with the underlying of the same brand drifting over the hours before."""
    c = contracts(spark, sf).select("contract_id", "underlying", "expiration", "strike", "right")
    now = F.lit(dt.datetime(2024, 1, 2, 15, 30)).cast("timestamp")
    price = 30.0 + F.col("contract_id") % 25
    return c.withColumns({"ts": now, "price": price})


def spots(spark, sf):
    b = lens.table(spark, sf, "part").select(F.col("p_brand").alias("asset")).distinct()
    hours = F.explode(F.array(*[F.lit(i) for i in range(6)])).alias("h")
    at = F.timestamp_micros(F.unix_micros(F.lit(dt.datetime(2024, 1, 2, 12)).cast("timestamp")) + F.col("h") * 3_600_000_000)
    return b.select("asset", hours).select("asset", at.alias("ts"), (940.0 + 3 * F.col("h")).alias("close"))


@query("greeks_as_of", "O5", None)
def greeks_as_of(spark, sf):
    return rounded(options.greeks_as_of(quoted(spark, sf), spots(spark, sf), 4.0))


def nested_chains(spark, sf):
    c = contracts(spark, sf)
    d = c.groupBy("underlying", "right", F.date_format("expiration", "yyyy-MM-dd").alias("d")).agg(F.array_sort(F.collect_set("strike")).alias("s"))
    e = d.groupBy("underlying", "right").agg(F.map_from_entries(F.collect_list(F.struct("d", "s"))).alias("e"))
    return e.groupBy("underlying").agg(F.map_from_entries(F.collect_list(F.struct("right", "e"))).alias("chain"))


@query("chain_table", "O6", None)
def chain_table(spark, sf):
    prices = quoted(spark, sf).drop("contract_id")
    out = options.chain_table(nested_chains(spark, sf), prices, spots(spark, sf), 4.0, 920.0, 1000.0)
    return rounded(out)


@query("chain_exploded", "O6 A20", f"WITH {CON} SELECT DISTINCT underlying, \"right\", expiration, strike FROM con")
def chain_exploded(spark, sf):
    return options.explode_chain(nested_chains(spark, sf))


@query("chain_summary", "A20", f"""WITH {CON} SELECT underlying, "right", expiration, min(strike) AS min_strike, max(strike) AS max_strike, list_sort(list(DISTINCT strike)) AS strikes FROM con GROUP BY ALL""")
def chain_summary(spark, sf):
    return options.chain_summary(contracts(spark, sf))


@query("strike_by_delta", "O7 O8 L5", f"""WITH {CON}, s AS (SELECT *, CASE WHEN underlying < 'Brand#2' THEN 0.25 ELSE 0.35 END AS sg, greatest(days / 365, 1.0 / 365) AS t, CASE WHEN "right" = 'CALL' THEN 0.3 ELSE -0.3 END AS target FROM con),
  d AS (SELECT *, (ln(spot / strike) + sg * sg / 2 * t) / (sg * sqrt(t)) AS d1 FROM s), e AS (SELECT *, {cdf_sql('d1')} - CASE WHEN "right" = 'CALL' THEN 0 ELSE 1 END AS delta FROM d)
  SELECT underlying, "right", arg_min(strike, (abs(delta - target), strike)) AS strike, round(arg_min(delta, (abs(delta - target), strike)), 6) AS delta FROM e GROUP BY 1, 2""")
def strike_by_delta(spark, sf):
    c = contracts(spark, sf).withColumns({"index_like": F.col("underlying") < "Brand#2", "target_delta": F.when(F.col("right") == "CALL", 0.3).otherwise(-0.3)})
    return rounded(options.strike_by_delta(c, ("underlying", "right")))


_FRI = "CAST(expiration - CAST(CASE WHEN isodow(expiration) >= 6 THEN isodow(expiration) - 5 ELSE 0 END AS INTEGER) AS DATE)"


@query("expiration_on_or_after", "O9 F24", f"""WITH {CON}, d AS (SELECT DISTINCT underlying, {_FRI} AS e FROM con WHERE contract_id % 3 <> 0), rq AS (SELECT DISTINCT p_brand AS underlying, CAST(DATE '2024-01-05' + CAST(p_partkey % 400 AS INTEGER) AS DATE) AS date FROM part)
  SELECT rq.underlying, rq.date, coalesce(min(e) FILTER (e >= rq.date), max(e) FILTER (e < rq.date)) AS expiration FROM rq LEFT JOIN d ON rq.underlying = d.underlying GROUP BY 1, 2""")
def expiration_on_or_after(spark, sf):
    c = contracts(spark, sf)
    on = ["underlying", "expiration", "strike", "right"]
    rq = c.select("underlying", F.date_add(F.lit(dt.date(2024, 1, 5)), (F.col("contract_id") % 400).cast("int")).alias("date")).distinct()
    return options.expiration_on_or_after(rq, c.select(*on), c.filter(F.col("contract_id") % 3 != 0).select(*on), allow_prior=True)


@query("next_monthly_expiration", "O10 F12", f"""WITH {_CAL}, d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), f AS (SELECT date, CAST(date_trunc('month', date) AS DATE) AS a, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS b FROM d),
  x AS (SELECT date, CASE WHEN a + CAST((12 - isodow(a)) % 7 + 14 AS INTEGER) > date THEN a + CAST((12 - isodow(a)) % 7 + 14 AS INTEGER) ELSE b + CAST((12 - isodow(b)) % 7 + 14 AS INTEGER) END AS e FROM f)
  SELECT date, max(session_date) AS expiration FROM x LEFT JOIN cal ON session_date <= e AND session_date <> DATE '2024-01-19' GROUP BY 1""")
def next_monthly_expiration(spark, sf):
    d = lens.table(spark, sf, "events").select(F.to_date("ts").alias("date")).distinct()
    shut = calendar(spark, sf).filter(F.col("session_date") != F.lit(dt.date(2024, 1, 19)))
    return options.next_monthly_expiration(d, shut)


def part_markets(spark, sf):
    c = contracts(spark, sf)
    k = F.col("contract_id")
    mid = 30.0 + k % 25
    return c.select("contract_id", F.when(k % 7 != 0, mid - 0.5 * (k % 3)).alias("bid"), F.when(k % 5 != 0, mid + 0.5).alias("ask"), F.when(k % 2 == 0, mid).alias("last"))


_MKT = """mkt AS (SELECT p_partkey AS contract_id, CASE WHEN p_partkey % 7 <> 0 THEN (30 + p_partkey % 25 - 0.5 * (p_partkey % 3))::DOUBLE END AS bid, CASE WHEN p_partkey % 5 <> 0 THEN (30.5 + p_partkey % 25)::DOUBLE END AS ask,
  CASE WHEN p_partkey % 2 = 0 THEN (30 + p_partkey % 25)::DOUBLE END AS last FROM part)"""


@query("option_markets", "O11 F26", f"""WITH {_MKT} SELECT contract_id, bid IS NOT NULL AND ask IS NOT NULL AS has_bid_ask, round((ask - bid) / ((bid + ask) / 2), 6) AS spread_pct, coalesce((ask - bid) / ((bid + ask) / 2) > 0.04, false) AS spread_too_wide,
  CASE WHEN bid IS NULL AND ask IS NULL THEN last ELSE ask END AS buy_price, CASE WHEN bid IS NULL AND ask IS NULL THEN last ELSE bid END AS sell_price, bid IS NULL AND ask IS NULL AND last IS NOT NULL AS used_last_price FROM mkt""")
def option_markets(spark, sf):
    out = options.evaluate_market(part_markets(spark, sf), 0.04).drop("flags", "bid", "ask", "last")
    return rounded(out)


KINDS = ("vertical", "calendar", "butterfly", "straddle", "strangle", "diagonal", "ratio")


def packages(spark, sf):
    c = contracts(spark, sf)
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("contract_id") % 7 + 1).cast("int"))
    return c.select(
        F.col("contract_id").alias("package_id"), kind.alias("kind"), "right", (F.col("strike") - 10).alias("low_strike"), F.col("strike").alias("mid_strike"),
        (F.col("strike") + 10).alias("high_strike"), "expiration", F.date_add("expiration", 28).alias("far_expiration"), F.lit(3).alias("ratio"),
    )


_LEGS = f"""{CON}, pk AS (SELECT contract_id AS package_id, contract_id % 7 AS kd, "right" AS rt, strike - 10 AS lo, strike AS md, strike + 10 AS hi, expiration AS ne, CAST(expiration + 28 AS DATE) AS fe FROM con),
  legs AS (SELECT package_id, 0 AS kd, CASE WHEN rt = 'CALL' THEN lo ELSE hi END AS strike, 'buy' AS side, rt AS "right", ne AS expiration, 1 AS quantity, 0 AS leg FROM pk WHERE kd = 0
   UNION ALL SELECT package_id, 0, CASE WHEN rt = 'CALL' THEN hi ELSE lo END, 'sell', rt, ne, 1, 1 FROM pk WHERE kd = 0
   UNION ALL SELECT package_id, 1, md, 'sell', rt, ne, 1, 0 FROM pk WHERE kd = 1 UNION ALL SELECT package_id, 1, md, 'buy', rt, fe, 1, 1 FROM pk WHERE kd = 1
   UNION ALL SELECT package_id, 2, lo, 'buy', rt, ne, 1, 0 FROM pk WHERE kd = 2 UNION ALL SELECT package_id, 2, md, 'sell', rt, ne, 2, 1 FROM pk WHERE kd = 2 UNION ALL SELECT package_id, 2, hi, 'buy', rt, ne, 1, 2 FROM pk WHERE kd = 2
   UNION ALL SELECT package_id, 3, md, 'buy', 'CALL', ne, 1, 0 FROM pk WHERE kd = 3 UNION ALL SELECT package_id, 3, md, 'buy', 'PUT', ne, 1, 1 FROM pk WHERE kd = 3
   UNION ALL SELECT package_id, 4, lo, 'buy', 'PUT', ne, 1, 0 FROM pk WHERE kd = 4 UNION ALL SELECT package_id, 4, hi, 'buy', 'CALL', ne, 1, 1 FROM pk WHERE kd = 4
   UNION ALL SELECT package_id, 5, lo, 'buy', rt, fe, 1, 0 FROM pk WHERE kd = 5 UNION ALL SELECT package_id, 5, hi, 'sell', rt, ne, 1, 1 FROM pk WHERE kd = 5
   UNION ALL SELECT package_id, 6, lo, 'buy', rt, ne, 1, 0 FROM pk WHERE kd = 6 UNION ALL SELECT package_id, 6, hi, 'sell', rt, ne, 3, 1 FROM pk WHERE kd = 6)"""


@query("spread_legs", "O12", f"""WITH {_LEGS} SELECT package_id, ['vertical', 'calendar', 'butterfly', 'straddle', 'strangle', 'diagonal', 'ratio'][kd + 1] AS kind, leg, side, "right", strike, expiration, quantity FROM legs""")
def spread_legs(spark, sf):
    return options.spread_legs(packages(spark, sf))


_QL = "ql AS (SELECT *, CASE WHEN (package_id + leg) % 9 = 0 THEN NULL ELSE strike / 100 + leg END AS bid, strike / 100 + leg + 0.5 AS ask FROM legs)"


def quoted_legs(spark, sf):
    legs = options.spread_legs(packages(spark, sf))
    base = F.col("strike") / 100 + F.col("leg")
    return legs.withColumns({"bid": F.when((F.col("package_id") + F.col("leg")) % 9 != 0, base), "ask": base + 0.5})


@query("package_net_price", "A12", f"""WITH {_LEGS}, {_QL} SELECT package_id, round(sum(CASE WHEN side = 'buy' THEN (bid + ask) / 2 ELSE -(bid + ask) / 2 END), 6) AS mid,
  round(sum(CASE WHEN side = 'buy' THEN bid ELSE -ask END) FILTER (bid IS NOT NULL), 6) AS best, round(sum(CASE WHEN side = 'buy' THEN ask ELSE -bid END) FILTER (bid IS NOT NULL), 6) AS fastest FROM ql GROUP BY 1""")
def package_net_price(spark, sf):
    return rounded(options.net_price(quoted_legs(spark, sf)))


@query("spread_profit", "A13", f"""WITH {_LEGS}, {_QL} SELECT package_id, round(CASE WHEN bool_and(bid IS NOT NULL) THEN (sum(bid * quantity * 100) - (500 + package_id)) / (500 + package_id) * 100 END, 6) AS profit_pct FROM ql GROUP BY 1""".replace("GROUP BY 1", "GROUP BY package_id"))
def spread_profit(spark, sf):
    legs = quoted_legs(spark, sf).withColumns({"price": F.col("bid"), "initial_cost": 500.0 + F.col("package_id")})
    return rounded(options.spread_profit(legs))


@query("portfolio_greeks", "A11", f"""WITH {greeks_sql(False)}, pos AS (SELECT o_custkey % 50 AS account, o_orderkey % (SELECT count(*) FROM part) AS contract_id, sum(CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END) AS quantity FROM orders GROUP BY 1, 2)
  SELECT account, round(sum(f * n1 * quantity), 5) AS delta, round(sum(p1 * f / (spot * a) * quantity), 5) AS gamma, round(sum((-spot * f * p1 * v / (2 * sqrt(t)) - r * strike * b * n2) / 365 * quantity), 5) AS theta,
  round(sum(spot * f * p1 * sqrt(t) / 100 * quantity), 5) AS vega FROM pos JOIN g USING (contract_id) GROUP BY 1""")
def portfolio_greeks(spark, sf):
    n = lens.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    o = lens.table(spark, sf, "orders").crossJoin(F.broadcast(n))  # one row
    pos = o.groupBy((F.col("o_custkey") % 50).alias("account"), (F.col("o_orderkey") % F.col("n")).alias("contract_id")).agg(
        F.sum(F.when(F.col("o_orderstatus") == "F", -1).otherwise(1)).alias("quantity")
    )
    g = options.greeks(contracts(spark, sf)).withColumnsRenamed({"call_delta": "delta", "call_theta": "theta"})
    return rounded(options.portfolio_greeks(pos, g, ["contract_id"]), 5)


_OPOS = f"""{CON}, op AS (SELECT *, contract_id % 7 - 3 AS quantity, 100 AS multiplier, contract_id % 13 = 0 AS is_index, 40000.0 + contract_id % 100000 AS cash, contract_id % 20 AS account, 950 + contract_id % 60 - 30 AS px, contract_id % 4 * 100 AS shares FROM con)"""


def option_positions(spark, sf):
    k = F.col("contract_id")
    return contracts(spark, sf).withColumns(
        {"quantity": k % 7 - 3, "multiplier": F.lit(100), "is_index": k % 13 == 0, "cash": 40000.0 + k % 100000, "account": k % 20, "spot": (950 + k % 60 - 30).cast("double"), "shares": k % 4 * 100}
    )


@query("option_settlement", "O13", f"""WITH {_OPOS}, v AS (SELECT *, greatest(CASE WHEN "right" = 'CALL' THEN px - strike ELSE strike - px END, 0) AS iv FROM op WHERE quantity <> 0),
  e AS (SELECT *, CASE WHEN iv <= 0 THEN 'expired' WHEN is_index THEN 'cash_settled' WHEN quantity > 0 AND CASE WHEN "right" = 'CALL' THEN cash < quantity * 100 * strike ELSE shares < quantity * 100 END THEN 'cash_settled' WHEN quantity > 0 THEN 'exercised' ELSE 'assigned' END AS event FROM v)
  SELECT account, underlying, "right", strike, expiration, event, 'option' AS leg, CASE WHEN quantity > 0 THEN 'sell' ELSE 'buy' END AS side, abs(quantity)::DOUBLE AS units, round(iv, 6) AS price,
  round(CASE WHEN event = 'cash_settled' THEN iv * quantity * 100 ELSE 0 END, 4) AS cash_change FROM e
  UNION ALL SELECT account, underlying, "right", strike, expiration, event, 'underlying', CASE WHEN ("right" = 'CALL') = (quantity > 0) THEN 'buy' ELSE 'sell' END, abs(quantity) * 100.0, round(strike, 6),
  round(CASE WHEN ("right" = 'CALL') = (quantity > 0) THEN -1 ELSE 1 END * abs(quantity) * 100 * strike, 4) FROM e WHERE event IN ('exercised', 'assigned')""")
def option_settlement(spark, sf):
    out = options.settle_expiring(option_positions(spark, sf))
    return out.withColumns({"price": F.round("price", 6), "cash_change": F.round("cash_change", 4)})


@query("early_assignment", "O14", f"""WITH {_OPOS}, v AS (SELECT *, greatest(CASE WHEN "right" = 'CALL' THEN px - strike ELSE strike - px END, 0) AS iv, 20 + contract_id % 10 AS price FROM op)
  SELECT contract_id, round(iv, 6) AS intrinsic, round(greatest(price - iv, 0), 6) AS extrinsic FROM v WHERE quantity < 0 AND days > 0 AND days <= 60 AND iv > 0 AND greatest(price - iv, 0) <= 5 AND NOT is_index""")
def early_assignment(spark, sf):
    p = option_positions(spark, sf).withColumn("price", 20.0 + F.col("contract_id") % 10)
    return rounded(options.early_assignment(p, F.lit(DAY0), 60, 5.0).select("contract_id", "intrinsic", "extrinsic"))
