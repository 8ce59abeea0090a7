"""Ingest, repair, joins, coverage and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import coverage, ingest, joins, resample
from tidemark.plans.blocks import DAY, HOUR, Axis, asof, stored
from tidemark.queries import lens
from tidemark.queries.registry import query
from tidemark.queries.series import rounded

OHLC = ("open", "high", "low", "close")
TICK = Axis(seq=("seq",), width=5 * DAY)
NY = "timezone('America/New_York', {} AT TIME ZONE 'UTC')"


@query("assembled_times", "B1 B2 B3 B22", """SELECT event_type AS asset,
  timezone('UTC', timezone('America/New_York', CAST(CAST(ts AS DATE) AS TIMESTAMP) + to_microseconds(epoch_us(ts) // 1000 % 86400000 * 1000))) AS ts, value AS close FROM events""")
def assembled_times(spark, sf):
    raw = lens.table(spark, sf, "events").select(
        F.col("event_type").alias("Symbol"),
        F.date_format("ts", "yyyyMMdd").cast("int").alias("DATE"),
        F.pmod(F.unix_millis("ts"), F.lit(86_400_000)).alias("ms_of_day"),
        F.col("value").alias("C"),
        F.col("props").alias("Vendor Note"),
    )
    named = ingest.normalize_columns(raw, {k: v for k, v in ingest.ALIASES.items() if k != "date"})
    return ingest.required_columns(ingest.assemble_ts(named)).select("asset", "ts", "close")


@query("epoch_units", "B2 B3", f"""SELECT event_id, date_trunc('second', ts) AS ts, date_trunc('second', {NY.format('ts')}) AS local_ts FROM events""")
def epoch_units(spark, sf):
    e = lens.table(spark, sf, "events")
    sec = F.unix_seconds("ts")
    raw = e.select("event_id", F.when(F.col("event_id") % 2 == 0, sec).otherwise(sec * 1000).alias("ts"))
    return ingest.localize(ingest.assemble_ts(raw))


@query("session_trim", "B4", f"""WITH {lens.TICKS} SELECT * FROM ticks WHERE ts >= '2024-01-03' AND ts <= '2024-01-25'
  AND hour({NY.format('ts')}) * 60 + minute({NY.format('ts')}) BETWEEN 570 AND 959""")
def session_trim(spark, sf):
    return ingest.trim(lens.ticks(spark, sf), dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 25), (570, 959))


_DIRTY = f"""{lens.BARS}, dirty AS (SELECT asset, ts, CASE WHEN z THEN 0 ELSE open END AS open, CASE WHEN z THEN 0 ELSE high END AS high,
  CASE WHEN z THEN 0 ELSE low END AS low, CASE WHEN z THEN 0 ELSE close END AS close, volume, CAST(volume AS BIGINT) % 5 AS count,
  CASE WHEN CAST(volume AS BIGINT) % 2 = 0 THEN low ELSE 0 END AS bid FROM (SELECT *, CAST(volume AS BIGINT) % 7 = 0 AS z FROM bars))"""


def dirty(spark, sf):
    b = lens.bars(spark, sf)
    v = F.col("volume").cast("long")
    b = b.withColumns({"count": v % 5, "bid": F.when(v % 2 == 0, F.col("low")).otherwise(0.0), "ask": F.lit(0.0)})
    return b.withColumns({c: F.when(v % 7 == 0, 0.0).otherwise(F.col(c)) for c in OHLC})


@query("bad_rows_dropped", "B5", f"""WITH {_DIRTY} SELECT asset, ts, close, count, bid, (open = 0 AND close = 0 AND bid <= 0 AND asset = 'click') AS missing FROM dirty
  WHERE (NOT (open = 0 AND high = 0 AND low = 0 AND close = 0) OR bid > 0 OR asset = 'click')
  AND (count > 0 OR bid > 0 OR (open = 0 AND close = 0 AND bid <= 0 AND asset = 'click'))""")
def bad_rows_dropped(spark, sf):
    out = ingest.drop_bad_rows(dirty(spark, sf), F.col("asset") == "click")
    return out.select("asset", "ts", "close", "count", "bid", "missing")


@query("zero_bars_blanked", "B21", f"""WITH {_DIRTY} SELECT asset, ts, nullif(open, 0) AS open, nullif(close, 0) AS close,
  CASE WHEN close = 0 AND high = 0 THEN 0 ELSE volume END AS volume, (close = 0 AND high = 0) AS missing FROM dirty""")
def zero_bars_blanked(spark, sf):
    return ingest.blank_zero_bars(dirty(spark, sf)).select("asset", "ts", "open", "close", "volume", "missing")


@query("non_positive_nulls", "B15", f"WITH {_DIRTY} SELECT asset, ts, nullif(open, 0) AS open, nullif(high, 0) AS high, nullif(low, 0) AS low, nullif(close, 0) AS close FROM dirty")
def non_positive_nulls(spark, sf):
    return ingest.null_non_positive(dirty(spark, sf)).select("asset", "ts", *OHLC)


@query("executable_rows", "B6 B18", f"""WITH {lens.TICKS}, r AS (SELECT asset, date_trunc('day', ts) AS ts, CASE WHEN seq % 11 = 0 THEN NULL ELSE price END AS price, CASE WHEN seq % 5 = 0 THEN NULL ELSE size END AS size, seq, seq % 13 = 0 AS missing FROM ticks)
  SELECT asset, ts, price AS open, price AS high, price AS low, price AS close, coalesce(size, 0) AS volume, missing, seq FROM r WHERE NOT missing AND price IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY asset, ts ORDER BY seq DESC) = 1""")
def executable_rows(spark, sf):
    t = lens.ticks(spark, sf)
    px = F.when(F.col("seq") % 11 != 0, F.col("price")).cast("string")
    rows = t.select(
        "asset",
        F.date_trunc("day", "ts").alias("ts"),
        *[px.alias(c) for c in OHLC],
        F.when(F.col("seq") % 5 != 0, F.col("size")).cast("string").alias("volume"),
        (F.col("seq") % 13 == 0).alias("missing"),
        "seq",
    )
    return ingest.executable_rows(rows, rank=F.col("seq"))


_GRID = """span AS (SELECT asset, date_trunc('day', min(ts)) AS a, max(ts) AS b FROM bars GROUP BY asset),
  grid AS (SELECT asset, ts FROM (SELECT asset, unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM span) g WHERE hour(ts) BETWEEN 9 AND 16)"""


def session_grid(b):
    span = b.groupBy("asset").agg(F.date_trunc("day", F.min("ts")).alias("a"), F.max("ts").alias("b"))
    stamps = F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts")
    return span.select("asset", stamps).filter(F.hour("ts").between(9, 16))


_GRIDDED = f"{lens.BARS}, {_GRID}"
_UPTO = "(PARTITION BY asset ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


@query("repaired_bars", "B7 W13", f"""WITH {_GRIDDED}, quoted AS (SELECT *, low AS bid, high AS ask FROM bars),
  g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 120 MINUTE THEN ts END AS st FROM grid WINDOW w AS (PARTITION BY asset ORDER BY ts)),
  s AS (SELECT asset, ts, last_value(st IGNORE NULLS) OVER {_UPTO} AS session FROM g)
  SELECT s.asset, s.ts, q.open, q.high, q.low, q.close, coalesce(q.volume, 0) AS volume,
  CASE WHEN q.ts >= session THEN q.bid END AS bid, CASE WHEN q.ts >= session THEN q.ask END AS ask
  FROM s ASOF LEFT JOIN quoted q ON s.asset = q.asset AND s.ts >= q.ts""")
def repaired_bars(spark, sf):
    b = lens.bars(spark, sf).withColumns({"bid": F.col("low"), "ask": F.col("high")})
    return ingest.repair(b, session_grid(b))


@query("grid_filled_bars", "B20", f"""WITH {_GRIDDED} SELECT g.asset, g.ts, CASE WHEN q.ts = g.ts THEN q.open ELSE q.close END AS open,
  CASE WHEN q.ts = g.ts THEN q.high ELSE q.close END AS high, CASE WHEN q.ts = g.ts THEN q.low ELSE q.close END AS low, q.close,
  CASE WHEN q.ts = g.ts THEN q.volume ELSE 0 END AS volume FROM grid g ASOF LEFT JOIN bars q ON g.asset = q.asset AND g.ts >= q.ts""")
def grid_filled_bars(spark, sf):
    b = lens.bars(spark, sf)
    return ingest.grid_fill(b, session_grid(b))


@query("voids_filled", "B8", f"""WITH {_GRIDDED}, n AS (SELECT *, coalesce(lead(ts) OVER (PARTITION BY asset ORDER BY ts) - INTERVAL 1 MICROSECOND, ts) AS stop FROM bars)
  SELECT asset, unnest(generate_series(ts, stop, INTERVAL 1 HOUR)) AS ts, close FROM n""")
def voids_filled(spark, sf):
    return ingest.fill_voids(lens.bars(spark, sf).select("asset", "ts", "close"), HOUR)


@query("daily_limited_fill", "B9", f"""WITH {lens.MONTHLY}, d AS (SELECT asset, CAST(ts AS DATE) AS day, arg_max(price, {lens.SHIP_RANK}) AS close FROM shipments GROUP BY 1, 2),
  sp AS (SELECT asset, min(day) AS a, max(day) AS b FROM d GROUP BY 1), g AS (SELECT asset, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM sp)
  SELECT g.asset, g.day, CASE WHEN g.day - d.day <= 3 THEN d.close END AS close, CAST(CASE WHEN g.day = d.day THEN 1 WHEN g.day - d.day <= 3 THEN 0 END AS DOUBLE) AS volume, g.day - d.day > 3 AS missing
  FROM g ASOF LEFT JOIN d ON g.asset = d.asset AND g.day >= d.day""")
def daily_limited_fill(spark, sf):
    s = lens.shipments(spark, sf)
    d = s.groupBy("asset", "ts").agg(F.max_by("price", F.struct(*lens.SHIP_SEQ)).alias("close")).withColumn("volume", F.lit(1.0))
    out = ingest.daily_with_limited_fill(d.withColumns({c: F.col("close") for c in OHLC[:3]}))
    return out.select("asset", "day", "close", "volume", "missing")


@query("closes_retimed", "B10", f"""WITH {lens.BARS}, l AS (SELECT *, {NY.format('ts')} AS lt FROM bars)
  SELECT asset, timezone('UTC', timezone('America/New_York', date_trunc('day', lt) + INTERVAL 16 HOUR)) AS ts, arg_max(close, l.ts) AS close FROM l
  GROUP BY asset, timezone('UTC', timezone('America/New_York', date_trunc('day', lt) + INTERVAL 16 HOUR))""")
def closes_retimed(spark, sf):
    return ingest.retime_to_close(lens.bars(spark, sf).select("asset", "ts", "close"))


@query("placeholders_added", "B11 U2", f"""WITH {_GRIDDED} SELECT asset, ts, close, false AS missing FROM bars UNION ALL
  SELECT asset, ts, NULL, true FROM grid g ANTI JOIN bars b USING (asset, ts)""".replace("FROM grid g ANTI JOIN bars b USING (asset, ts)", "FROM grid g WHERE NOT EXISTS (SELECT 1 FROM bars b WHERE b.asset = g.asset AND b.ts = g.ts)"))
def placeholders_added(spark, sf):
    b = lens.bars(spark, sf)
    return ingest.add_placeholders(b.select("asset", "ts", "close"), session_grid(b))


_EARLY = f"{lens.BARS.replace('bars AS', 'allbars AS')}, bars AS (SELECT * FROM allbars WHERE CAST(volume AS BIGINT) % 3 = 0), {_GRID}"


@query("placeholders_cleared", "B11", f"""WITH {_EARLY} SELECT asset, ts, close, false AS missing FROM allbars UNION ALL
  SELECT asset, ts, NULL, true FROM grid g WHERE NOT EXISTS (SELECT 1 FROM allbars b WHERE b.asset = g.asset AND b.ts = g.ts)""")
def placeholders_cleared(spark, sf):
    b = lens.bars(spark, sf)
    early = b.filter(F.col("volume").cast("long") % 3 == 0)
    marked = ingest.add_placeholders(early.select("asset", "ts", "close"), session_grid(early))
    arrived = b.filter(F.col("volume").cast("long") % 3 != 0).select("asset", "ts", "close", F.lit(False).alias("missing"))
    return ingest.drop_placeholders(marked.unionByName(arrived))


_SPIKES = f"""{lens.MONTHLY}, base AS (SELECT asset, ts, 100 + close / 100000 AS c, CASE CAST(floor(volume) AS BIGINT) % 9 WHEN 0 THEN 2.0 WHEN 1 THEN 0.1 ELSE 1.0 END AS f FROM monthly),
  px AS (SELECT asset, ts, c * f AS open, c * f * 1.01 AS high, c * f * 0.99 AS low, c * f AS close FROM base),
  l AS (SELECT *, lag(open) OVER w AS po, lag(high) OVER w AS ph, lag(low) OVER w AS pl, lag(close) OVER w AS pc, lead(close) OVER w AS nc,
    quantile_cont(close, 0.5) OVER t AS med, count(close) OVER t AS cnt FROM px WINDOW w AS (PARTITION BY asset ORDER BY ts), t AS (PARTITION BY asset ORDER BY ts ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
  k AS (SELECT *, pc IS NOT NULL AND CASE WHEN nc IS NOT NULL THEN abs(nc / pc - 1) <= 0.25 ELSE cnt >= 3 AND abs(pc / med - 1) <= 0.35 END AS fine FROM l)"""


def _hits(up, f):
    pairs = [("open", "po"), ("high", "ph"), ("low", "pl"), ("close", "pc")]
    r = [f"CASE WHEN abs({a}/{b} - {f}) <= {f} * 0.25 THEN 1 ELSE 0 END" if up else f"CASE WHEN abs({b}/{a} - {f}) <= {f} * 0.25 THEN 1 ELSE 0 END" for a, b in pairs]
    main = f"abs({'close/pc' if up else 'pc/close'} - {f}) <= {f} * 0.25"
    return f"fine AND {main} AND {' + '.join(r)} >= 3"


@query("split_spikes_repaired", "B12", f"""WITH {_SPIKES}, sc AS (SELECT *, CASE {' '.join(f"WHEN {_hits(u, f)} THEN {(1 / f) if u else f}" for f in (2.0, 3.0, 4.0, 5.0, 10.0) for u in (True, False))} ELSE 1.0 END AS s FROM k)
  SELECT asset, ts, round(open * s, 6) AS open, round(high * s, 6) AS high, round(low * s, 6) AS low, round(close * s, 6) AS close FROM sc""")
def split_spikes_repaired(spark, sf):
    m = lens.monthly(spark, sf)
    v = F.floor("volume").cast("long") % 9
    c = (100 + F.col("close") / 100_000) * F.when(v == 0, 2.0).when(v == 1, 0.1).otherwise(1.0)
    px = m.select("asset", "ts", c.alias("open"), (c * 1.01).alias("high"), (c * 0.99).alias("low"), c.alias("close"))
    return rounded(ingest.repair_split_spikes(px))


@query("quotes_derived", "B13", f"""WITH {lens.BARS}, q AS (SELECT asset, ts, open AS a, close AS m FROM bars)
  SELECT asset, ts, CASE WHEN m > 0 THEN CASE WHEN a > 0 AND 2 * m - a > 0 AND 2 * m - a <= a THEN 2 * m - a ELSE m END END AS bid,
  CASE WHEN m > 0 THEN CASE WHEN a > 0 AND 2 * m - a > 0 AND 2 * m - a <= a THEN a ELSE m END END AS ask FROM q""")
def quotes_derived(spark, sf):
    b = lens.bars(spark, sf)
    return ingest.derive_quotes(b.select("asset", "ts", F.col("open").alias("close")), b.select("asset", "ts", "close"))


@query("futures_closed", "B14", f"""WITH {lens.TICKS}, l AS (SELECT seq, {NY.format('ts')} AS t FROM ticks)
  SELECT seq, isodow(t) = 6 OR (isodow(t) = 5 AND hour(t) >= 17) OR (isodow(t) = 7 AND hour(t) < 18) OR hour(t) = 17 AS closed FROM l""")
def futures_closed(spark, sf):
    return lens.ticks(spark, sf).select("seq", times.futures_closed(F.col("ts")).alias("closed"))


@query("auto_adjusted", "B16", f"""WITH {lens.BARS} SELECT asset, ts, round(open * (low / close), 6) AS open, round(high * (low / close), 6) AS high, round(low * (low / close), 6) AS low, round(low, 6) AS close FROM bars""")
def auto_adjusted(spark, sf):
    b = lens.bars(spark, sf).drop("volume").withColumn("adj_close", F.col("low"))
    return rounded(ingest.auto_adjust(b))


@query("assets_picked", "B17", """SELECT event_id, event_type AS symbol FROM events WHERE event_type IN ('click', 'view')
  AND (event_type = 'click' OR user_id % 2 = 0)""")
def assets_picked(spark, sf):
    e = lens.table(spark, sf, "events")
    kind = F.when(F.col("user_id") % 2 == 0, "stock").otherwise("option")
    rows = e.select("event_id", F.col("event_type").alias("symbol"), kind.alias("asset_type"))
    wanted = spark.createDataFrame([("click", None), ("view", "stock")], "symbol string, asset_type string")
    return ingest.pick_assets(rows, wanted).drop("asset_type")


@query("deduplicated", "B18 U1", f"""WITH {lens.TICKS} SELECT asset, CAST(ts AS DATE) AS day, arg_min(price, ts) AS price, min(seq) AS seq FROM ticks GROUP BY 1, 2""".replace("min(seq) AS seq", "arg_min(seq, ts) AS seq"))
def deduplicated(spark, sf):
    t = lens.ticks(spark, sf).withColumn("day", F.to_date("ts"))
    return ingest.deduplicate(t, ["asset", "day"], F.struct("ts", "seq"), "first").select("asset", "day", "price", "seq")


@query("is_daily", "B19", f"WITH {lens.DAYS}, {lens.bars_sql()} SELECT asset, true AS days_daily, bool_and(b.ts = date_trunc('day', b.ts)) AS is_daily FROM bars b GROUP BY asset")
def is_daily(spark, sf):
    days = ingest.is_daily(lens.bars(spark, sf, "1d")).withColumnRenamed("is_daily", "days_daily")
    return days.join(ingest.is_daily(lens.bars(spark, sf)), "asset")


@query("session_fill", "W13", f"""WITH {lens.TICKS}, t AS (SELECT asset, ts, seq, CASE WHEN seq % 4 = 0 THEN price END AS bid FROM ticks),
  g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 120 MINUTE THEN 1 ELSE 0 END AS n FROM t WINDOW w AS (PARTITION BY asset ORDER BY ts)),
  s AS (SELECT *, sum(n) OVER {_UPTO} AS sid FROM g)
  SELECT asset, ts, seq, last_value(bid IGNORE NULLS) OVER (PARTITION BY asset, sid ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bid FROM s""")
def session_fill(spark, sf):
    t = lens.ticks(spark, sf).select("asset", "ts", "seq", F.when(F.col("seq") % 4 == 0, F.col("price")).alias("bid"))
    return ingest.session_fill(t, ["bid"], 120, TICK)


@query("session_ids", "W13", f"""WITH {lens.TICKS}, g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 90 MINUTE THEN 1 ELSE 0 END AS n FROM ticks WINDOW w AS (PARTITION BY asset ORDER BY ts))
  SELECT asset, ts, seq, CAST(sum(n) OVER {_UPTO} AS BIGINT) AS session_id FROM g""")
def session_ids(spark, sf):
    return ingest.session_ids(lens.ticks(spark, sf), 90, TICK).select("asset", "ts", "seq", "session_id")


@query("gaps", "W14", f"""WITH {lens.TICKS}, g AS (SELECT asset, lag(ts) OVER (PARTITION BY asset ORDER BY ts) AS gap_start, ts AS gap_end FROM ticks)
  SELECT *, epoch_us(gap_end) - epoch_us(gap_start) AS gap_us FROM g WHERE epoch_us(gap_end) - epoch_us(gap_start) > 7200000000""")
def gaps(spark, sf):
    return ingest.gaps(lens.ticks(spark, sf), 2 * HOUR, TICK)


# ---- joins -----------------------------------------------------------------------------------------------
_QUOTES = f"{lens.TICKS}, quotes AS (SELECT asset, ts AS q_ts, price * 0.999 AS bid, price * 1.001 AS ask FROM ticks WHERE seq % 3 = 0), probes AS (SELECT asset, ts, seq FROM ticks WHERE seq % 3 <> 0)"


def quotes(spark, sf):
    t = lens.ticks(spark, sf)
    q = t.filter(F.col("seq") % 3 == 0)
    return q.select("asset", F.col("ts").alias("q_ts"), (F.col("price") * 0.999).alias("bid"), (F.col("price") * 1.001).alias("ask"))


def probes(spark, sf):
    return lens.ticks(spark, sf).filter(F.col("seq") % 3 != 0).select("asset", "ts", "seq")


@query("asof_quotes", "J1", f"WITH {_QUOTES} SELECT p.asset, ts, seq, q_ts, bid, ask FROM probes p ASOF LEFT JOIN quotes q ON p.asset = q.asset AND p.ts >= q.q_ts")
def asof_quotes(spark, sf):
    return asof(probes(spark, sf), quotes(spark, sf), right_ts="q_ts")


@query("asof_strict", "J1", f"""WITH {lens.SHIPMENTS_SQL}, d AS (SELECT asset, ts AS prev_ts, arg_max(price, {lens.SHIP_RANK}) AS prev_price FROM shipments GROUP BY ALL)
  SELECT s.asset, s.ts, s.l_orderkey, s.l_linenumber, s.l_partkey, s.l_quantity, d.prev_ts, d.prev_price FROM shipments s ASOF LEFT JOIN d ON s.asset = d.asset AND s.ts > d.prev_ts""")
def asof_strict(spark, sf):
    s = lens.shipments(spark, sf)
    right = s.select("asset", F.col("ts").alias("prev_ts"), F.col("price").alias("prev_price"), *lens.SHIP_SEQ)
    left = s.select("asset", "ts", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    slim = right.groupBy("asset", "prev_ts").agg(F.max_by("prev_price", F.struct(*lens.SHIP_SEQ)).alias("prev_price"))
    # asof goes over both sides several times; the daily prices are found once
    return asof(left, stored(slim, "daily-prices"), right_ts="prev_ts", strict=True, width=180 * DAY, unique=True)


@query("asof_within_tolerance", "J2", f"""WITH {_QUOTES}, h AS (SELECT p.asset, ts, seq, q_ts, bid FROM probes p ASOF LEFT JOIN quotes q ON p.asset = q.asset AND p.ts >= q.q_ts)
  SELECT asset, ts, seq, CASE WHEN ts - q_ts <= INTERVAL 30 MINUTE THEN bid END AS bid, CASE WHEN ts - q_ts <= INTERVAL 30 MINUTE THEN q_ts END AS matched_ts FROM h""")
def asof_within_tolerance(spark, sf):
    q = quotes(spark, sf).select("asset", "q_ts", "bid")
    return joins.asof_within(probes(spark, sf), q, 30 * 60_000_000, "q_ts")


@query("previous_close_vs_open", "J3", f"""WITH {lens.DAYS}, d AS (SELECT asset, CAST(days.ts AS DATE) AS day, open, close FROM days)
  SELECT a.asset, a.day, a.open, b.day AS value_day, b.close AS prev_close FROM d a ASOF LEFT JOIN d b ON a.asset = b.asset AND a.day > b.day""")
def previous_close_vs_open(spark, sf):
    d = lens.bars(spark, sf, "1d").withColumn("day", F.to_date("ts"))
    return joins.previous_day_value(d.select("asset", "day", "open"), d.select("asset", "day", F.col("close").alias("prev_close")), "prev_close")


_CAL = """cal AS (SELECT CAST(d AS DATE) AS session_date, timezone('UTC', timezone('America/New_York', d + INTERVAL 570 MINUTE)) AS open_ts,
  timezone('UTC', timezone('America/New_York', d + INTERVAL 960 MINUTE)) AS close_ts FROM
  (SELECT unnest(generate_series(CAST(min(CAST(ts AS DATE)) AS TIMESTAMP), CAST(max(CAST(ts AS DATE)) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM events) WHERE isodow(d) < 6)"""


def calendar(spark, sf):
    return times.weekday_calendar(lens.table(spark, sf, "events").select(F.to_date("ts").alias("day")))


@query("within_session", "J4 F14", f"""WITH {lens.TICKS}, {_CAL} SELECT session_date, asset, ts, price, size, seq, open_ts, close_ts FROM ticks
  JOIN cal ON session_date = CAST({NY.format('ts')} AS DATE) WHERE ts >= open_ts AND ts < close_ts""")
def within_session(spark, sf):
    return joins.within_session(lens.ticks(spark, sf), calendar(spark, sf), times.MARKET_ZONE)


@query("interval_join", "J5", f"""WITH {lens.TICKS}, sp AS (SELECT DISTINCT asset, date_trunc('day', ts) AS start_ts, date_trunc('day', ts) + INTERVAL 18 HOUR AS end_ts, asset || dayofmonth(ts) AS contract FROM ticks)
  SELECT t.asset, t.ts, seq, start_ts, end_ts, contract FROM ticks t JOIN sp ON t.asset = sp.asset AND t.ts >= start_ts AND t.ts < end_ts""")
def interval_join(spark, sf):
    t = lens.ticks(spark, sf)
    day = F.date_trunc("day", "ts")
    spans = t.select("asset", day.alias("start_ts"), (day + F.expr("interval 18 hours")).alias("end_ts"), F.concat("asset", F.dayofmonth("ts")).alias("contract")).distinct()
    return joins.interval_join(t.select("asset", "ts", "seq"), spans, ["asset"])


@query("actions_joined", "J6 A8", f"""WITH {lens.BARS}, ev AS (SELECT event_type AS asset, CAST(ts AS DATE) AS d, sum(value) AS dividend, product(1 + (user_id % 2) / 1000.0) AS split_ratio FROM events GROUP BY 1, 2)
  SELECT b.asset, b.ts, round(coalesce(dividend, 0), 6) AS dividend, round(coalesce(split_ratio, 0), 6) AS split_ratio FROM bars b LEFT JOIN ev ON b.asset = ev.asset AND CAST(b.ts AS DATE) = ev.d""")
def actions_joined(spark, sf):
    e = lens.table(spark, sf, "events")
    ev = e.select(F.col("event_type").alias("asset"), F.to_date("ts").alias("event_date"), F.col("value").alias("cash_amount"), (1.0 + F.col("user_id") % 2 / 1000.0).alias("ratio"))
    out = joins.actions_join(lens.bars(spark, sf).select("asset", "ts"), resample.event_totals(ev), ["dividend", "split_ratio"])
    return rounded(out)


@query("curves_aligned", "J8", f"""WITH {lens.DAYS}, a AS (SELECT CAST(days.ts AS DATE) AS day, close AS click FROM days WHERE asset = 'click'),
  b AS (SELECT CAST(days.ts AS DATE) AS day, close AS view FROM days WHERE asset = 'view'),
  c AS (SELECT CAST(days.ts AS DATE) AS day, volume AS traded FROM days WHERE asset = 'error'), d AS (SELECT CAST(days.ts AS DATE) AS day, open AS bought FROM days WHERE asset = 'purchase'),
  e AS (SELECT CAST(days.ts AS DATE) AS day, high AS signed FROM days WHERE asset = 'signup')
  SELECT * FROM a FULL JOIN b USING (day) FULL JOIN c USING (day) FULL JOIN d USING (day) FULL JOIN e USING (day)""")
def curves_aligned(spark, sf):
    d = lens.bars(spark, sf, "1d").withColumn("day", F.to_date("ts"))
    pick = lambda name, col, out: d.filter(F.col("asset") == name).select("day", F.col(col).alias(out))
    sides = [("click", "close", "click"), ("view", "close", "view"), ("error", "volume", "traded"), ("purchase", "open", "bought"), ("signup", "high", "signed")]
    return joins.align(*[pick(*x) for x in sides], on=["day"])


@query("provider_parity", "J9", f"""WITH {lens.BARS} SELECT asset, count(*) AS rows, round(max(abs(open - close)), 6) AS max_diff, count(*) FILTER (abs(open - close) > 50) AS bad_rows,
  min(ts) FILTER (abs(open - close) > 50) AS first_bad_ts FROM bars GROUP BY 1""")
def provider_parity(spark, sf):
    b = lens.bars(spark, sf)
    other = b.select("asset", "ts", F.col("open").alias("close"))
    return rounded(joins.parity(b.select("asset", "ts", "close"), other, "close", 50.0))


@query("fill_log_diff", "J10", f"""WITH {lens.FILLS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY account, asset ORDER BY {lens.FILL_ORDER}) AS rn FROM fills),
  b AS (SELECT account, asset, side, quantity, CASE WHEN l_linenumber = 7 AND account % 2 = 0 THEN price + 1 ELSE price END AS price, row_number() OVER (PARTITION BY account, asset ORDER BY {lens.FILL_ORDER}) AS rn FROM fills WHERE l_partkey % 997 <> 0)
  SELECT coalesce(a.account, b.account) AS account, coalesce(a.asset, b.asset) AS asset, count(a.rn) AS rows_a, count(b.rn) AS rows_b,
  min(a.rn) FILTER (a.rn IS NOT NULL AND b.rn IS NOT NULL AND (a.side <> b.side OR a.quantity <> b.quantity OR abs(a.price - b.price) > 0.5)) AS first_mismatch,
  min(coalesce(a.rn, b.rn)) FILTER (a.rn IS NULL OR b.rn IS NULL) AS first_unpaired FROM a FULL JOIN b ON a.account = b.account AND a.asset = b.asset AND a.rn = b.rn GROUP BY 1, 2""")
def fill_log_diff(spark, sf):
    f = lens.fills(spark, sf)
    other = f.filter(F.col("l_partkey") % 997 != 0)
    ax = lens.FILLS
    bump = F.when((F.col("l_linenumber") == 7) & (F.col("account") % 2 == 0), F.col("price") + 1).otherwise(F.col("price"))
    # Order by the original price; the altered copy keeps its place.
    other = other.withColumn("p0", F.col("price")).withColumn("price", bump)
    bx = Axis(ax.keys, ax.ts, (*ax.seq[:-1], "p0"), ax.width)
    left = f.withColumn("p0", F.col("price"))
    return joins.fill_log_diff(left, other, bx, 0.25, 2)


@query("missing_dates", "J11 U3", f"""WITH {lens.TICKS}, {_CAL}, c AS (SELECT DISTINCT asset, CAST({NY.format('ts')} AS DATE) AS d FROM ticks WHERE dayofmonth(ts) % 4 <> 0 AND size > 20 AND dayofmonth(ts) > 2),
  life AS (SELECT asset, min(d) AS f FROM c GROUP BY 1 UNION ALL SELECT 'never', NULL)
  SELECT asset, session_date FROM life JOIN cal ON session_date >= coalesce(f, session_date) AND session_date <= DATE '2024-01-25' AND (asset <> 'click' OR session_date <= DATE '2024-01-15')
  WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.asset = life.asset AND c.d = session_date)""")
def missing_dates(spark, sf):
    t = lens.ticks(spark, sf)
    dom = F.dayofmonth("ts")
    cached = t.withColumn("missing", ~((dom % 4 != 0) & (F.col("size") > 20) & (dom > 2)))
    never = t.sparkSession.createDataFrame([("never",)], "asset string")
    assets = t.select("asset").distinct().unionByName(never).withColumn("expiration", F.when(F.col("asset") == "click", F.lit(dt.date(2024, 1, 15))))
    return joins.missing_dates(calendar(spark, sf), cached, assets, dt.date(2024, 1, 25))


@query("history_with_tail", "J12 R7", f"""WITH {lens.BARS}, h AS (SELECT asset, ts, close, volume FROM bars WHERE dayofmonth(ts) <= 20), v AS (SELECT asset, ts, open AS close FROM bars WHERE dayofmonth(ts) >= 20)
  SELECT coalesce(h.asset, v.asset) AS asset, coalesce(h.ts, v.ts) AS ts, coalesce(v.close, h.close) AS close, h.volume FROM h FULL JOIN v ON h.asset = v.asset AND h.ts = v.ts""")
def history_with_tail(spark, sf):
    b = lens.bars(spark, sf)
    h = b.filter(F.dayofmonth("ts") <= 20).select("asset", "ts", "close", "volume")
    v = b.filter(F.dayofmonth("ts") >= 20).select("asset", "ts", F.col("open").alias("close"))
    return joins.history_with_tail(h, v)


@query("upsert_newest", "U1 S2", f"""WITH {lens.BARS} SELECT asset, ts, CASE WHEN dayofmonth(ts) > 15 THEN high ELSE low END AS price FROM bars""")
def upsert_newest(spark, sf):
    b = lens.bars(spark, sf)
    old = b.filter(F.dayofmonth("ts") <= 20).select("asset", "ts", F.col("low").alias("price"))
    new = b.filter(F.dayofmonth("ts") > 15).select("asset", "ts", F.col("high").alias("price"))
    return joins.upsert(old, new, ["asset", "ts"])


@query("date_set_difference", "U3", f"""WITH {lens.TICKS} SELECT 'only_click' AS kind, d FROM (SELECT CAST(ts AS DATE) AS d FROM ticks WHERE asset = 'click' EXCEPT SELECT CAST(ts AS DATE) FROM ticks WHERE asset = 'view' AND size > 97)
  UNION ALL SELECT 'both', d FROM (SELECT CAST(ts AS DATE) AS d FROM ticks WHERE asset = 'click' INTERSECT SELECT CAST(ts AS DATE) FROM ticks WHERE asset = 'view' AND size > 97)""")
def date_set_difference(spark, sf):
    t = lens.ticks(spark, sf)
    a = t.filter(F.col("asset") == "click").select(F.to_date("ts").alias("d"))
    b = t.filter((F.col("asset") == "view") & (F.col("size") > 97)).select(F.to_date("ts").alias("d"))
    return a.subtract(b).select(F.lit("only_click").alias("kind"), "d").unionByName(a.intersect(b).select(F.lit("both").alias("kind"), "d"))


# ---- sorts, limits ---------------------------------------------------------------------------------------
@query("tail_per_asset", "L1 S8", f"""WITH {lens.TICKS} SELECT * FROM ticks WHERE ts <= '2024-01-20 12:00:00' QUALIFY row_number() OVER (PARTITION BY asset ORDER BY ts DESC, seq DESC) <= 50""")
def tail_per_asset(spark, sf):
    t = lens.ticks(spark, sf).filter(F.col("ts") <= F.lit(dt.datetime(2024, 1, 20, 12)))
    return resample.tail(t, 50, order=("ts", "seq"))


@query("nearest_value", "L5", """SELECT s_nationkey AS nation, arg_min(s_suppkey, (abs(s_acctbal - 5000), s_suppkey)) AS s_suppkey FROM supplier GROUP BY 1""")
def nearest_value(spark, sf):
    s = lens.table(spark, sf, "supplier")
    return s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.min_by("s_suppkey", F.struct(F.abs(F.col("s_acctbal") - 5000), "s_suppkey")).alias("s_suppkey"))


# ---- coverage --------------------------------------------------------------------------------------------
_RANGES = "ranges AS (SELECT o_custkey % 50 AS asset, o_orderdate AS start_ts, o_orderdate + to_days(CAST(o_orderkey % 9 AS INTEGER)) AS end_ts FROM orders)"


def coverage_ranges(spark, sf):
    o = lens.table(spark, sf, "orders")
    end = F.timestamp_micros(F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 9) * DAY)
    return o.select((F.col("o_custkey") % 50).alias("asset"), F.col("o_orderdate").alias("start_ts"), end.alias("end_ts"))


_MERGED = f"""{_RANGES}, m1 AS (SELECT *, max(end_ts) OVER (PARTITION BY asset ORDER BY start_ts, end_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ranges),
  m2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ts > reach + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY asset ORDER BY start_ts, end_ts ROWS UNBOUNDED PRECEDING) AS isle FROM m1),
  merged AS (SELECT asset, min(start_ts) AS start_ts, max(end_ts) AS end_ts FROM m2 GROUP BY asset, isle)"""


@query("coverage_merged", "W15", f"WITH {_MERGED} SELECT * FROM merged")
def coverage_merged(spark, sf):
    return coverage.merge_ranges(coverage_ranges(spark, sf), DAY)


@query("missing_windows", "W16", f"""WITH {_MERGED}, req AS (SELECT c_custkey % 60 AS asset, c_custkey AS rid, TIMESTAMP '1994-12-01' + to_days(CAST(c_custkey AS INTEGER)) AS start_ts, TIMESTAMP '1994-12-01' + to_days(CAST(c_custkey + 200 AS INTEGER)) AS end_ts FROM customer),
  holes AS (SELECT asset, end_ts + INTERVAL 1 DAY AS a, lead(start_ts) OVER (PARTITION BY asset ORDER BY start_ts) - INTERVAL 1 DAY AS b FROM merged
    UNION ALL SELECT asset, NULL, min(start_ts) - INTERVAL 1 DAY FROM merged GROUP BY 1 UNION ALL SELECT DISTINCT asset, CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP) FROM req WHERE asset NOT IN (SELECT asset FROM merged))
  SELECT asset, rid, start_ts, end_ts, greatest(start_ts, coalesce(a, start_ts)) AS missing_start, least(end_ts, coalesce(b, end_ts)) AS missing_end FROM req JOIN holes USING (asset)
  WHERE greatest(start_ts, coalesce(a, start_ts)) <= least(end_ts, coalesce(b, end_ts))""")
def missing_windows(spark, sf):
    day0 = F.unix_micros(F.lit(dt.datetime(1994, 12, 1)).cast("timestamp"))
    at = lambda n: F.timestamp_micros(day0 + n * DAY)
    c = lens.table(spark, sf, "customer")
    req = c.select((F.col("c_custkey") % 60).alias("asset"), F.col("c_custkey").alias("rid"), at(F.col("c_custkey")).alias("start_ts"), at(F.col("c_custkey") + 200).alias("end_ts"))
    return coverage.missing_windows(req, coverage_ranges(spark, sf), DAY)


@query("range_chunks", "W17", f"""WITH {_MERGED}, c AS (SELECT *, unnest(generate_series(start_ts, end_ts, INTERVAL 7 DAY)) AS chunk_start FROM merged)
  SELECT *, least(chunk_start + INTERVAL 7 DAY, end_ts) AS chunk_end FROM c WHERE chunk_start < end_ts OR start_ts = end_ts""")
def range_chunks(spark, sf):
    return coverage.chunks(coverage.merge_ranges(coverage_ranges(spark, sf), DAY), 7 * DAY)


@query("coverage_summary", "A16", f"""WITH {lens.TICKS}, r AS (SELECT *, seq % 17 = 0 AS missing FROM ticks), s AS (SELECT asset, count(*) AS rows, count(*) FILTER (missing) AS placeholders,
  min(ts) FILTER (NOT missing) AS first_ts, max(ts) FILTER (NOT missing) AS last_ts FROM r GROUP BY 1)
  SELECT *, date_diff('day', first_ts, last_ts) AS span_days, round(date_diff('day', first_ts, last_ts) / 365.25, 6) AS span_years, date_diff('day', first_ts, last_ts) >= 29 AS passes FROM s""")
def coverage_summary(spark, sf):
    return rounded(coverage.summary(lens.ticks(spark, sf).withColumn("missing", F.col("seq") % 17 == 0), 29))


@query("coverage_vs_request", "A17", f"""WITH {lens.TICKS}, h AS (SELECT asset, min(ts) AS a, max(ts) AS b FROM ticks WHERE asset <> 'view' GROUP BY 1),
  q AS (SELECT DISTINCT asset, CASE WHEN asset = 'click' THEN TIMESTAMP '2023-12-20' ELSE TIMESTAMP '2024-01-01' END AS start_ts, CASE WHEN asset = 'error' THEN TIMESTAMP '2024-03-01' ELSE TIMESTAMP '2024-01-31' END AS end_ts FROM ticks)
  SELECT asset, start_ts, end_ts, a IS NULL OR a - start_ts > INTERVAL 1 DAY AS leading_gap, a IS NULL OR end_ts - b > INTERVAL 1 DAY AS trailing_gap FROM q LEFT JOIN h USING (asset)""")
def coverage_vs_request(spark, sf):
    t = lens.ticks(spark, sf)
    day = lambda *a: F.lit(dt.datetime(*a)).cast("timestamp")
    q = t.select("asset").distinct().select(
        "asset",
        F.when(F.col("asset") == "click", day(2023, 12, 20)).otherwise(day(2024, 1, 1)).alias("start_ts"),
        F.when(F.col("asset") == "error", day(2024, 3, 1)).otherwise(day(2024, 1, 31)).alias("end_ts"),
    )
    return coverage.against_request(t.filter(F.col("asset") != "view"), q, DAY)


@query("trade_audit", "A18 F22", """WITH e AS (SELECT user_id % 10 AS run_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'fill' WHEN event_type = 'signup' THEN 'new' ELSE 'open' END AS status,
  value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
  SELECT run_id, count(*) FILTER (status = 'fill') AS fills, count(*) FILTER (status = 'new') AS new_orders, round(max(abs(price - k)) FILTER (status = 'fill'), 6) AS max_fill_gap,
  max(k) FILTER (status = 'fill') AS max_quote_age, count(*) FILTER (status = 'fill' AND k > 60) AS stale_quotes FROM e GROUP BY 1""")
def trade_audit(spark, sf):
    e = lens.table(spark, sf, "events")
    kind = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("double")
    rows = e.select(
        (F.col("user_id") % 10).alias("run_id"),
        F.when(kind.isin("click", "purchase"), "fill").when(kind == "signup", "new").otherwise("open").alias("status"),
        F.col("value").alias("price"),
        F.to_json(F.struct(k.alias("quote_age"), k.alias("bar_price"))).alias("audit"),
    )
    return rounded(coverage.audit_trades(rows))


_USAGE = "usage AS (SELECT role AS model, role AS agent, length(text) AS input_tokens, length(text) // 3 AS cached_tokens, length(text) // 2 AS output_tokens, turn AS tool_calls, turn * 100 AS latency_ms FROM conversations)"


def usage(spark, sf):
    c = lens.table(spark, sf, "conversations")
    n = F.length("text").cast("long")
    return c.select(
        F.col("role").alias("model"), F.col("role").alias("agent"), n.alias("input_tokens"), F.floor(n / 3).alias("cached_tokens"),
        F.floor(n / 2).alias("output_tokens"), F.col("turn").alias("tool_calls"), (F.col("turn") * 100).alias("latency_ms"),
    )


@query("usage_cost", "A19", f"""WITH {_USAGE}, p AS (SELECT role AS model, length(role) * 1.0 AS ip, 0.5 AS cp, 2.0 * length(role) AS op FROM conversations GROUP BY 1)
  SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(round(sum(((input_tokens - cached_tokens) * ip + cached_tokens * cp + output_tokens * op) / 1000000.0), 6) AS DOUBLE) AS cost FROM usage JOIN p USING (model) GROUP BY 1""")
def usage_cost(spark, sf):
    u = usage(spark, sf)
    n = F.length("model").cast("double")
    prices = u.select("model").distinct().withColumns({"input_price": n, "cached_price": F.lit(0.5), "output_price": 2 * n})
    return rounded(coverage.usage_cost(u, prices))


@query("usage_totals", "A22", f"""WITH {_USAGE} SELECT agent, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(tool_calls) AS BIGINT) AS tool_calls, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM usage GROUP BY GROUPING SETS ((agent), ())""")
def usage_totals(spark, sf):
    return coverage.usage_totals(usage(spark, sf))


