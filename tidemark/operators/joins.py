"""Time-aware joins of market tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import MARKET_ZONE
from tidemark.plans.blocks import DAY, Axis, asof, latest_by, scan


def asof_within(left: DataFrame, right: DataFrame, tolerance_us: int, right_ts: str = "ts", **how) -> DataFrame:
    """As-of lookup that rejects a match older than the tolerance. Adds ``matched_ts``."""
    stamped = right.withColumnRenamed(right_ts, "matched_ts")
    hit = asof(left, stamped, right_ts="matched_ts", **how)
    fresh = F.unix_micros("ts") - F.unix_micros("matched_ts") <= tolerance_us
    return hit.withColumns({c: F.when(fresh, F.col(c)) for c in hit.columns if c not in left.columns})


def previous_day_value(days: DataFrame, values: DataFrame, value: str, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Latest value dated before each day (yesterday's close against today's open)."""
    return asof(days, values.select(*keys, F.col("day").alias("value_day"), value), keys, "day", "value_day",
                strict=True, width=365 * DAY, measured=False)


def within_session(bars: DataFrame, calendar: DataFrame, zone: str) -> DataFrame:
    """Bars inside a session, with its date and bounds: open_ts <= ts < close_ts.

    Where bars and calendar both have a column ``market``, each bar is looked up in its own market; a calendar for bars
    without one must be of one market. ``zone`` is the time zone of the session dates. A session may begin on the evening before its date: a bar
    is looked up in the session of its local date and in the next one.
    """
    keys = [c for c in ("market",) if c in calendar.columns and c in bars.columns]
    cal = calendar.select(*keys, "session_date", "open_ts", "close_ts")
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    early = cal.filter(F.to_date(F.from_utc_timestamp("open_ts", zone)) < F.col("session_date"))
    near = cal.withColumn("_day", F.col("session_date")).unionByName(early.withColumn("_day", F.date_sub("session_date", 1)))
    hit = bars.withColumn("_day", day).join(near, [*keys, "_day"])
    return hit.filter((F.col("ts") >= F.col("open_ts")) & (F.col("ts") < F.col("close_ts"))).drop("_day")


def interval_join(
    rows: DataFrame, spans: DataFrame, keys: Sequence[str], ts: str = "ts", start: str = "start_ts", end: str = "end_ts"
) -> DataFrame:
    """Rows with the span of their key that contains ts: start <= ts < end. Spans of a key must not overlap,
    so the only candidate is the latest one begun, an as-of lookup: no pair is ever formed and a key with
    many rows or many spans is cut into blocks."""
    begun = spans.withColumn("_start", F.col(start))
    hit = asof(rows, begun, keys, ts, "_start").drop("_start")
    return hit.filter(F.col(ts) < F.col(end))


def actions_join(bars: DataFrame, events: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Corporate actions on their event date; no event means 0."""
    on = [*keys, "event_date"]
    joined = bars.withColumn("event_date", F.to_date("ts")).join(events.select(*on, *cols), on, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in cols}).drop("event_date")


def later_ratio(rows: DataFrame, events: DataFrame, ratio: str = "ratio", keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Product of the ratios of all events dated strictly after each row's ``day`` (1 if none).

    The theta join row.day < event.day is turned into suffix products per event, then an as-of lookup from
    the other end of time: no bar-event pairs are formed.
    """
    keys = list(keys)
    per_day = events.groupBy(*keys, F.col("event_date").alias("_d")).agg(F.product(ratio).alias("_r"))
    back = lambda c: (-F.unix_date(c)).cast("long")
    # Distinct event dates of one asset: a handful; the scan still cuts them if not.
    ax = Axis(tuple(keys), "_pos", width=10_000, measured=False)
    suffix = scan(per_day.select(*keys, back(F.col("_d")).alias("_pos"), "_r"), ax, {"later_ratio": ("prod", F.col("_r"))})
    probe = rows.withColumn("_probe", back(F.col("day")))
    hit = asof(probe, suffix.select(*keys, "_pos", "later_ratio"), keys, "_probe", "_pos", strict=True, width=10_000)
    return hit.withColumn("later_ratio", F.coalesce("later_ratio", F.lit(1.0))).drop("_probe", "_pos")


def align(*frames: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join of curves on their time key."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, list(on), "full")
    return out


def parity(a: DataFrame, b: DataFrame, value: str, tolerance: float, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Inner-aligned difference of two providers' series: rows, greatest difference, first bad stamp."""
    both = a.select(*keys, "ts", F.col(value).alias("_a")).join(b.select(*keys, "ts", F.col(value).alias("_b")), [*keys, "ts"])
    diff = F.abs(F.col("_a") - F.col("_b"))
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(diff).alias("max_diff"),
        F.count_if(diff > tolerance).alias("bad_rows"),
        F.min(F.when(diff > tolerance, F.col("ts"))).alias("first_bad_ts"),
    )


def fill_log_diff(
    a: DataFrame, b: DataFrame, ax: Axis, tick: float, tolerance_ticks: float, cols: Sequence[str] = ("side", "quantity")
) -> DataFrame:
    """Compare two fill logs position by position: lengths, and the first position where a column differs or
    prices are more than the tolerance apart."""
    place = lambda df: scan(df, ax, {"_rn": ("count", F.lit(1))}).select(
        *ax.keys, "_rn", *cols, "price"
    )
    left, right = place(a).alias("a"), place(b).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in (*ax.keys, "_rn")]
    both = left.join(right, on, "full")
    off = F.abs(F.col("a.price") - F.col("b.price")) > tick * tolerance_ticks
    for c in cols:
        off = off | (F.col(f"a.{c}") != F.col(f"b.{c}"))
    missing = F.col("a._rn").isNull() | F.col("b._rn").isNull()
    rn = F.coalesce("a._rn", "b._rn")
    return both.groupBy(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in ax.keys]).agg(
        F.count("a._rn").alias("rows_a"),
        F.count("b._rn").alias("rows_b"),
        F.min(F.when(~missing & off, rn)).alias("first_mismatch"),
        F.min(F.when(missing, rn)).alias("first_unpaired"),
    )


def missing_dates(
    calendar: DataFrame,
    cached: DataFrame,
    assets: DataFrame,
    as_of,
    keys: Sequence[str] = ("asset",),
    zone: str = MARKET_ZONE,
) -> DataFrame:
    """Session dates of each asset's life that hold no real row, in dates of the market's ``zone``: not in the future,
    not before the first real row, not after expiry (if the asset has one). An asset without any real row misses every
    session up to then. With a column ``market`` in calendar and assets, an asset has the sessions of its own market."""
    keys = list(keys)
    local = F.to_date(F.from_utc_timestamp("ts", zone))
    real = cached.filter(~F.coalesce(F.col("missing"), F.lit(False))).select(*keys, local.alias("session_date"))
    first = real.groupBy(*keys).agg(F.min("session_date").alias("_first"))
    life = assets.join(first, keys, "left")
    # The sessions of a market are one list, about 250 dates a year; an asset takes its part of it.
    market = [c for c in ("market",) if c in calendar.columns and c in assets.columns]
    sessions = calendar.filter(F.col("session_date") <= F.lit(as_of).cast("date")).groupBy(*market, F.lit(1).alias("_all"))
    sessions = sessions.agg(F.array_sort(F.collect_set("session_date")).alias("_days"))
    life = life.withColumn("_all", F.lit(1)).join(sessions, [*market, "_all"])
    own = F.filter(
        "_days", lambda d: (d >= F.coalesce(F.col("_first"), d)) & (d <= F.coalesce(F.col("expiration"), d))
    )
    expected = life.select(*keys, F.explode(own).alias("session_date"))
    return expected.join(real, [*keys, "session_date"], "left_anti")


def history_with_tail(history: DataFrame, live: DataFrame, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Stored rows plus live rows; a live row replaces the stored one of the same stamp, and columns only one
    side has are kept."""
    tagged = history.withColumn("_live", F.lit(0)).unionByName(live.withColumn("_live", F.lit(1)), allowMissingColumns=True)
    # Column by column the newest value: live rows often lack the extra columns.
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_live")))
    cols = [c for c in tagged.columns if c not in (*keys, "ts", "_live")]
    return tagged.groupBy(*keys, "ts").agg(*[newest(c).alias(c) for c in cols])


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Union that keeps the newest version of every key."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    return latest_by(both, keys, F.col("_v")).drop("_v")


def outer_positions(positions: DataFrame, prices: DataFrame, targets: DataFrame) -> DataFrame:
    """Positions, prices and target weights of every account side by side; absent numbers are 0."""
    book = positions.join(targets, ["account", "asset"], "full").join(prices, "asset", "left")
    return book.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast("decimal(38,9)")) for c in ("quantity", "weight")})


