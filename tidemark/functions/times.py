"""Time steps, time zones, exchange dates and trading sessions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKET_ZONE = "America/New_York"

# Accepted names of a time step and the unit they stand for.
UNIT_ALIASES = {
    "s": "second", "sec": "second", "secs": "second", "second": "second", "seconds": "second",
    "m": "minute", "t": "minute", "min": "minute", "mins": "minute", "minute": "minute", "minutes": "minute",
    "h": "hour", "hr": "hour", "hrs": "hour", "hour": "hour", "hours": "hour",
    "d": "day", "day": "day", "days": "day",
    "w": "week", "wk": "week", "week": "week", "weeks": "week",
}
UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
_STEP = r"^\s*(\d*)\s*([A-Za-z]+)\s*$"


def parse_step(step: str) -> tuple[int, str]:
    """'5minute', '1h', 'day' -> (quantity, unit)."""
    hit = re.match(_STEP, step)
    unit = UNIT_ALIASES.get(hit.group(2).lower()) if hit else None
    if unit is None:
        raise ValueError(f"not a time step: {step!r}")
    return int(hit.group(1) or 1), unit


def step_seconds(step: str) -> int:
    n, unit = parse_step(step)
    return n * UNIT_SECONDS[unit]


def step_parts(step: Column) -> Column:
    """Column twin of parse_step: struct(quantity, unit, seconds), null fields if it is no time step."""
    names = F.create_map(*[F.lit(x) for kv in UNIT_ALIASES.items() for x in kv])
    sizes = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    unit = names[F.lower(F.regexp_extract(step, _STEP, 2))]
    digits = F.regexp_extract(step, _STEP, 1)
    n = F.when(unit.isNotNull(), F.when(digits == "", 1).otherwise(digits.try_cast("long")))
    return F.struct(n.cast("long").alias("quantity"), unit.alias("unit"), (n * sizes[unit]).cast("long").alias("seconds"))


def local(ts: Column, zone: str = MARKET_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def to_utc(ts: Column, zone: str = MARKET_ZONE) -> Column:
    return F.to_utc_timestamp(ts, zone)


def local_date(ts: Column, zone: str = MARKET_ZONE) -> Column:
    return F.to_date(local(ts, zone))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def epoch_to_ts(n: Column) -> Column:
    """Integer epoch: milliseconds above 1e12, else seconds."""
    return F.when(n > 1_000_000_000_000, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))


def date_ms_to_ts(yyyymmdd: Column, ms_of_day: Column, zone: str = MARKET_ZONE) -> Column:
    day = F.to_timestamp(yyyymmdd.cast("string"), "yyyyMMdd")
    return to_utc(F.timestamp_micros(F.unix_micros(day) + ms_of_day * 1000), zone)


def parse_datetime(text: Column) -> Column:
    """First of several layouts that fits, as UTC; a zone in the text is honoured."""
    s = F.trim(text)
    return F.coalesce(
        F.try_to_timestamp(s),
        F.try_to_timestamp(s, F.lit("yyyyMMdd HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("yyyyMMdd")),
        F.try_to_timestamp(s, F.lit("MM/dd/yyyy HH:mm:ss")),
        F.try_to_timestamp(s, F.lit("MM/dd/yyyy")),
        F.when(s.rlike(r"^\d{10,13}$"), epoch_to_ts(s.try_cast("long"))),
    )


def _weekday(day: Column) -> Column:
    return F.weekday(day)  # Monday 0


def first_friday(day: Column) -> Column:
    return F.next_day(F.date_sub(F.trunc(day, "month"), 1), "Fri")


def third_friday(day: Column) -> Column:
    return F.date_add(first_friday(day), 14)


def last_friday(day: Column) -> Column:
    return F.next_day(F.date_sub(F.last_day(day), 7), "Fri")


def minus_business_days(day: Column, n: Column | int, holidays: Column | None = None) -> Column:
    """n business days before a date (Saturday and Sunday count back from the following Monday).

    ``holidays`` is an array of dates; the look-back window is wide enough for ten of them in a row.
    """
    from tidemark.functions.symbols import bound

    n = F.lit(n) if isinstance(n, int) else n

    def plain(d: Column) -> Column:
        wd = _weekday(d)
        weekend = wd >= 5
        from_day, e = F.when(weekend, F.date_add(d, 7 - wd)).otherwise(d), F.when(weekend, 0).otherwise(wd)
        rest = F.pmod(n, F.lit(5))
        back = F.floor(n / 5) * 7 + rest + F.when(rest > e, 2).otherwise(0)
        return F.date_sub(from_day, back.cast("int"))

    def with_holidays(d: Column) -> Column:
        span = F.sequence(F.date_sub(d, 1), F.date_sub(d, (n * 2 + 16).cast("int")), F.expr("interval -1 day"))
        open_days = F.filter(span, lambda x: (F.weekday(x) < 5) & ~F.array_contains(holidays, x))
        return F.when(n <= 0, d).otherwise(F.element_at(open_days, n.cast("int")))

    return bound(day, plain if holidays is None else with_holidays)


def on_or_before_business_day(day: Column, holidays: Column | None = None) -> Column:
    return minus_business_days(F.date_add(day, 1), 1, holidays)


def third_last_business_day(day: Column, holidays: Column | None = None) -> Column:
    return minus_business_days(F.date_add(F.last_day(day), 1), 3, holidays)


def weekday_calendar(
    days: DataFrame, market: str = "NYSE", open_min: int = 570, close_min: int = 960, zone: str = MARKET_ZONE
) -> DataFrame:
    """Sessions on the weekdays between the first and last ``day`` of a frame (input for tests and examples;
    a real exchange calendar table has the same columns)."""
    span = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    day = F.explode(F.sequence("a", "b")).alias("session_date")
    at = lambda minutes: to_utc(
        F.timestamp_micros(F.unix_micros(F.col("session_date").cast("timestamp")) + minutes * 60_000_000), zone
    )
    return (
        span.select(day)
        .filter(F.weekday("session_date") < 5)
        .select(F.lit(market).alias("market"), "session_date", at(open_min).alias("open_ts"), at(close_min).alias("close_ts"))
    )


def trading_minutes(calendar: DataFrame, minutes: int = 1, include_close: bool = False) -> DataFrame:
    """The N-minute grid inside every session; the closing stamp belongs to round-the-clock markets only."""
    step = F.expr(f"interval {minutes} minutes")
    end = F.col("close_ts") if include_close else F.timestamp_micros(F.unix_micros("close_ts") - 1)
    return calendar.select("market", "session_date", F.explode(F.sequence("open_ts", end, step)).alias("ts"))


def shift_sessions(dates: DataFrame, calendar: DataFrame, n: int, market: str = "NYSE") -> DataFrame:
    """Session date n trading days after (before, if negative) each ``date``; a date without a session counts
    from the session before it when going forward and from the one after when going back."""
    from pyspark.sql import Window

    from tidemark.plans.blocks import asof

    days = calendar.filter(F.col("market") == market).select("session_date")
    # One market's calendar: about 250 rows a year, so one window task is fine.
    ranked = days.select("session_date", F.row_number().over(Window.orderBy("session_date")).alias("k"))
    way = 1 if n >= 0 else -1
    start = ranked.select(F.lit(market).alias("_market"), (way * F.unix_date("session_date")).alias("_from"), "k")
    known = dates.filter(F.col("date").isNotNull()).withColumns({"_market": F.lit(market), "_at": way * F.unix_date(F.col("date").cast("date"))})
    placed = asof(known, start, ["_market"], "_at", "_from", width=3650)
    target = ranked.select((F.col("k") - n).alias("k"), F.col("session_date").alias("shifted"))
    out = placed.join(target, "k", "left").select(*dates.columns, "shifted")
    return out.unionByName(dates.filter(F.col("date").isNull()), allowMissingColumns=True)


def futures_closed(ts: Column) -> Column:
    """Weekend and the 17:00-18:00 New York maintenance hour: Friday 17:00 to Sunday 18:00."""
    at = local(ts)
    wd, hour = F.weekday(at), F.hour(at)
    return (wd == 5) | ((wd == 4) & (hour >= 17)) | ((wd == 6) & (hour < 18)) | (hour == 17)
