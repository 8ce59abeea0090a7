"""Bringing provider frames into canonical bars: names, times, bad rows, gaps, spikes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.money import positive
from tidemark.functions.times import MARKET_ZONE, date_ms_to_ts, epoch_to_ts, local, minute_of_day, to_utc
from tidemark.plans.blocks import BARS, TICKS, Axis, latest_by, rolling, scan, shift

OHLC = ("open", "high", "low", "close")
QUOTE = ("bid", "ask", "bid_size", "ask_size")

# Provider spellings of the canonical columns (compared in lower case, blanks as "_").
ALIASES = {
    "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume",
    "datetime": "ts", "timestamp": "ts", "time": "ts", "date": "ts", "t": "ts",
    "adj_close": "adj_close", "dividends": "dividend", "stock_splits": "stock_splits", "symbol": "asset",
}
KNOWN = ("asset", "ts", *OHLC, "volume", "dividend", "stock_splits", "missing", *QUOTE)


def normalize_columns(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """Lower-case names and apply the alias map; the first column to claim a name keeps it."""
    names: list[str] = []
    for c in df.columns:
        plain = c.strip().lower().replace(" ", "_")
        new = aliases.get(plain, plain)
        names.append(new if new not in names else plain if plain not in names else c)
    return df.toDF(*names)


def required_columns(df: DataFrame, wanted: Sequence[str] = KNOWN) -> DataFrame:
    return df.select(*[c for c in wanted if c in df.columns])


def assemble_ts(df: DataFrame, zone: str = MARKET_ZONE) -> DataFrame:
    """A UTC ``ts`` from date + ms_of_day, from an integer epoch, or from text in ``zone``."""
    if {"date", "ms_of_day"} <= set(df.columns):
        return df.withColumn("ts", date_ms_to_ts(F.col("date"), F.col("ms_of_day"), zone)).drop("date", "ms_of_day")
    kind = df.schema["ts"].dataType
    if isinstance(kind, T.IntegralType):
        return df.withColumn("ts", epoch_to_ts(F.col("ts")))
    if isinstance(kind, (T.StringType, T.DateType)):
        return df.withColumn("ts", to_utc(F.col("ts").cast("timestamp"), zone))
    return df


def localize(df: DataFrame, zone: str = MARKET_ZONE, into: str = "local_ts") -> DataFrame:
    return df.withColumn(into, local(F.col("ts"), zone))


def trim(
    df: DataFrame, start=None, end=None, minutes: tuple[int, int] | None = None, zone: str = MARKET_ZONE
) -> DataFrame:
    """Rows in [start, end] and, for intraday data, between two local minutes of the day (inclusive)."""
    if start is not None:
        df = df.filter(F.col("ts") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("ts") <= F.lit(end))
    if minutes is not None:
        df = df.filter(minute_of_day(local(F.col("ts"), zone)).between(*minutes))
    return df


def _all_zero() -> Column:
    out = F.lit(True)
    for c in OHLC:
        out = out & (F.coalesce(F.col(c), F.lit(0.0)) == 0)
    return out


def drop_bad_rows(df: DataFrame, is_option: Column | None = None) -> DataFrame:
    """Drop all-zero bars without a quote (options become placeholders), untraded rows (``count`` = 0) and
    rows with neither bid nor ask."""
    cols = set(df.columns)
    quoted = F.lit(False)
    if {"bid", "ask"} <= cols:
        quoted = (F.coalesce("bid", F.lit(0.0)) > 0) | (F.coalesce("ask", F.lit(0.0)) > 0)
    option = is_option if is_option is not None else F.lit(False)
    if set(OHLC) <= cols:
        old = F.coalesce(F.col("missing"), F.lit(False)) if "missing" in cols else F.lit(False)
        df = df.withColumn("missing", old | (_all_zero() & ~quoted & option)).filter(~_all_zero() | quoted | option)
        if "count" in cols:
            df = df.filter((F.col("count") > 0) | F.col("missing") | quoted)
    elif {"bid", "ask"} <= cols:
        df = df.filter(quoted)
    return df


def executable_rows(df: DataFrame, ax: Axis = BARS, rank: Column | None = None) -> DataFrame:
    """Rows one may trade on: not missing, numeric OHLC present, volume null -> 0, one row per timestamp
    (the highest rank, by default the highest volume and close)."""
    typed = df.withColumns({c: F.col(c).try_cast("double") for c in (*OHLC, "volume")})
    if "missing" in df.columns:
        typed = typed.filter(~F.coalesce(F.col("missing"), F.lit(False)))
    typed = typed.dropna(subset=list(OHLC)).fillna(0.0, ["volume"])
    rank = rank if rank is not None else F.struct("volume", "close", "open", "high", "low")
    return latest_by(typed, [*ax.keys, ax.ts], rank)


def repair(
    bars: DataFrame, grid: DataFrame, session_gap_minutes: int = 120, flat: bool = False, ax: Axis = BARS
) -> DataFrame:
    """Lay bars onto a trading index and fill forward.

    An inserted row repeats the bar before it (``flat``: its close in all four prices and volume 0). Cells that
    are still empty take the last close, volume 0. Quotes carry forward only while no pause of the index
    exceeds ``session_gap_minutes``. Stamps off the index feed the fill but are not returned.
    """
    keys, cols = list(ax.keys), [c for c in (*OHLC, "volume", *QUOTE) if c in bars.columns]
    quotes = [c for c in QUOTE if c in cols]
    both = (
        grid.select(*keys, "ts", F.lit(True).alias("_on"))
        .unionByName(bars.select(*keys, "ts", *cols, F.lit(True).alias("_bar")), allowMissingColumns=True)
        .groupBy(*keys, "ts")
        .agg(F.max("_on").alias("_on"), F.max("_bar").alias("_bar"), *[F.max(c).alias(c) for c in cols])
    )
    gap = scan(both, ax, {"_prev": ("last", F.when(F.col("_on"), F.col("ts")))}, exclusive=True)
    wide = F.unix_micros("ts") - F.unix_micros("_prev") > session_gap_minutes * 60_000_000
    # The last quote counts only if it was seen after the last wide pause.
    gap = gap.withColumn("_start", F.when(F.col("_on") & (F.col("_prev").isNull() | wide), F.col("ts")))
    outs = {
        "_close": ("last", F.col("close")),
        "_session": ("last", F.col("_start")),
        "_row": ("last", F.when(F.col("_bar"), F.struct("ts", *OHLC, "volume"))),
    }
    for c in quotes:
        outs[f"_q_{c}"] = ("last", F.when(F.col(c).isNotNull(), F.struct("ts", F.col(c).alias("v"))))
    done = scan(gap, ax, outs).filter(F.col("_on"))
    copied = F.lit(not flat) | (F.col("_row")["ts"] == F.col("ts"))
    fresh = {
        c: F.when(F.col(f"_q_{c}")["ts"] >= F.col("_session"), F.col(f"_q_{c}")["v"]).alias(c) for c in quotes
    }
    return done.select(
        *keys,
        "ts",
        *[F.coalesce(F.when(copied, F.col("_row")[c]), F.col("_close")).alias(c) for c in OHLC],
        F.coalesce(F.when(copied, F.col("_row")["volume"]), F.lit(0.0)).alias("volume"),
        *fresh.values(),
    )


def grid_fill(bars: DataFrame, grid: DataFrame, leading: bool = False, ax: Axis = BARS) -> DataFrame:
    """Add missing index rows: volume 0, open, high, low and close from the last close. ``leading`` also
    fills rows before the first bar from its open; that looks ahead, so it is off by default."""
    done = repair(bars.select(*ax.keys, "ts", *OHLC, "volume"), grid, flat=True, ax=ax)
    if not leading:
        return done
    first = bars.groupBy(*ax.keys).agg(F.min_by("open", "ts").alias("_first"))
    filled = done.join(first, list(ax.keys), "left")
    return filled.withColumns({c: F.coalesce(F.col(c), F.col("_first")) for c in OHLC}).drop("_first")


def fill_voids(df: DataFrame, step_us: int, end: Column | None = None, ax: Axis = BARS) -> DataFrame:
    """Repeat each row every ``step_us`` until the next one (or ``end``)."""
    nxt = shift(df, ax, {"_next": (1, F.col(ax.ts))})
    stop = F.coalesce(F.unix_micros("_next") - 1, F.unix_micros(end) if end is not None else F.unix_micros(ax.ts))
    start = F.unix_micros(ax.ts)
    grid = F.transform(F.sequence(start, F.greatest(start, stop), F.lit(step_us)), F.timestamp_micros)
    return nxt.withColumn(ax.ts, F.explode(grid)).drop("_next")


def daily_with_limited_fill(bars: DataFrame, days: int = 3, ax: Axis = BARS) -> DataFrame:
    """One row per calendar day of a series: up to ``days`` missing days repeat the last close with no
    volume; days in longer gaps stay null and are flagged ``missing``."""
    keys = list(ax.keys)
    daily = bars.withColumn("day", F.to_date("ts")).select(*keys, "day", *OHLC, "volume").filter(F.col("day").isNotNull())
    dax = Axis(ax.keys, "day", width=ax.width, measured=False)
    seen = F.when(F.col("close").isNotNull(), F.struct("day", "close"))
    # Each bar brings along the empty days up to the next one, so the calendar is neither joined nor exchanged.
    told = scan(daily, dax, {"_seen": ("last", seen), "_next": ("next", F.col("day"))})
    ahead = F.coalesce(F.datediff("_next", "day"), F.lit(1))
    told = told.withColumn("_ahead", F.explode(F.sequence(F.lit(0), F.greatest(ahead, F.lit(1)) - 1)))
    real = F.col("_ahead") == 0
    done = told.select(
        *keys, F.date_add("day", F.col("_ahead")).alias("day"), *[F.when(real, F.col(c)).alias(c) for c in (*OHLC, "volume")], "_seen"
    )
    fill = F.when(F.datediff(F.col("day"), F.col("_seen")["day"]) <= days, F.col("_seen")["close"])
    gap = F.col("close").isNull()
    return done.select(
        *keys,
        "day",
        *[F.coalesce(F.col(c), fill).alias(c) for c in OHLC],
        F.when(gap & fill.isNotNull(), 0.0).otherwise(F.col("volume")).alias("volume"),
        (gap & fill.isNull()).alias("missing"),
    )


def retime_to_close(bars: DataFrame, hour: int = 16, zone: str = MARKET_ZONE, ax: Axis = BARS) -> DataFrame:
    """Stamp daily bars at the local session close; the latest original stamp of a day wins."""
    day = F.date_trunc("day", local(F.col("ts"), zone))
    stamp = to_utc(F.timestamp_micros(F.unix_micros(day) + hour * 3_600_000_000), zone)
    moved = bars.withColumn("_at", F.col("ts")).withColumn("ts", stamp)
    return latest_by(moved, [*ax.keys, "ts"], F.col("_at")).drop("_at")


def add_placeholders(bars: DataFrame, wanted: DataFrame, ax: Axis = BARS) -> DataFrame:
    """Union rows flagged ``missing`` for the wanted (key, ts) pairs that no bar covers."""
    keys = [*ax.keys, "ts"]
    lacking = wanted.select(*keys).distinct().join(bars.select(*keys), keys, "left_anti")
    flagged = bars if "missing" in bars.columns else bars.withColumn("missing", F.lit(False))
    return flagged.unionByName(lacking.withColumn("missing", F.lit(True)), allowMissingColumns=True)


def drop_placeholders(bars: DataFrame, ax: Axis = BARS) -> DataFrame:
    """Remove placeholders of stamps that a real row covers by now."""
    real = ~F.coalesce(F.col("missing"), F.lit(False))
    keys = [*ax.keys, "ts"]
    return bars.filter(real).unionByName(bars.filter(~real).join(bars.filter(real).select(*keys), keys, "left_anti"))


# Split-like factors and tolerances of the spike test.
SPIKE_FACTORS = (2.0, 3.0, 4.0, 5.0, 10.0)
SPIKE_TOLERANCE = 0.25
LEVEL_TOLERANCE = 0.35


def repair_split_spikes(bars: DataFrame, ax: Axis = BARS) -> DataFrame:
    """Rescale one-day spikes that look like an unadjusted split.

    A day counts when its close is about 2, 3, 4, 5 or 10 times (or a fraction of) the day before, the next
    close is back near the day before, and all but one of the usable OHLC ratios show the same factor. The
    last day of a series has no next close: it needs a stable level instead (the close before within 35% of
    the median of up to six earlier closes, three at least). Neighbours are the original values.
    """
    box = F.struct(*OHLC)
    near = lambda v, t: F.abs(v - t) <= t * SPIKE_TOLERANCE
    ok = lambda a, b: (a > 0) & (b > 0)

    linked = shift(bars, ax, {"_p": (-1, box), "_n": (1, box)})
    stable = rolling(
        linked,
        ax,
        6,
        lambda w, rn: {
            "_med": F.percentile("close", F.lit(0.5)).over(w.rowsBetween(-6, -1)),
            "_cnt": F.count("close").over(w.rowsBetween(-6, -1)),
        },
        block_rows=20_000,
    )
    prev, cur, nxt = F.col("_p")["close"], F.col("close"), F.col("_n")["close"]
    back = ok(prev, nxt) & near(nxt / prev, 1.0)
    level = (F.col("_cnt") >= 3) & (F.col("_med") > 0) & (F.abs(prev / F.col("_med") - 1) <= LEVEL_TOLERANCE)
    usable = ok(prev, cur) & F.when(F.col("_n").isNotNull(), back).otherwise(level)

    def same_factor(factor: float, up: bool) -> Column:
        ratios = [
            F.when(ok(F.col("_p")[c], F.col(c)), F.col(c) / F.col("_p")[c] if up else F.col("_p")[c] / F.col(c))
            for c in OHLC
        ]
        zero = F.lit(0)
        count = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in ratios), zero)
        hits = sum((F.when(near(r, factor), 1).otherwise(0) for r in ratios), zero)
        return (count >= 2) & (hits >= F.greatest(F.lit(2), count - 1))

    scale = None
    for f in SPIKE_FACTORS:
        for up in (True, False):
            cond = usable & near(cur / prev if up else prev / cur, f) & same_factor(f, up)
            value = F.lit(1 / f if up else f)
            scale = F.when(cond, value) if scale is None else scale.when(cond, value)
    scale = F.coalesce(scale, F.lit(1.0))
    cols = [c for c in (*OHLC, "bid", "ask", "last", "vwap") if c in bars.columns]
    out = stable.withColumn("_scale", scale)
    return out.withColumns({c: F.col(c) * F.col("_scale") for c in cols}).drop("_p", "_n", "_med", "_cnt", "_scale")


def derive_quotes(ask_bars: DataFrame, mid_bars: DataFrame, ax: Axis = BARS) -> DataFrame:
    """bid = 2*mid - ask from two close series; an inverted or non-positive side becomes mid, and both are
    null where mid is not positive."""
    keys = [*ax.keys, "ts"]
    both = ask_bars.select(*keys, F.col("close").alias("_ask")).join(
        mid_bars.select(*keys, F.col("close").alias("_mid")), keys
    )
    m, a = F.col("_mid"), F.col("_ask")
    b = 2 * m - a
    fine = (a > 0) & (b > 0) & (b <= a)
    return both.select(
        *keys,
        F.when(m > 0, F.when(fine, b).otherwise(m)).alias("bid"),
        F.when(m > 0, F.when(fine, a).otherwise(m)).alias("ask"),
    )


def null_non_positive(df: DataFrame, cols: Sequence[str] = (*OHLC, "bid", "ask")) -> DataFrame:
    return df.withColumns({c: positive(F.col(c)) for c in cols if c in df.columns})


def auto_adjust(df: DataFrame, back: bool = True) -> DataFrame:
    """Use adjusted prices in place of the raw ones (``back=False``: drop them)."""
    if not back or "adj_close" not in df.columns:
        return df.drop("adj_open", "adj_high", "adj_low", "adj_close")
    ratio = F.col("adj_close") / F.col("close")
    adjusted = {
        c: F.col(f"adj_{c}") if f"adj_{c}" in df.columns else F.col(c) * ratio for c in ("open", "high", "low")
    }
    out = df.withColumns({**adjusted, "close": F.col("adj_close")})
    return out.drop("adj_open", "adj_high", "adj_low", "adj_close")


def pick_assets(df: DataFrame, assets: DataFrame, on: Sequence[str] = ("symbol", "asset_type")) -> DataFrame:
    """Rows of the wanted assets; a wanted row with a null field matches any value of it."""
    cond = F.lit(True)
    for c in on:
        cond = cond & (F.col(f"w.{c}").isNull() | (F.col(f"d.{c}") == F.col(f"w.{c}")))
    first = on[0]
    cond = cond & (F.col(f"d.{first}") == F.col(f"w.{first}"))
    return df.alias("d").join(assets.alias("w"), cond, "left_semi")


def deduplicate(df: DataFrame, keys: Sequence[str], order: Column, keep: str = "last") -> DataFrame:
    """One row per key, the first or last in a unique order. Keys may be exact stamps or calendar days."""
    return latest_by(df, keys, order, newest=keep == "last")


def is_daily(df: DataFrame, zone: str = "UTC", ax: Axis = BARS) -> DataFrame:
    at = local(F.col("ts"), zone)
    return df.groupBy(*ax.keys).agg(F.bool_and(F.date_trunc("day", at) == at).alias("is_daily"))


def blank_zero_bars(df: DataFrame) -> DataFrame:
    """All-zero stock or index bars become null prices with volume 0, flagged ``missing``."""
    zero = _all_zero()
    old = F.coalesce(F.col("missing"), F.lit(False)) if "missing" in df.columns else F.lit(False)
    flagged = df.withColumn("_z", zero)
    return flagged.withColumns(
        {
            **{c: F.when(~F.col("_z"), F.col(c)) for c in OHLC},
            "volume": F.when(F.col("_z"), 0.0).otherwise(F.col("volume")),
            "missing": old | F.col("_z"),
        }
    ).drop("_z")


def session_ids(df: DataFrame, gap_minutes: int = 120, ax: Axis = TICKS) -> DataFrame:
    """Number the sessions of a series: a new one starts after a pause longer than ``gap_minutes``."""
    prev = shift(df, ax, {"_prev": (-1, F.col(ax.ts))})
    wide = (F.unix_micros(ax.ts) - F.unix_micros("_prev")) > gap_minutes * 60_000_000
    new = F.when(F.col("_prev").isNull() | wide, 1).otherwise(0).cast("long")
    return scan(prev.withColumn("_new", new), ax, {"session_id": ("sum", F.col("_new"))}).drop("_prev", "_new")


def session_fill(df: DataFrame, cols: Sequence[str], gap_minutes: int = 120, ax: Axis = TICKS) -> DataFrame:
    """Fill columns forward, but never across a pause longer than ``gap_minutes`` (120 for minute data, 240
    for hourly; use a plain ``scan`` for days)."""
    prev = shift(df, ax, {"_prev": (-1, F.col(ax.ts))})
    wide = (F.unix_micros(ax.ts) - F.unix_micros("_prev")) > gap_minutes * 60_000_000
    begun = prev.withColumn("_start", F.when(F.col("_prev").isNull() | wide, F.col(ax.ts)))
    outs = {"_session": ("last", F.col("_start"))}
    for c in cols:
        outs[f"_f_{c}"] = ("last", F.when(F.col(c).isNotNull(), F.struct(F.col(ax.ts).alias("t"), F.col(c).alias("v"))))
    done = scan(begun, ax, outs)
    fresh = {c: F.when(F.col(f"_f_{c}")["t"] >= F.col("_session"), F.col(f"_f_{c}")["v"]) for c in cols}
    return done.withColumns(fresh).drop("_prev", "_start", "_session", *[f"_f_{c}" for c in cols])


def gaps(df: DataFrame, over_us: int, ax: Axis = TICKS) -> DataFrame:
    """Pauses longer than ``over_us`` between neighbouring rows."""
    prev = shift(df, ax, {"_prev": (-1, F.col(ax.ts))})
    wait = F.unix_micros(ax.ts) - F.unix_micros("_prev")
    return prev.filter(wait > over_us).select(
        *ax.keys, F.col("_prev").alias("gap_start"), F.col(ax.ts).alias("gap_end"), wait.alias("gap_us")
    )


