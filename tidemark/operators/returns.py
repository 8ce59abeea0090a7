"""Returns, drawdowns, performance statistics, ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import BARS, DAY, Axis, asof, scan, shift, trailing

CURVE = Axis(("run_id",), width=365 * DAY, measured=False)


def simple_returns(bars: DataFrame, ax: Axis = BARS) -> DataFrame:
    """price_change, and total return with the dividend yield if dividends are there; null in the first row."""
    out = shift(bars, ax, {"_prev": (-1, F.col("close"))})
    change = F.col("close") / F.col("_prev") - 1
    out = out.withColumn("price_change", change)
    if "dividend" in bars.columns:
        out = out.withColumn("dividend_yield", F.col("dividend") / F.col("close"))
        return out.withColumn("return", F.col("dividend_yield") + F.col("price_change")).drop("_prev")
    return out.withColumn("return", F.col("price_change")).drop("_prev")


def cumulative(rows: DataFrame, ret: str = "return", out: str = "cum", ax: Axis = CURVE) -> DataFrame:
    """Running product of 1+r; a product, not a sum of logs, so r <= -1 works."""
    return scan(rows, ax, {out: ("prod", 1 + F.col(ret))})


def drawdown(rows: DataFrame, value: str = "cum", ax: Axis = CURVE) -> DataFrame:
    """Running high and the fall below it: absolute, share of the high, and the signed form value/high - 1."""
    out = scan(rows, ax, {"hwm": ("max", F.col(value))})
    fall = F.col("hwm") - F.col(value)
    return out.withColumns({"dd_abs": fall, "dd_pct": fall / F.col("hwm"), "dd": F.col(value) / F.col("hwm") - 1})


def drawdown_episodes(rows: DataFrame, value: str = "cum", ax: Axis = CURVE) -> DataFrame:
    """One row per stretch below an earlier high: first and last stamp below it, valley, length, depth."""
    low = drawdown(rows, value, ax)
    peak = F.when(F.col(value) >= F.col("hwm"), 1).otherwise(0).cast("long")
    tagged = scan(low.withColumn("_peak", peak), ax, {"_epi": ("sum", F.col("_peak"))})
    return (
        tagged.filter(F.col("dd_pct") > 0)
        .groupBy(*ax.keys, "_epi")
        .agg(
            F.min(ax.ts).alias("start"),
            F.max_by(ax.ts, F.struct("dd_pct", -F.unix_micros(ax.ts))).alias("valley"),
            F.max(ax.ts).alias("end"),
            F.max("dd_pct").alias("depth"),
        )
        .withColumn("days", (F.datediff("end", "start") + 1).cast("long"))
        .drop("_epi")
    )


def performance(rows: DataFrame, ret: str = "return", risk_free: float = 0.0, ax: Axis = CURVE) -> DataFrame:
    """Total return, CAGR, volatility, Sharpe ratio, greatest drawdown with its first date, RoMaD per run.

    Years are whole days / 365.25; a zero span gives 0 for CAGR and volatility, no volatility 0 for Sharpe,
    no drawdown 0 for RoMaD.
    """
    curve = drawdown(cumulative(rows, ret, "_cum", ax), "_cum", ax)
    t = F.col(ax.ts)
    base = curve.groupBy(*ax.keys).agg(
        F.product(1 + F.col(ret)).alias("_growth"),
        F.stddev_samp(ret).alias("_sd"),
        F.count(ret).alias("_n"),
        F.min(t).alias("_a"),
        F.max(t).alias("_b"),
        F.max("dd_pct").alias("_mdd"),
        F.max_by(t, F.when(F.col("dd_pct").isNotNull(), F.struct("dd_pct", -F.unix_micros(t)))).alias("_mdd_ts"),
    )
    years = F.floor((F.unix_micros("_b") - F.unix_micros("_a")) / DAY) / 365.25
    growth = F.coalesce("_growth", F.lit(1.0))
    step = base.withColumns({"_y": years, "total_return": growth - 1})
    step = step.withColumns(
        {
            "cagr": F.when(F.col("_y") > 0, F.pow(F.col("total_return") + 1, 1 / F.col("_y")) - 1).otherwise(0.0),
            "volatility": F.when(F.col("_y") > 0, F.coalesce(F.col("_sd") * F.sqrt(F.col("_n") / F.col("_y")), F.lit(0.0))).otherwise(0.0),
            "max_drawdown": F.coalesce("_mdd", F.lit(0.0)),
        }
    )
    safe = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    return step.select(
        *ax.keys,
        "total_return",
        "cagr",
        "volatility",
        safe(F.col("cagr") - risk_free, F.col("volatility")).alias("sharpe"),
        "max_drawdown",
        F.col("_mdd_ts").alias("max_drawdown_ts"),
        safe(F.col("cagr"), F.col("max_drawdown")).alias("romad"),
    )


def period_flows(rows: DataFrame, total: str, out: str = "flow", ax: Axis = CURVE) -> DataFrame:
    """Cumulative totals to flows per row: filled forward, differenced, the first one as it is."""
    filled = scan(rows, ax, {"_tot": ("last", F.col(total))}).withColumn("_tot", F.coalesce("_tot", F.lit(0.0)))
    prev = shift(filled, ax, {"_was": (-1, F.col("_tot"))})
    return prev.withColumn(out, F.col("_tot") - F.coalesce("_was", F.lit(0.0))).drop("_tot", "_was")


def flow_adjusted_returns(rows: DataFrame, value: str, flow: str, ax: Axis = CURVE) -> DataFrame:
    prev = shift(rows, ax, {"_was": (-1, F.col(value))})
    ret = (F.col(value) - F.col("_was") - F.coalesce(flow, F.lit(0.0))) / F.nullif("_was", F.lit(0.0))
    return prev.withColumn("return", ret).drop("_was")


def cash_adjusted_curve(rows: DataFrame, value: str, total: str, ax: Axis = CURVE) -> DataFrame:
    """The curve as if no external cash had moved: (first value - first flow) * running product of 1+r."""
    flows = flow_adjusted_returns(period_flows(rows, total, "_flow", ax), value, "_flow", ax)
    out = scan(
        flows,
        ax,
        {
            "_base": ("first", F.struct((F.col(value) - F.col("_flow")).alias("v"))),
            "_cum": ("prod", 1 + F.coalesce("return", F.lit(0.0))),
        },
    )
    return out.withColumn("adjusted_value", F.col("_base")["v"] * F.col("_cum")).drop("_flow", "_base", "_cum")


def daily_table(curve: DataFrame, benchmark: DataFrame | None = None, ax: Axis = CURVE) -> DataFrame:
    """Daily returns of each run (and of a benchmark priced by ``close``) on the calendar days of the run.

    The last value of a day counts; days without a row repeat the one before; the first day is measured
    from the first value seen. External flows are taken out.
    """
    keys = list(ax.keys)
    per_day = curve.groupBy(*keys, F.to_date("ts").alias("day")).agg(
        F.max_by("portfolio_value", "ts").alias("value"), F.max_by("external_flow_total", "ts").alias("total")
    )
    start = curve.groupBy(*keys).agg(
        F.min_by("portfolio_value", "ts").alias("_v0"),
        F.coalesce(F.min_by("external_flow_total", "ts"), F.lit(0.0)).alias("_f0"),
        F.to_date(F.min("ts")).alias("_a"),
        F.to_date(F.max("ts")).alias("_b"),
    )
    grid = start.select(*keys, "_v0", "_f0", F.explode(F.sequence("_a", "_b")).alias("day"))
    dax = Axis(ax.keys, "day", width=ax.width, measured=False)
    full = scan(
        grid.join(per_day, [*keys, "day"], "left"),
        dax,
        {"_v": ("last", F.col("value")), "_t": ("last", F.col("total"))},
    )
    prev = shift(full, dax, {"_pv": (-1, F.col("_v")), "_pt": (-1, F.col("_t"))})
    pv, pt = F.coalesce("_pv", "_v0"), F.coalesce("_pt", "_f0")
    flow = F.coalesce(F.col("_t"), F.lit(0.0)) - F.coalesce(pt, F.lit(0.0))
    ret = F.coalesce((F.col("_v") - pv - flow) / F.nullif(pv, F.lit(0.0)), F.lit(0.0))
    out = prev.select(*keys, "day", F.col("_v").alias("value"), ret.alias("return"))
    if benchmark is None:
        return out
    mark = benchmark.groupBy(F.to_date("ts").alias("day")).agg(F.max_by("close", "ts").alias("_c"))
    bax = Axis(("_one",), "day", width=ax.width, measured=False)
    steps = shift(mark.withColumn("_one", F.lit(1)), bax, {"_p": (-1, F.col("_c"))})
    bench = steps.select("day", (F.col("_c") / F.col("_p") - 1).alias("benchmark_return"))
    return out.join(bench, "day", "left").fillna(0.0, ["benchmark_return"])


def benchmark_comparison(daily: DataFrame, keys: Sequence[str] = ("run_id",), days_a_year: float = 365.0, risk_free: float = 0.0) -> DataFrame:
    """Each run against its benchmark, from ``daily_table`` rows with return and benchmark_return.

    Counts, means, variances and the covariance are mergeable moments: one partial aggregate, whatever a run's length. The
    first day of a run has no return and is left out. beta = covariance / variance of the benchmark; alpha is the yearly
    mean return beyond ``risk_free`` that beta doesn't explain; the tracking error is the yearly deviation of the
    difference, the information ratio its yearly mean over that; up and down capture divide mean returns on days on which
    the benchmark rose or fell. What has no variance to divide by is null.
    """
    r, b = F.col("return"), F.col("benchmark_return")
    first = daily.groupBy(*keys).agg(F.min("day").alias("_first"))
    rows = daily.join(first, list(keys)).filter(F.col("day") > F.col("_first"))
    mean = lambda x, when: F.avg(F.when(when, x))
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.avg(r).alias("_mr"), F.avg(b).alias("_mb"), F.var_pop(b).alias("_vb"), F.var_pop(r).alias("_vr"), F.covar_pop(r, b).alias("_cov"),
        F.stddev_samp(r - b).alias("_te"), F.product(1 + r).alias("_pr"), F.product(1 + b).alias("_pb"),
        mean(r, b > 0).alias("_ru"), mean(b, b > 0).alias("_bu"), mean(r, b < 0).alias("_rd"), mean(b, b < 0).alias("_bd"),
    )
    over = lambda a, c: a / F.nullif(c, F.lit(0.0))
    beta, daily_free = over(F.col("_cov"), F.col("_vb")), risk_free / days_a_year
    alpha = (F.col("_mr") - daily_free - beta * (F.col("_mb") - daily_free)) * days_a_year
    error = F.col("_te") * F.sqrt(F.lit(days_a_year))
    return m.select(
        *keys, "days", (F.col("_pr") - 1).alias("total_return"), (F.col("_pb") - 1).alias("benchmark_total_return"), over(F.col("_cov"), F.sqrt(F.col("_vr") * F.col("_vb"))).alias("correlation"), beta.alias("beta"), alpha.alias("alpha"),
        error.alias("tracking_error"), over((F.col("_mr") - F.col("_mb")) * days_a_year, error).alias("information_ratio"),
        over(F.col("_ru"), F.col("_bu")).alias("up_capture"), over(F.col("_rd"), F.col("_bd")).alias("down_capture"),
    )


def daily_from_returns(rows: DataFrame, ret: str = "return", keys: Sequence[str] = ("run_id",)) -> DataFrame:
    return rows.groupBy(*keys, F.to_date("ts").alias("day")).agg((F.product(1 + F.col(ret)) - 1).alias("return"))


def period_returns(curve: DataFrame, now: Column, ax: Axis = CURVE) -> DataFrame:
    """Return over the last 24 hours, 7 and 30 days and since inception, each from the first row inside the
    window; the 7 and 30 day figures need a history that reaches back that far."""
    t, v = F.col(ax.ts), F.col("portfolio_value")
    since = lambda days: F.when(t >= F.timestamp_micros(F.unix_micros(now) - days * DAY), t)
    known = curve.filter(t <= now)
    agg = known.groupBy(*ax.keys).agg(
        F.max_by(v, t).alias("_v"),
        F.min_by(v, t).alias("_v0"),
        F.min(t).alias("_first"),
        *[F.min_by(v, since(d)).alias(f"_v{d}") for d in (1, 7, 30)],
    )
    grew = lambda base: F.col("_v") / F.nullif(F.col(base), F.lit(0.0)) - 1
    reach = lambda d: F.col("_first") <= F.timestamp_micros(F.unix_micros(now) - d * DAY)
    return agg.select(
        *ax.keys,
        grew("_v1").alias("return_24h"),
        F.when(reach(7), grew("_v7")).alias("return_7d"),
        F.when(reach(30), grew("_v30")).alias("return_30d"),
        grew("_v0").alias("return_total"),
    )


def rank_by(rows: DataFrame, score: str, k: int, by: Sequence[str] = ("ts",), tie: str = "asset") -> DataFrame:
    """Best k rows per date by score (ties by name)."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(score), tie)
    ranked = rows.filter(F.col(score).isNotNull()).withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.filter(F.col("rank") <= k)


def percentile_of_score(rows: DataFrame, value: str, days: int, ax: Axis = BARS) -> DataFrame:
    """Percentile rank of the current value among the trailing calendar days:
    (less + not-greater + [less < not-greater]) * 50 / n. Meant for daily rows, so a frame holds about one
    row per day."""

    def build(w):
        return {"_frame": F.collect_list(value).over(w)}

    out = trailing(rows, ax, days * DAY, build)
    v = F.col(value)
    less = F.size(F.filter("_frame", lambda x: x < v))
    upto = F.size(F.filter("_frame", lambda x: x <= v))
    pct = (less + upto + F.when(upto > less, 1).otherwise(0)) * 50.0 / F.size("_frame")
    return out.withColumn("percentile", F.when(v.isNotNull(), pct)).drop("_frame")


def threshold_flags(rows: DataFrame, column: str, low: float | None = None, high: float | None = None) -> DataFrame:
    c = F.col(column)
    return rows.withColumns(
        {
            f"{column}_above_max": F.lit(False) if high is None else F.coalesce(c > high, F.lit(False)),
            f"{column}_below_min": F.lit(False) if low is None else F.coalesce(c < low, F.lit(False)),
        }
    )


def valuation_price(rows: DataFrame, price: str = "close", ax: Axis = BARS) -> DataFrame:
    """Last known positive finite price."""
    p = F.col(price)
    good = F.when((p > 0) & ~F.isnan(p) & (p != float("inf")), p)
    return scan(rows, ax, {"valuation_price": ("last", good)})


def last_price(probes: DataFrame, bars: DataFrame, daily: bool = False) -> DataFrame:
    """Price known at each probe: daily bars give their close; an intraday bar gives its close once the probe
    is past its stamp and its open exactly on it."""
    hit = asof(probes, bars.select("asset", F.col("ts").alias("bar_ts"), "open", "close"), right_ts="bar_ts")
    price = F.col("close") if daily else F.when(F.col("ts") > F.col("bar_ts"), F.col("close")).otherwise(F.col("open"))
    return hit.withColumn("last_price", price).drop("open", "close")


def latest(rows: DataFrame, keys: Sequence[str] = ("asset",), order: Sequence[str] = ("ts",)) -> DataFrame:
    from tidemark.plans.blocks import latest_by

    return latest_by(rows, keys, F.struct(*order))


def symbol_returns(bars: DataFrame, ax: Axis = BARS) -> DataFrame:
    """Returns with dividends and the growth of one unit, 1 at the first row, with its logarithm, which stays finite
    where a long series of high returns grows beyond a double; it is negative infinity once all is lost."""
    out = simple_returns(bars, ax)
    r = F.coalesce("return", F.lit(0.0))
    log = F.when(r > -1, F.log1p(r)).otherwise(float("-inf"))
    return scan(out, ax, {"growth": ("prod", 1 + r), "log_growth": ("sum", log)})
