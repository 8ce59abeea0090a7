"""What is in the store, what is missing, and audits of runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import DAY, Axis, asof, scan, settle

RANGES = Axis(("asset",), "start_ts", ("end_us",), width=3650 * DAY, measured=False)


def merge_ranges(ranges: DataFrame, unit_us: int, ax: Axis = RANGES) -> DataFrame:
    """Merge (start_ts, end_ts) ranges of a key that overlap or lie at most one unit apart."""
    rows = ranges.withColumn("end_us", F.unix_micros("end_ts"))
    seen = scan(rows, ax, {"_reach": ("max", F.col("end_us"))}, exclusive=True)
    apart = F.col("_reach").isNull() | (F.unix_micros("start_ts") > F.col("_reach") + unit_us)
    tagged = scan(seen.withColumn("_new", F.when(apart, 1).otherwise(0).cast("long")), ax, {"_isle": ("sum", F.col("_new"))})
    return (
        tagged.groupBy(*ax.keys, "_isle")
        .agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"))
        .drop("_isle")
    )


def missing_windows(requests: DataFrame, ranges: DataFrame, unit_us: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Parts of each requested (start_ts, end_ts) no range covers; neighbours are one unit away.

    The holes between merged ranges (open-ended at both sides) are numbered per key. Two as-of lookups give
    the first and last hole a request touches, and it is joined to just those.
    """
    keys = list(keys)
    merged = merge_ranges(ranges, unit_us, Axis(tuple(keys), "start_ts", ("end_us",), RANGES.width, measured=False))
    ax = Axis(tuple(keys), "start_ts", width=RANGES.width, measured=False)
    linked = scan(
        merged, ax, {"_next": ("next", F.col("start_ts")), "_prev": ("prev", F.col("start_ts")), "_n": ("count", F.lit(1))}
    )
    at = lambda c, n: F.unix_micros(c) + n
    lowest, highest = F.lit(-(2**62)), F.lit(2**62)
    after = F.struct(F.col("_n").alias("n"), at("end_ts", unit_us).alias("a"), F.coalesce(at("_next", -unit_us), highest).alias("b"))
    first = F.struct(F.lit(0).cast("long").alias("n"), lowest.alias("a"), at("start_ts", -unit_us).alias("b"))
    holes = linked.select(*keys, F.explode(F.when(F.col("_prev").isNull(), F.array(first, after)).otherwise(F.array(after))).alias("_h"))
    bare = requests.select(*keys).distinct().join(merged.select(*keys), keys, "left_anti")
    whole = F.struct(F.lit(0).cast("long").alias("n"), lowest.alias("a"), highest.alias("b"))
    holes = settle(holes.unionByName(bare.select(*keys, whole.alias("_h"))).select(*keys, "_h.*"))
    asked = requests.withColumns({"_s": at("start_ts", 0), "_e": at("end_ts", 0)})
    how = {"keys": keys, "right_ts": "_a", "width": RANGES.width, "measured": False}
    tag = lambda p: holes.select(*keys, F.col("a").alias("_a"), F.col("n").alias(f"_n{p}"), F.col("b").alias(f"_b{p}"))
    asked = asof(asked, tag(0), left_ts="_s", **how).drop("_a")
    asked = asof(asked, tag(1), left_ts="_e", **how).drop("_a", "_b1")
    start = F.when(F.col("_b0") >= F.col("_s"), F.col("_n0")).otherwise(F.coalesce(F.col("_n0") + 1, F.lit(0)))
    touched = asked.withColumn("_from", start).filter(F.col("_from") <= F.col("_n1"))
    spread = touched.withColumn("n", F.explode(F.sequence("_from", "_n1")))
    hit = spread.join(holes, [*keys, "n"])
    a, b = F.greatest(F.col("_s"), F.col("a")), F.least(F.col("_e"), F.col("b"))
    return hit.filter(a <= b).select(
        *requests.columns, F.timestamp_micros(a).alias("missing_start"), F.timestamp_micros(b).alias("missing_end")
    )


def chunks(ranges: DataFrame, size_us: int) -> DataFrame:
    """Cut ranges into pieces of a fixed length; the last one may be shorter."""
    starts = F.sequence(F.unix_micros("start_ts"), F.unix_micros("end_ts"), F.lit(size_us))
    spread = ranges.withColumn("_s", F.explode(starts))
    end = F.least(F.col("_s") + size_us, F.unix_micros("end_ts"))
    out = spread.withColumn("chunk_start", F.timestamp_micros("_s")).withColumn("chunk_end", F.timestamp_micros(end))
    return out.filter((F.col("chunk_start") < F.col("chunk_end")) | (F.col("start_ts") == F.col("end_ts"))).drop("_s")


def summary(rows: DataFrame, min_days: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Rows, placeholders, first and last real stamp, span in days and years, and whether it is long enough."""
    gap = F.coalesce(F.col("missing"), F.lit(False))
    real = F.when(~gap, F.col("ts"))
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(gap).alias("placeholders"),
        F.min(real).alias("first_ts"),
        F.max(real).alias("last_ts"),
    )
    days = F.datediff("last_ts", "first_ts").cast("long")
    return agg.withColumns({"span_days": days, "span_years": days / 365.25, "passes": F.coalesce(days >= min_days, F.lit(False))})


def against_request(rows: DataFrame, requests: DataFrame, tolerance_us: int, keys: Sequence[str] = ("asset",)) -> DataFrame:
    """Leading and trailing gap of each requested window beyond a tolerance."""
    keys = list(keys)
    have = rows.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b"))
    out = requests.join(have, keys, "left")
    lead = F.unix_micros("_a") - F.unix_micros("start_ts") > tolerance_us
    trail = F.unix_micros("end_ts") - F.unix_micros("_b") > tolerance_us
    none = F.col("_a").isNull()
    return out.withColumns({"leading_gap": none | lead, "trailing_gap": none | trail}).drop("_a", "_b")


def audit_trades(events: DataFrame, stale_seconds: int = 60, keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """One pass over trade events: fills, new orders, farthest fill from its bar, oldest quote, stale quotes.
    The audit columns are JSON text."""
    num = lambda path: F.get_json_object("audit", path).try_cast("double")
    fill = F.col("status") == "fill"
    age = F.when(fill, num("$.quote_age"))
    return events.groupBy(*keys).agg(
        F.count_if(fill).alias("fills"),
        F.count_if(F.col("status") == "new").alias("new_orders"),
        F.max(F.when(fill, F.abs(F.col("price") - num("$.bar_price")))).alias("max_fill_gap"),
        F.max(age).alias("max_quote_age"),
        F.count_if(age > stale_seconds).alias("stale_quotes"),
    )


def usage_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Token cost per model: cached input tokens are billed at their own price. Prices are per million."""
    per = lambda n, p: F.col(n) * F.col(p) / 1_000_000
    fresh = (F.col("input_tokens") - F.col("cached_tokens")) * F.col("input_price") / 1_000_000
    cost = fresh + per("cached_tokens", "cached_price") + per("output_tokens", "output_price")
    return (
        usage.join(prices, "model")
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("input_tokens").alias("input_tokens"),
            F.sum("output_tokens").alias("output_tokens"),
            F.sum(cost).alias("cost"),
        )
    )


def usage_totals(usage: DataFrame) -> DataFrame:
    """Calls, tokens, tool calls and latency per agent, and a total row (agent null)."""
    cols = ("input_tokens", "output_tokens", "tool_calls", "latency_ms")
    per = usage.groupBy("agent").agg(F.count(F.lit(1)).alias("calls"), *[F.sum(c).alias(c) for c in cols])
    total = per.agg(*[F.sum(c).alias(c) for c in ("calls", *cols)]).withColumn("agent", F.lit(None).cast("string"))
    return per.unionByName(total)
