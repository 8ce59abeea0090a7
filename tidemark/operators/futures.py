"""Futures: roll rules, roll schedules, continuous series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.symbols import build_contract
from tidemark.operators.joins import interval_join

# Business days before the anchor date on which a root rolls, the anchor, and contract months.
QUARTERLY = (3, 6, 9, 12)
MONTHLY = tuple(range(1, 13))
ROLL_RULES = (
    (("ES", "MES", "NQ", "MNQ", "YM", "MYM"), 8, "third_friday", QUARTERLY),
    (("GC", "MGC"), 7, "third_last_business_day", (2, 4, 6, 8, 10, 12)),
    (("SI",), 7, "third_last_business_day", (1, 3, 5, 7, 9, 12)),
    (("CL",), 5, "cl_last_trade", MONTHLY),
    (("MCL",), 5, "mcl_last_trade", MONTHLY),
    (("BRR", "MBT", "ETHUSDRR", "MET", "BTCEURRR", "EBMEUR", "EEM", "ETHEURRR"), 8, "last_friday", MONTHLY),
)


def roll_rules(spark: SparkSession) -> DataFrame:
    rows = [(root, offset, anchor, list(months)) for roots, offset, anchor, months in ROLL_RULES for root in roots]
    return spark.createDataFrame(rows, "root string, offset int, anchor string, months array<int>")


def anchor_date(anchor: Column, month: Column, holidays: Column | None = None) -> Column:
    """Anchor of a contract month (any date in it): see the rule table; unknown anchors mean the 15th."""
    before = F.date_add(F.trunc(F.add_months(month, -1), "month"), 24)
    crude = times.on_or_before_business_day(before, holidays)
    return (
        F.when(anchor == "third_friday", times.third_friday(month))
        .when(anchor == "last_friday", times.on_or_before_business_day(times.last_friday(month), holidays))
        .when(anchor == "third_last_business_day", times.third_last_business_day(month))
        .when(anchor == "cl_last_trade", times.minus_business_days(crude, 3, holidays))
        .when(anchor == "mcl_last_trade", times.minus_business_days(crude, 4, holidays))
        .otherwise(F.date_add(F.trunc(month, "month"), 14))
    )


def roll_ts(at: Column, offset: Column) -> Column:
    """Five minutes after New York midnight, ``offset`` business days before the anchor date."""
    day = F.when(offset > 0, times.minus_business_days(at, offset)).otherwise(at)
    return times.to_utc(F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + 300_000_000))


def roll_schedule(rules: DataFrame, start, end, year_digits: int = 2, holidays: Column | None = None) -> DataFrame:
    """(root, contract, start_ts, end_ts): the contract to hold from one roll to the next, for all rolls that
    touch [start, end]. The grid is roots x months: a few hundred rows a decade per root."""
    first = F.add_months(F.trunc(F.lit(start).cast("date"), "month"), -14)
    last = F.add_months(F.trunc(F.lit(end).cast("date"), "month"), 14)
    grid = rules.withColumn("month", F.explode(F.sequence(first, last, F.expr("interval 1 month"))))
    grid = grid.filter(F.array_contains("months", F.month("month"))).withColumn("_at", anchor_date(F.col("anchor"), F.col("month"), holidays))
    grid = grid.select(
        "root",
        build_contract(F.col("root"), F.year("month"), F.month("month"), year_digits).alias("contract"),
        roll_ts(F.col("_at"), F.col("offset")).alias("end_ts"),
    )
    w = Window.partitionBy("root").orderBy("end_ts")
    spans = grid.withColumn("start_ts", F.lag("end_ts").over(w)).filter(F.col("start_ts").isNotNull())
    inside = (F.col("end_ts") > F.lit(start).cast("timestamp")) & (F.col("start_ts") <= F.lit(end).cast("timestamp"))
    return spans.filter(inside).select("root", "contract", "start_ts", "end_ts")


def contracts_in_range(schedule: DataFrame, start, end) -> DataFrame:
    inside = (F.col("end_ts") > F.lit(start).cast("timestamp")) & (F.col("start_ts") <= F.lit(end).cast("timestamp"))
    return schedule.filter(inside).select("root", "contract").distinct()


def stitch(bars: DataFrame, schedule: DataFrame) -> DataFrame:
    """Continuous series: bars of (root, contract) kept while their contract is the one held; no match means no
    row (never the unfiltered frame)."""
    return interval_join(bars, schedule, ["root", "contract"]).drop("start_ts", "end_ts")


def mid_month_contract(day: Column) -> Column:
    """Quarterly contract when no rule is known: rolls on the 15th of March, June, September and December.
    struct(year, month)."""
    y, m, past = F.year(day), F.month(day), F.dayofmonth(day) >= 15
    quarter = (F.ceil(m / 3) * 3).cast("int")
    month = quarter + F.when((m == quarter) & past, 3).otherwise(0)
    return F.struct(
        (y + F.when(month > 12, 1).otherwise(0)).cast("int").alias("year"),
        F.when(month > 12, 3).otherwise(month).cast("int").alias("month"),
    )


def front_expiry(day: Column) -> Column:
    """Third Friday of the quarter month, the next one's from that day on."""
    ahead = F.pmod(F.lit(0) - F.month(day), F.lit(3)).cast("int")
    this = times.third_friday(F.add_months(F.trunc(day, "month"), ahead))
    following = times.third_friday(F.add_months(F.trunc(day, "month"), ahead + 3))
    return F.when(day >= this, following).otherwise(this)
