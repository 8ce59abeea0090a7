"""Point-in-time fundamentals, filings, macro series and news: only what was known at a date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import latest_by

# Statement fields and the tags that can fill them, best first.
STATEMENT_TAGS = {
    "income": {
        "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
        "cost_of_revenue": ("CostOfRevenue", "CostOfGoodsAndServicesSold"),
        "gross_profit": ("GrossProfit",),
        "operating_income": ("OperatingIncomeLoss",),
        "net_income": ("NetIncomeLoss",),
        "eps_basic": ("EarningsPerShareBasic",),
        "eps_diluted": ("EarningsPerShareDiluted",),
    },
    "balance": {
        "assets": ("Assets",),
        "current_assets": ("AssetsCurrent",),
        "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"),
        "liabilities": ("Liabilities",),
        "current_liabilities": ("LiabilitiesCurrent",),
        "debt": ("LongTermDebtAndFinanceLeaseObligationsCurrent", "LongTermDebtCurrent", "LongTermDebt"),
        "equity": ("StockholdersEquity",),
        "shares_outstanding": ("EntityCommonStockSharesOutstanding", "CommonStocksIncludingAdditionalPaidInCapital"),
    },
    "cash_flow": {
        "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
        "capex": ("PaymentsToAcquirePropertyPlantAndEquipment",),
        "free_cash_flow_components": ("NetCashProvidedByUsedInOperatingActivities", "PaymentsToAcquirePropertyPlantAndEquipment"),
        "investing_cash_flow": ("NetCashProvidedByUsedInInvestingActivities",),
        "financing_cash_flow": ("NetCashProvidedByUsedInFinancingActivities",),
        "dividends_paid": ("PaymentsOfDividends", "PaymentsOfDividendsCommonStock"),
        "buybacks": ("PaymentsForRepurchaseOfCommonStock",),
    },
}
# Weight of a form among facts of the same dates; any other form weighs 1.
FORM_PRIORITY = {"10-K": 5, "20-F": 5, "40-F": 5, "10-Q": 4, "8-K": 2}

FACT_ORDER = ("filed", "end", "start")


def explode_facts(raw: DataFrame) -> DataFrame:
    """Company documents (entity, JSON text: taxonomy -> tag -> units -> unit -> facts) to one row per fact."""
    fact = "val double, filed string, form string, fy int, fp string, frame string, start string, end string, accn string"
    schema = f"map<string, map<string, struct<units: map<string, array<struct<{fact.replace(' ', ': ').replace(',: ', ', ')}>>>>>>"
    tags = raw.select("entity", F.explode(F.from_json("json", schema)).alias("taxonomy", "_t"))
    units = tags.select("entity", "taxonomy", F.explode("_t").alias("tag", "_u"))
    rows = units.select("entity", "taxonomy", "tag", F.explode("_u.units").alias("unit", "_f"))
    return rows.select("entity", "taxonomy", "tag", "unit", F.inline("_f")).withColumns(
        {"filed": F.to_timestamp("filed"), "start": F.to_date("start"), "end": F.to_date("end")}
    )


def known(rows: DataFrame, as_of, column: str = "filed") -> DataFrame:
    return rows.filter(F.col(column) <= F.lit(as_of))


def latest_facts(facts: DataFrame, as_of, tie: Sequence[str] = ("accn",)) -> DataFrame:
    """The fact of every (entity, tag) known at a date: the latest filed, then the latest period."""
    return latest_by(known(facts, as_of), ["entity", "tag"], F.struct("filed", "end", *tie))


def company_facts(facts: DataFrame, as_of, priority: Sequence[str], limit: int, tie: Sequence[str] = ("accn",)) -> DataFrame:
    """Up to ``limit`` latest facts per entity: the priority tags in their order, then the rest by name."""
    rows = latest_facts(facts, as_of, tie)
    place = F.array_position(F.array(*[F.lit(t) for t in priority]), F.col("tag"))
    w = Window.partitionBy("entity").orderBy(F.when(place > 0, place).otherwise(len(priority) + 1), "tag")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def form_priority(form: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in FORM_PRIORITY.items() for x in kv])
    return F.coalesce(table[F.upper(form)], F.lit(1))


def tag_table(spark: SparkSession, statement: str) -> DataFrame:
    rows = [(f, t, len(tags) - i) for f, tags in STATEMENT_TAGS[statement].items() for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "field string, tag string, tag_priority int")


def statement(facts: DataFrame, tags: DataFrame, as_of, tie: Sequence[str] = ("accn",)) -> DataFrame:
    """One statement per entity: (entity, field, tag, val, ..., matched).

    The anchor is an entity's newest candidate fact over all fields (filed, end, start, form). A field takes its
    best candidate of the anchor's filing or period; a field that has candidates but none of that period
    keeps its newest one with ``matched`` false, a warning rather than a value.
    """
    rows = known(facts, as_of).join(tags, "tag").withColumn("form_priority", form_priority(F.col("form")))
    rank = F.struct(*FACT_ORDER, "form_priority", *tie)
    anchor = rows.groupBy("entity").agg(F.max_by(F.struct("accn", "end", "start", "fy", "fp", "form"), rank).alias("_a"))
    near = rows.join(anchor, "entity")
    a = F.col("_a")
    same = (F.col("end") == a["end"])
    for c in ("start", "fy", "fp", "form"):
        same = same & (F.col(c).isNull() | a[c].isNull() | (F.col(c) == a[c]))
    matched = F.coalesce(F.col("accn") == a["accn"], F.lit(False)) | F.coalesce(same, F.lit(False))
    cols = ("tag", "val", "unit", "filed", "form", "fy", "fp", "start", "end", "accn")
    best = F.struct(F.col("_m"), F.struct(*FACT_ORDER, "form_priority", "tag_priority", *tie))
    out = near.withColumn("_m", matched).groupBy("entity", "field").agg(F.max_by(F.struct(*cols, "_m"), best).alias("_b"))
    return out.select("entity", "field", *[F.col("_b")[c].alias(c) for c in cols], F.col("_b")["_m"].alias("matched"))


def explode_filings(raw: DataFrame) -> DataFrame:
    """Parallel arrays per entity (accn, form, filed, accepted) to one row per filing."""
    z = F.arrays_zip("accn", "form", "filed", "accepted")
    return raw.select("entity", F.explode(z).alias("_z")).select("entity", "_z.*")


def list_filings(filings: DataFrame, as_of, forms: Sequence[str] | None = None, limit: int = 20) -> DataFrame:
    """The newest filings of every entity accepted (or, without a time, filed) by a date."""
    at = F.coalesce("accepted", F.col("filed").cast("timestamp"))
    rows = filings.withColumn("known_at", at).filter(F.col("known_at") <= F.lit(as_of))
    if forms:
        rows = rows.filter(F.upper("form").isin(*[f.upper() for f in forms]))
    w = Window.partitionBy("entity").orderBy(F.desc("known_at"), F.desc("accn"))
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= limit)


def series_at_vintage(obs: DataFrame, as_of, end) -> DataFrame:
    """Observations up to ``end`` in the version valid on ``as_of``."""
    day = F.lit(as_of).cast("date")
    return obs.filter((F.col("realtime_start") <= day) & (F.col("realtime_end") >= day) & (F.col("obs_date") <= F.lit(end).cast("date")))


def latest_values(obs: DataFrame) -> DataFrame:
    """Latest non-null value per series."""
    have = obs.filter(F.col("value").isNotNull())
    return latest_by(have.select("series_id", "obs_date", "value"), ["series_id"], F.struct("obs_date", "value"))


def snapshot(obs: DataFrame, series: Sequence[str]) -> DataFrame:
    """Latest values of a list of series side by side in one row."""
    rows = latest_values(obs.filter(F.col("series_id").isin(*series)))
    return rows.groupBy().agg(*[F.max(F.when(F.col("series_id") == s, F.col("value"))).alias(s) for s in series])


def catalogue(series: DataFrame, category: str | None = None) -> DataFrame:
    return series if category is None else series.filter(F.lower("category") == category.lower())


def news(items: DataFrame, as_of, start, symbols: Sequence[str] | None, limit: int, max_chars: int) -> DataFrame:
    """Newest items between start and as_of (never later) about any of the symbols; the text is shortened."""
    rows = items.filter((F.col("ts") <= F.lit(as_of)) & (F.col("ts") >= F.lit(start)))
    if symbols:
        rows = rows.filter(F.arrays_overlap("symbols", F.array(*[F.lit(s) for s in symbols])))
    cut = F.when(F.length("text") > max_chars, F.concat(F.substring("text", 1, max_chars), F.lit("..."))).otherwise(F.col("text"))
    return rows.withColumn("text", cut).orderBy(F.desc("ts"), F.desc("id")).limit(limit)
