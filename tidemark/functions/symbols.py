"""Option, futures and class-share symbols; order status and side vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Futures month codes, January to December.
MONTH_CODES = "FGHJKMNQUVXZ"

# Spellings of order states and their canonical form.
STATUS_ALIASES = {
    "cancelled": "canceled",
    "cancel": "canceled",
    "cash": "cash_settled",
    "expired": "expired",
    "filled": "fill",
    "partially_filled": "partial_fill",
    "pending": "open",
    "presubmitted": "new",
    "apicancelled": "canceled",
    "pendingcancel": "cancelling",
    "inactive": "error",
    "pendingsubmit": "new",
    "apipending": "new",
    "rejected": "error",
    "submit": "submitted",
    "done_for_day": "canceled",
    "replaced": "canceled",
    "stopped": "canceled",
    "suspended": "canceled",
    "pending_cancel": "canceled",
    "pending_new": "new",
    "pending_replace": "canceled",
    "pending_review": "open",
    "accepted": "open",
    "calculated": "open",
    "accepted_for_bidding": "open",
    "held": "open",
    "assignment": "assigned",
    "exercise": "exercised",
}

# Separator between root and share class, per broker; "." elsewhere.
CLASS_SEPARATORS = {
    "tradier": "/",
    "schwab": "/",
    "interactive_brokers": " ",
    "ibkr": " ",
    "alpaca": ".",
}

BUY_SIDES = ("buy", "buy_to_open", "buy_to_cover", "buy_to_close")
SELL_SIDES = ("sell", "sell_short", "sell_to_open", "sell_to_close")
# Rank of a contract that no priority list names (fixed value).
UNRANKED = 999999

_OCC = r"^(.+?)(\d{6})([CP])(\d+)$"
_CONTRACT = r"^([A-Z]+)(?:(?=\.[A-Z]\d{2}$)\.)?([FGHJKMNQUVXZ])(\d{4}|\d{2}|\d)$"
_CLASS = r"^([A-Z]{1,6})[./ ]([A-Z])$"


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def bound(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: fn(v)), F.lit(0))


def parse_occ(symbol: Column) -> Column:
    """Option symbol -> struct(root, asset_type, expiration, right, strike); anything else, an impossible date
    included, is a stock. Case and surrounding space don't count; roots and strikes may have any length."""
    symbol = F.upper(F.trim(symbol))
    day = F.try_to_date(F.concat(F.lit("20"), F.regexp_extract(symbol, _OCC, 2)), "yyyyMMdd")
    hit = symbol.rlike(_OCC) & day.isNotNull()
    part = lambda i: F.regexp_extract(symbol, _OCC, i)
    return F.struct(
        F.when(hit, part(1)).otherwise(symbol).alias("root"),
        F.when(hit, "option").otherwise("stock").alias("asset_type"),
        F.when(hit, day).alias("expiration"),
        F.when(hit & (part(3) == "C"), "CALL").when(hit, "PUT").alias("right"),
        F.when(hit, part(4).try_cast("double") / 1000).alias("strike"),
    )


def build_occ(root: Column, expiration: Column, right: Column, strike: Column) -> Column:
    thousandths = F.round(strike * 1000).cast("long").cast("string")
    return F.concat(
        root, F.date_format(expiration, "yyMMdd"), F.upper(F.substring(right, 1, 1)), F.lpad(thousandths, 8, "0")
    )


def parse_contract(symbol: Column) -> Column:
    """Futures contract -> struct(root, month_code, year_1d, year_2d, year_4d), null if it is none.

    A single year digit up to 5 means the 2020s, otherwise the 2010s.
    """
    text = F.upper(F.trim(symbol))
    year = F.regexp_extract(text, _CONTRACT, 3)
    decade = F.when(year <= "5", "2").otherwise("1")
    two = F.when(F.length(year) == 1, F.concat(decade, year)).otherwise(F.right(year, F.lit(2)))
    four = F.when(F.length(year) == 4, year).otherwise(F.concat(F.lit("20"), two))
    return F.when(
        text.rlike(_CONTRACT),
        F.struct(
            F.regexp_extract(text, _CONTRACT, 1).alias("root"),
            F.regexp_extract(text, _CONTRACT, 2).alias("month_code"),
            F.right(year, F.lit(1)).alias("year_1d"),
            two.alias("year_2d"),
            four.alias("year_4d"),
        ),
    )


def build_contract(root: Column, year: Column, month: Column, digits: int = 2) -> Column:
    code = F.substring(F.lit(MONTH_CODES), month.cast("int"), F.lit(1))
    tail = year.cast("string") if digits == 4 else F.right(year.cast("string"), F.lit(digits))
    return F.concat(root, code, tail)


def contract_variants(symbol: Column) -> Column:
    """All spellings of a contract: one, two and four year digits and the dotted form."""
    def spell(p: Column) -> Column:
        stem = F.concat(p["root"], p["month_code"])
        return F.array(
            F.concat(stem, p["year_1d"]),
            F.concat(stem, p["year_2d"]),
            F.concat(p["root"], F.lit("."), p["month_code"], p["year_2d"]),
            F.concat(stem, p["year_4d"]),
        )

    return bound(parse_contract(symbol), spell)


def matches_root(symbol: Column, root: Column) -> Column:
    return F.coalesce(
        (F.upper(symbol) == F.upper(root)) | (parse_contract(symbol)["root"] == F.upper(root)), F.lit(False)
    )


def contract_priority(symbol: Column, ranked: Column) -> Column:
    """0-based place of a contract in a priority array, in any spelling."""
    exact = F.array_position(ranked, symbol)
    spelled = F.transform(contract_variants(symbol), lambda v: F.array_position(ranked, v))
    best = F.array_min(F.filter(spelled, lambda p: p > 0))
    place = F.when(exact > 0, exact).otherwise(best)
    return F.coalesce(place - 1, F.lit(UNRANKED).cast("long"))


def class_share(symbol: Column, separator: str = ".") -> Column:
    """BRK/B, BRK B and BRK.B in one spelling."""
    text = F.upper(F.trim(symbol))
    return F.regexp_replace(text, _CLASS, f"$1{separator}$2")


def class_share_for(symbol: Column, broker: Column) -> Column:
    text = F.upper(F.trim(symbol))
    sep = F.coalesce(_lookup(CLASS_SEPARATORS, F.lower(F.trim(broker))), F.lit("."))
    return F.when(
        text.rlike(_CLASS),
        F.concat(F.regexp_extract(text, _CLASS, 1), sep, F.regexp_extract(text, _CLASS, 2)),
    ).otherwise(text)


def order_status(status: Column) -> Column:
    text = F.lower(F.trim(status))
    return F.coalesce(_lookup(STATUS_ALIASES, text), text)


def same_status(a: Column, b: Column) -> Column:
    return order_status(a) == order_status(b)


def side_sign(side: Column) -> Column:
    text = F.lower(side)
    return F.when(text.isin(*BUY_SIDES), 1).when(text.isin(*SELL_SIDES), -1)
