"""Cash-event fields: direction, identity, chart marker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The kinds of cash event.
EVENT_TYPES = ("deposit", "withdrawal", "interest", "dividend", "fee", "journal", "adjustment", "tax", "other_cash")


def direction(amount: Column) -> Column:
    return F.when(amount > 0, "in").when(amount < 0, "out").otherwise("neutral")


def event_id(*fields: Column) -> Column:
    """First 24 hex digits of the SHA-256 of the fields joined by '|'; null fields count as empty."""
    text = [F.coalesce(f.cast("string"), F.lit("")) for f in fields]
    return F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 24)


def event_type(kind: Column) -> Column:
    name = F.lower(F.trim(kind))
    return F.when(name.isin(*EVENT_TYPES), name).otherwise("other_cash")


def marker(kind: Column, raw_type: Column, way: Column) -> Column:
    """Chart class of a cash event; interest is split by who pays."""
    kind, raw = event_type(kind), F.lower(F.trim(raw_type))
    credit = (raw == "cash_financing_credit") | (way == "in")
    debit = (raw == "cash_financing_debit") | (way == "out")
    return (
        F.when((kind == "interest") & credit, "financing_credit")
        .when((kind == "interest") & debit, "financing_debit")
        .otherwise(kind)
    )
