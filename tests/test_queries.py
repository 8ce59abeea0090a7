"""Registered queries against their SQL twins at the smallest scale (TIDEMARK_ALL=1 for every one)."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "ohlcv_5min", "multi_timeframe", "performance_summary", "rolling_indicators", "macd", "repaired_bars", "asof_quotes", "missing_windows",
    "split_adjusted", "greeks_gk", "matched_orders", "fifo_lots", "portfolio_value", "rebalance_orders", "income_statement", "filing_sections", "stream_minute_bars",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def test_names_line_up():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.oracle_sql()) if os.environ.get("TIDEMARK_ALL") else SAMPLE)
def test_query(spark, con, name):
    from scripts.check_oracles import rows_of

    df = entry.queries()[name](spark, SF)
    res = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert rows_of(df.columns, df.collect()) == rows_of(names, res.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
