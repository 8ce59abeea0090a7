"""Stores, payloads, text, point-in-time facts, streams."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import facts, texts
from tidemark.sources import tables
from tidemark.streaming import live


def test_csv_bars(spark, tmp_path):
    p = tmp_path / "SPY.csv"
    p.write_text("Date,Open,High,Low,Close,Adj Close,Volume,Dividends,Stock Splits\n2019-01-02,245.98,251.21,245.95,250.18,231.1,126925200,0.0,0.0\n")
    r = tables.read_csv_bars(spark, str(p)).collect()[0]
    assert (r.asset, r.ts, r.close, r.volume) == ("SPY", dt.datetime(2019, 1, 2), 250.18, 126925200.0)


def test_merge_keeps_newest_and_untouched_days(spark, tmp_path):
    old = spark.createDataFrame([("A", dt.datetime(2024, 1, 1), 1.0), ("A", dt.datetime(2024, 1, 2), 2.0)], "asset string, ts timestamp, close double")
    new = spark.createDataFrame([("A", dt.datetime(2024, 1, 2), 5.0)], "asset string, ts timestamp, close double")
    tables.write_series(old, str(tmp_path / "a"))
    tables.merge_series(spark, str(tmp_path / "a"), new, str(tmp_path / "b"))
    assert sorted(r.close for r in tables.read_series(spark, str(tmp_path / "b")).collect()) == [1.0, 5.0]


def test_merge_in_place_leaves_other_days_alone(spark, tmp_path):
    days = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    kinds = "asset string, ts timestamp, close double"
    path = tmp_path / "store"
    tables.write_series(spark.createDataFrame([(a, t, float(t.day)) for a in "AB" for t in days], kinds), str(path))
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    update = [("A", days[1], 50.0), ("C", days[1] + dt.timedelta(hours=1), 51.0), ("A", dt.datetime(2024, 2, 1), 52.0)]
    tables.merge_series(spark, str(path), spark.createDataFrame(update, kinds))
    after = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    assert {p: m for p, m in before.items() if "2024-01-02" not in str(p)}.items() <= after.items()
    got = {(r.asset, r.ts): r.close for r in tables.read_series(spark, str(path)).collect()}
    assert got == {(a, t): float(t.day) for a in "AB" for t in days} | {(a, t): c for a, t, c in update}


def test_header_payload_lacks_a_column(spark):
    text = '{"header": {"format": ["a", "b"]}, "response": [["1", "x"], ["2", "y"]]}'
    out = tables.header_payload(spark.createDataFrame([(text,)], "j string"), "j", {"b": "string", "a": "int", "c": "double"}).collect()
    assert [(r.a, r.b, r.c) for r in out] == [(1, "x", None), (2, "y", None)]


def test_results_table_through_jdbc(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/results;create=true"
    opts = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    df = spark.createDataFrame([(1, 2.5), (2, 3.5)], "id int, v double")
    tables.write_results(df, url, "stats", **opts)
    tables.write_results(df, url, "stats", **opts)
    assert tables.read_results(spark, url, "stats", **opts).count() == 4


def test_only_select_is_let_through(spark):
    with pytest.raises(ValueError):
        tables.run_sql(spark, "DROP TABLE x")


def fact(tag, val, filed, end, form="10-Q", accn="1", fy=2024, fp="Q1", start=None):
    return ("E", tag, "USD", float(val), filed, form, fy, fp, start, end, accn)


FACT = "entity string, tag string, unit string, val double, filed timestamp, form string, fy long, fp string, start date, end date, accn string"


def test_statement_does_not_mix_periods(spark):
    d = dt.datetime
    rows = [
        fact("Revenues", 10, d(2024, 4, 1), dt.date(2024, 3, 31), accn="a"),
        fact("SalesRevenueNet", 11, d(2024, 4, 1), dt.date(2024, 3, 31), accn="a"),
        fact("NetIncomeLoss", 3, d(2024, 1, 1), dt.date(2023, 12, 31), accn="b"),
        fact("GrossProfit", 7, d(2024, 9, 1), dt.date(2024, 6, 30), accn="c"),
    ]
    df = spark.createDataFrame(rows, FACT)
    out = {r.field: (r.val, r.matched) for r in facts.statement(df, facts.tag_table(spark, "income"), d(2024, 5, 1)).collect()}
    assert out == {"revenue": (10.0, True), "net_income": (3.0, False)}


def test_latest_fact_ignores_later_filings(spark):
    rows = [fact("Assets", 1, dt.datetime(2024, 1, 1), dt.date(2023, 12, 31)), fact("Assets", 2, dt.datetime(2024, 6, 1), dt.date(2024, 3, 31))]
    assert facts.latest_facts(spark.createDataFrame(rows, FACT), dt.datetime(2024, 2, 1)).collect()[0].val == 1.0


def test_sections_take_the_longest(spark):
    text = "Table\nItem 1A. Risk\nItem 7. MDA\nItem 1A. Risk Factors\nmany words of risk here\nItem 7. Discussion\nlong"
    out = {r.section_id: r.text for r in texts.filing_sections(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()}
    assert out["item_1a"].endswith("risk here") and out["item_7"].endswith("long")


def test_keyword_hits_are_literal_and_limited(spark):
    df = spark.createDataFrame([(1, "a.b A.B axb a.b")], "doc_id int, text string")
    out = texts.keyword_hits(df, "a.b", 2, 3).orderBy("hit").collect()
    assert [(r.start, r.end) for r in out] == [(0, 3), (4, 7)]


def ticks(rows):
    return pd.DataFrame(rows, columns=["asset", "ts", "price", "size", "seq"])


def test_stream_bars_drop_late_trades(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    at = lambda s: pd.Timestamp("2024-01-01 10:00:00") + pd.Timedelta(seconds=s)
    schema = "asset string, ts timestamp, price double, size double, seq long"

    def feed(rows):
        spark.createDataFrame(ticks(rows), schema).write.mode("append").parquet(src)

    def run():
        stream = live.minute_bars(spark.readStream.schema(schema).parquet(src))
        live.write_bars(stream, out, mark).awaitTermination()
        return {r.ts.minute: (r.open, r.high, r.low, r.close, r.volume) for r in spark.read.parquet(out).collect()}

    feed([("A", at(20), 3.0, 1.0, 2), ("A", at(5), 1.0, 1.0, 1), ("A", at(61), 9.0, 1.0, 3)])
    # The watermark (61 s - 3 s) has not passed the end of the first minute yet.
    assert run() == {}
    feed([("A", at(59), 2.0, 1.0, 4), ("A", at(130), 5.0, 1.0, 5)])
    assert run() == {0: (1.0, 3.0, 1.0, 2.0, 3.0), 1: (9.0, 9.0, 9.0, 9.0, 1.0)}
    feed([("A", at(30), 99.0, 1.0, 6), ("A", at(200), 5.0, 1.0, 7)])
    bars = run()
    assert bars[0] == (1.0, 3.0, 1.0, 2.0, 3.0) and set(bars) == {0, 1, 2}


def test_smart_limit_timer_sends_the_first_price(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("src", "out", "mark"))
    schema = "order_id bigint, preset string, mid double, final double"
    spark.createDataFrame([(1, "fast", 10.0, 11.0)], schema).write.parquet(src)
    stream = live.smart_limit_timer(spark.readStream.schema(schema).parquet(src))
    # Timers keep an availableNow query alive for ever, so one batch it is.
    live.write_bars(stream, out, mark, once=True).awaitTermination(60)
    rows = [(r.order_id, r.step, r.price, r.action) for r in spark.read.parquet(out).collect()]
    assert rows == [(1, 0, 10.0, "price")]


def test_scaled_prices(spark):
    df = spark.createDataFrame([(5e12,), (7.0,)], "price double")
    assert [r.price for r in live.scale_prices(df).collect()] == [5000.0, 7.0]


def test_fresh_price_or_history(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("A", t, t + dt.timedelta(seconds=1), 5.0), ("A", t, t + dt.timedelta(seconds=3), 6.0)]
    df = spark.createDataFrame(rows, "asset string, ts timestamp, received_ts timestamp, price double")
    old = spark.createDataFrame([("A", 4.0)], "asset string, price double")
    assert sorted(r.price for r in live.fresh_or_history(df, old).select(F.col("price")).collect()) == [4.0, 5.0]


def test_html_entities_and_unseen_parts(spark):
    from tidemark.functions import text

    page = "<p>a&mdash;b &#160;&#x2019; &eacute;</p><script>var x='<p>no</p>'</script><div>c <b>d</b><ix:hidden>no</ix:hidden></div><style>p{}</style>e<br>f &lt;g&gt;"
    rows = spark.createDataFrame([(page,), (None,), ("",), ("<p>open",)], "html string")
    got = [r[0] for r in rows.select(text.html_to_text(F.col("html"))).collect()]
    assert got == ["a—b ’ é\nc d\ne\nf <g>", None, "", "open"]


def test_sections_of_unknown_items_are_text(spark):
    body = "intro\nItem 3A. none\nITEM 2\nx\nItem 16. no\n item 9b. Other\ny\nitems 4. no"
    out = {r.section_id: r.text for r in texts.filing_sections(spark.createDataFrame([(1, body)], "doc_id int, text string")).collect()}
    assert out == {"item_2": "ITEM 2\nx\nItem 16. no", "item_9b": " item 9b. Other\ny\nitems 4. no"}


def test_metrics_see_every_row_and_merge(spark):
    from tidemark.operators import hooks

    t0 = dt.datetime(2024, 1, 1)
    curve = spark.createDataFrame([(r, t0 + dt.timedelta(minutes=k), float(k * r)) for r in (1, 2) for k in range(50)], "run_id int, ts timestamp, v double")
    whole = {r.run_id: r.metrics for r in hooks.custom_metrics(curve, lambda p: {"n": len(p), "last": p["v"].iloc[-1]}).collect()}
    assert whole == {1: {"n": 50.0, "last": 49.0}, 2: {"n": 50.0, "last": 98.0}}
    merged = hooks.merged_metrics(curve, lambda p: {"n": len(p), "last": p["v"].iloc[-1]}, lambda p: {"n": p["n"].sum(), "last": p["last"].iloc[-1]}, block_rows=7)
    assert {r.run_id: r.metrics for r in merged.collect()} == whole


def test_calendar_of_two_markets_and_assets_never_stored(spark):
    from tidemark.operators import joins

    day = dt.date(2024, 1, 3)
    at = lambda h, d=3: dt.datetime(2024, 1, d, h)
    calendar = spark.createDataFrame(
        [("X", day, at(14), at(21)), ("Y", day, at(23, 2), at(22)), ("X", dt.date(2024, 1, 4), at(14, 4), at(21, 4))], "market string, session_date date, open_ts timestamp, close_ts timestamp"
    )
    bars = spark.createDataFrame([("X", "a", at(15)), ("X", "a", at(23)), ("Y", "b", at(15)), ("Y", "b", at(23, 2))], "market string, asset string, ts timestamp")
    got = sorted((r.asset, r.ts, r.session_date) for r in joins.within_session(bars, calendar, "America/New_York").collect())
    assert got == [("a", at(15), day), ("b", at(23, 2), day), ("b", at(15), day)]
    assets = spark.createDataFrame([("X", "a", None), ("X", "n", None), ("Y", "m", None)], "market string, asset string, expiration date")
    cached = bars.withColumn("missing", F.lit(False))
    lost = sorted((r.asset, r.session_date.day) for r in joins.missing_dates(calendar, cached, assets, dt.date(2024, 1, 31)).collect())
    assert lost == [("a", 4), ("m", 3), ("n", 3), ("n", 4)]


def test_option_symbols_of_any_shape(spark):
    from tidemark.functions import symbols

    rows = spark.createDataFrame([(" spy240119c00450000 ",), ("SPY241399C00450000",), ("LONGROOT7240119P5000",), ("SPY",), (None,)], "s string")
    got = [r.o for r in rows.select(symbols.parse_occ(F.col("s")).alias("o")).collect()]
    assert (got[0].root, got[0].asset_type, got[0].right, got[0].strike) == ("SPY", "option", "CALL", 450.0)
    assert got[1].asset_type == "stock" and got[1].expiration is None
    assert (got[2].root, got[2].strike, got[2].right) == ("LONGROOT7", 5.0, "PUT")
    assert got[3].asset_type == "stock" and got[4].root is None


def test_item_1b_and_unknown_items(spark):
    text = "intro\nItem 1A. Risks\nrisk text\n\n  ITEM 1b\tUnresolved\nstaff\nItem 20. none\nItem 15x\nItem 2. Places\nplace\n"
    rows = texts.filing_sections(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "Item 3.")], "doc_id int, text string"), heading_chars=8).collect()
    assert {(r.doc_id, r.section_id): (r.heading, r.text) for r in rows} == {
        (1, "item_1a"): ("Item 1A.", "Item 1A. Risks\nrisk text\n"),
        (1, "item_1b"): ("ITEM 1b\t", "  ITEM 1b\tUnresolved\nstaff\nItem 20. none\nItem 15x"),
        (1, "item_2"): ("Item 2. ", "Item 2. Places\nplace\n"),
        (4, "item_3"): ("Item 3.", "Item 3."),
    }


def test_quotes_of_zero_and_of_a_cent(spark, tmp_path):
    q = spark.createDataFrame([(0.0, 0.0), (1.0, None), (1.0, 3.0)], "bid double, ask double")
    assert [r.mid for r in live.quote_stream(q).collect()] == [2.0]
    assert [r.mid for r in live.quote_stream(q, any_price=True).collect()] == [0.0, 2.0]
    from tidemark.queries.live import stream_scaled_symbols

    events = [(0, dt.datetime(2024, 1, 1), 0, "click", 0.01, "{}"), (2, dt.datetime(2024, 1, 1), 0, "click", 0.0, "{}")]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(0, "N")], "n_nationkey int, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    assert {r.seq: r.mid for r in stream_scaled_symbols(spark, str(tmp_path)).collect()} == {0: 0.01, 2: 0.0}
