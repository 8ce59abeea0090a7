"""Point-in-time facts, filings, macro series, news and text search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import facts, texts
from tidemark.queries import lens
from tidemark.queries.registry import query

AS_OF = dt.datetime(1999, 6, 30)
TAGS = ("Revenues", "SalesRevenueNet", "NetIncomeLoss", "GrossProfit", "EarningsPerShareBasic")
FORMS = ("10-K", "10-Q", "8-K", "20-F")


def fact_rows(spark, sf):
    """orders as facts: entity, tag by priority, period from the order date."""
    o = lens.table(spark, sf, "orders")
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    end = F.date_sub(F.to_date(F.date_trunc("quarter", d)), 1)
    return o.select(
        (F.col("o_custkey") % 200).alias("entity"),
        pick(TAGS, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("tag"),
        F.lit("USD").alias("unit"),
        F.col("o_totalprice").alias("val"),
        d.alias("filed"),
        pick(FORMS, k % 4).alias("form"),
        F.year(end).cast("long").alias("fy"),
        F.concat(F.lit("Q"), F.quarter(end)).alias("fp"),
        F.to_date(F.date_trunc("quarter", end)).alias("start"),
        end.alias("end"),
        F.concat_ws("-", (F.col("o_custkey") % 200).cast("string"), F.date_format(d, "yyyyMM")).alias("accn"),
        k.alias("fact_id"),
    )


FACTS = f"""facts AS (SELECT o_custkey % 200 AS entity, {list(TAGS)!r}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS tag, o_totalprice AS val, o_orderdate AS filed, {list(FORMS)!r}[o_orderkey % 4 + 1] AS form,
  CAST(date_trunc('quarter', o_orderdate) - INTERVAL 1 DAY AS DATE) AS "end", (o_custkey % 200) || '-' || strftime(o_orderdate, '%Y%m') AS accn, o_orderkey AS fact_id FROM orders)"""


@query("pit_latest_facts", "X1", f"""WITH {FACTS} SELECT entity, tag, arg_max(val, (filed, "end", fact_id)) AS val, arg_max(accn, (filed, "end", fact_id)) AS accn, arg_max(fact_id, (filed, "end", fact_id)) AS fact_id
  FROM facts WHERE filed <= TIMESTAMP '1999-06-30' GROUP BY 1, 2""")
def pit_latest_facts(spark, sf):
    return facts.latest_facts(fact_rows(spark, sf), AS_OF, ("fact_id",)).select("entity", "tag", "val", "accn", "fact_id")


@query("company_facts", "X2 L3", f"""WITH {FACTS}, l AS (SELECT entity, tag, arg_max(val, (filed, "end", fact_id)) AS val FROM facts WHERE filed <= TIMESTAMP '1999-06-30' GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE tag WHEN 'NetIncomeLoss' THEN 1 WHEN 'Revenues' THEN 2 ELSE 3 END, tag) AS rank FROM l) SELECT * FROM r WHERE rank <= 3""")
def company_facts(spark, sf):
    return facts.company_facts(fact_rows(spark, sf), AS_OF, ("NetIncomeLoss", "Revenues"), 3, ("fact_id",)).select("entity", "tag", "val", "rank")


@query("income_statement", "X3 L3", f"""WITH {FACTS}, tg AS (SELECT * FROM (VALUES ('revenue', 'Revenues', 2), ('revenue', 'SalesRevenueNet', 1), ('gross_profit', 'GrossProfit', 1), ('net_income', 'NetIncomeLoss', 1), ('eps_basic', 'EarningsPerShareBasic', 1)) t(field, tag, tp)),
  c AS (SELECT *, CASE form WHEN '10-K' THEN 5 WHEN '20-F' THEN 5 WHEN '10-Q' THEN 4 ELSE 2 END AS fpri FROM facts JOIN tg USING (tag) WHERE filed <= TIMESTAMP '1999-06-30'),
  a AS (SELECT entity, arg_max(accn, (filed, "end", fpri, fact_id)) AS aa, arg_max("end", (filed, "end", fpri, fact_id)) AS ae, arg_max(form, (filed, "end", fpri, fact_id)) AS af FROM c GROUP BY 1),
  m AS (SELECT c.*, accn = aa OR ("end" = ae AND form = af) AS m FROM c JOIN a USING (entity))
  SELECT entity, field, arg_max(tag, (m, filed, "end", fpri, tp, fact_id)) AS tag, arg_max(val, (m, filed, "end", fpri, tp, fact_id)) AS val, bool_or(m) AS matched FROM m GROUP BY 1, 2""")
def income_statement(spark, sf):
    out = facts.statement(fact_rows(spark, sf), facts.tag_table(spark, "income"), AS_OF, ("fact_id",))
    return out.select("entity", "field", "tag", "val", "matched")


@query("facts_exploded", "X1 X3", """SELECT o_orderkey AS entity, 'us-gaap' AS taxonomy, 'Revenues' AS tag, 'USD' AS unit, o_totalprice AS val, o_orderdate AS filed FROM orders
  UNION ALL SELECT o_orderkey, 'us-gaap', 'Revenues', 'USD', o_totalprice * 2, o_orderdate FROM orders""")
def facts_exploded(spark, sf):
    o = lens.table(spark, sf, "orders")
    filed = F.date_format("o_orderdate", "yyyy-MM-dd")
    fact = lambda v: F.struct(v.alias("val"), filed.alias("filed"), F.lit("10-K").alias("form"))
    units = F.create_map(F.lit("USD"), F.array(fact(F.col("o_totalprice")), fact(F.col("o_totalprice") * 2)))
    doc = F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(units.alias("units"))))
    raw = o.select(F.col("o_orderkey").alias("entity"), F.to_json(doc).alias("json"))
    return facts.explode_facts(raw).select("entity", "taxonomy", "tag", "unit", "val", "filed")


@query("filings_listed", "X4", f"""WITH f AS (SELECT o_custkey % 200 AS entity, 'A' || o_orderkey AS accn, {list(FORMS)!r}[o_orderkey % 4 + 1] AS form, CAST(o_orderdate AS DATE) AS filed, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 20 HOUR END AS accepted FROM orders),
  r AS (SELECT *, coalesce(accepted, filed) AS known_at FROM f WHERE coalesce(accepted, filed) <= TIMESTAMP '1999-06-30' AND form IN ('10-K', '8-K'))
  SELECT *, row_number() OVER (PARTITION BY entity ORDER BY known_at DESC, accn DESC) AS rank FROM r QUALIFY row_number() OVER (PARTITION BY entity ORDER BY known_at DESC, accn DESC) <= 5""")
def filings_listed(spark, sf):
    o = lens.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    form = F.element_at(F.array(*[F.lit(n) for n in FORMS]), (k % 4 + 1).cast("int"))
    raw = o.select(
        (F.col("o_custkey") % 200).alias("entity"), F.array(F.concat(F.lit("A"), k.cast("string"))).alias("accn"), F.array(form).alias("form"), F.array(F.to_date("o_orderdate")).alias("filed"),
        F.array(F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("interval 20 hours"))).alias("accepted"),
    )
    return facts.list_filings(facts.explode_filings(raw), AS_OF, ("10-k", "8-K"), 5)


_OBS = """obs AS (SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date, CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(10 + 30 * (o_orderkey % 3) AS INTEGER) AS DATE) AS realtime_start,
  CAST(CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(39 + 30 * (o_orderkey % 3) AS INTEGER) AS DATE) AS realtime_end, max(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END) AS value FROM orders GROUP BY ALL)"""


def observations(spark, sf):
    o = lens.table(spark, sf, "orders")
    month = F.to_date(F.date_trunc("month", "o_orderdate"))
    v = (F.col("o_orderkey") % 3).cast("int") * 30
    keys = [F.col("o_orderpriority").alias("series_id"), month.alias("obs_date"), F.date_add(month, v + 10).alias("realtime_start"), F.date_add(month, v + 39).alias("realtime_end")]
    return o.groupBy(*keys).agg(F.max(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice"))).alias("value"))


@query("macro_vintage", "X7 F23", f"WITH {_OBS} SELECT * FROM obs WHERE DATE '1999-06-30' BETWEEN realtime_start AND realtime_end AND obs_date <= DATE '1999-06-01'")
def macro_vintage(spark, sf):
    return facts.series_at_vintage(observations(spark, sf), AS_OF, dt.date(1999, 6, 1))


@query("macro_latest", "X7", f"""WITH {_OBS} SELECT series_id, arg_max(obs_date, (obs_date, value)) AS obs_date, arg_max(value, (obs_date, value)) AS value FROM obs WHERE DATE '1999-06-30' BETWEEN realtime_start AND realtime_end AND value IS NOT NULL GROUP BY 1""")
def macro_latest(spark, sf):
    return facts.latest_values(facts.series_at_vintage(observations(spark, sf), AS_OF, AS_OF))


@query("macro_snapshot", "X7 X8", f"""WITH {_OBS}, l AS (SELECT series_id, arg_max(value, (obs_date, value)) AS value FROM obs WHERE DATE '1999-06-30' BETWEEN realtime_start AND realtime_end AND value IS NOT NULL GROUP BY 1)
  SELECT max(value) FILTER (series_id = '1-URGENT') AS "1-URGENT", max(value) FILTER (series_id = '5-LOW') AS "5-LOW" FROM l""")
def macro_snapshot(spark, sf):
    return facts.snapshot(facts.series_at_vintage(observations(spark, sf), AS_OF, AS_OF), ("1-URGENT", "5-LOW"))


@query("series_catalogue", "X8", "SELECT p_partkey AS series_id, p_name AS title, p_type AS category FROM part WHERE lower(p_type) = 'economy'")
def series_catalogue(spark, sf):
    p = lens.table(spark, sf, "part").select(F.col("p_partkey").alias("series_id"), F.col("p_name").alias("title"), F.col("p_type").alias("category"))
    return facts.catalogue(p, "Economy")


@query("news_window", "X9", """SELECT doc_id AS id, lang || '/' || source AS about, TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS ts, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS text FROM documents
  WHERE TIMESTAMP '2024-01-01' + to_minutes(doc_id) BETWEEN '2024-01-01 01:00:00' AND '2024-01-01 12:00:00' AND (lang = 'en' OR source = 'web') ORDER BY ts DESC, id DESC LIMIT 100""")
def news_window(spark, sf):
    d = lens.table(spark, sf, "documents")
    at = F.timestamp_micros(F.unix_micros(F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")) + F.col("doc_id") * 60_000_000)
    items = d.select(F.col("doc_id").alias("id"), at.alias("ts"), F.array("lang", "source").alias("symbols"), "text")
    out = facts.news(items, dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 1), ["en", "web"], 100, 300)
    return out.select("id", F.array_join("symbols", "/").alias("about"), "ts", "text")


# ---- text ------------------------------------------------------------------------------------------------
_DOCSEC = r"""doc AS (SELECT doc_id, list_aggregate(list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i % 4 = 1 THEN 'Item ' || (1 + (i // 4) % 3) || '. Part ' || i || chr(10) || x ELSE x END), 'string_agg', chr(10)) AS text FROM documents)"""


def filing_texts(spark, sf):
    """documents with an item heading put before every fourth line."""
    d = lens.table(spark, sf, "documents")
    head = lambda x, i: F.when(
        i % 4 == 0, F.concat(F.lit("Item "), (1 + F.floor((i + 1) / 4) % 3).cast("string"), F.lit(". Part "), (i + 1).cast("string"), F.lit("\n"), x)
    ).otherwise(x)
    return d.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), head), "\n").alias("text"))


@query("filing_sections", "X5", rf"""WITH {_DOCSEC}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM doc),
  h AS (SELECT *, lower(regexp_extract(line, '^\s*[Ii][Tt][Ee][Mm]\s+([0-9]+[A-Za-z]?)([.\s]|$)', 1)) AS id FROM l), f AS (SELECT *, (id IN ('1a', '1b', '7a', '9a', '9b') OR try_cast(id AS INT) BETWEEN 1 AND 15) AS begins FROM h),
  n AS (SELECT *, sum(coalesce(begins, false)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS pos FROM f),
  s AS (SELECT doc_id, pos, max(id) FILTER (begins) AS id, string_agg(line, chr(10) ORDER BY i) AS text FROM n WHERE pos > 0 GROUP BY 1, 2)
  SELECT doc_id, 'item_' || id AS section_id, arg_max(text, (length(text), -pos)) AS text FROM s GROUP BY 1, 2""")
def filing_sections(spark, sf):
    return texts.filing_sections(filing_texts(spark, sf)).drop("heading")


_HITS = """RECURSIVE d AS MATERIALIZED (SELECT doc_id, text, lower(text) AS l FROM documents), w AS (SELECT * FROM (VALUES (0, 'the'), (1, 'on')) t(o, term)),
  h AS (SELECT doc_id, o, term, CAST(instr(l, term) AS BIGINT) AS p, 1 AS n FROM d, w WHERE contains(l, term) UNION ALL
   SELECT h.doc_id, h.o, h.term, h.p + length(h.term) - 1 + instr(substr(l, CAST(h.p + length(h.term) AS BIGINT)), h.term), n + 1 FROM h JOIN d USING (doc_id) WHERE n < 5 AND contains(substr(l, CAST(h.p + length(h.term) AS BIGINT)), h.term)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o, p) - 1 AS hit FROM h)"""


@query("keyword_hits", "X6", f"""WITH {_HITS} SELECT doc_id, hit, term, p - 1 AS start, p - 1 + length(term) AS "end", trim(substr(text, greatest(p - 30, 1), least(p - 1 + length(term) + 30, length(text) + 1 - 1) + 1 - greatest(p - 30, 1)), ' ') AS context FROM r JOIN d USING (doc_id) WHERE hit < 5""")
def keyword_hits(spark, sf):
    return texts.keyword_hits(lens.table(spark, sf, "documents"), "The on", 5, 30)


@query("document_search", "X10 L4", r"""WITH d AS (SELECT doc_id, regexp_replace(lower(text), '\s+', ' ', 'g') AS n FROM documents), c AS (SELECT doc_id, n, (length(n) - length(replace(n, 'the on', ''))) // 6 AS p, (length(n) - length(replace(n, 'the', ''))) // 3 AS a, (length(n) - length(replace(n, 'on', ''))) // 2 AS b FROM d)
  SELECT doc_id, 100 * p + 10 * ((a > 0)::INT + (b > 0)::INT) + least(a + b, 50) AS score FROM c WHERE p + a + b > 0 ORDER BY score DESC, doc_id LIMIT 50""")
def document_search(spark, sf):
    return texts.document_search(lens.table(spark, sf, "documents"), "The  on", 50).drop("snippet")


@query("memory_search", "X11 L4", """SELECT conv_id, turn, (contains(lower(text), 'la'))::BIGINT + (contains(lower(text), 'the'))::BIGINT + (contains(lower(text), 'une'))::BIGINT AS score FROM conversations
  WHERE role = 'user' AND (contains(lower(text), 'la') OR contains(lower(text), 'the') OR contains(lower(text), 'une')) ORDER BY score DESC, turn DESC, conv_id LIMIT 40""")
def memory_search(spark, sf):
    c = lens.table(spark, sf, "conversations")
    return texts.memory_search(c, "la The une", 40, "conv_id", "text", "turn", role="user").select("conv_id", "turn", "score")


@query("search_without_repeats", "U4", """SELECT conv_id, CASE WHEN bool_or(role = 'system') THEN 'index' ELSE 'event' END AS origin FROM conversations GROUP BY 1""")
def search_without_repeats(spark, sf):
    c = lens.table(spark, sf, "conversations")
    idx = c.filter(F.col("role") == "system").select("conv_id", F.lit("index").alias("origin")).distinct()
    ev = c.filter(~F.col("role").eqNullSafe("system")).select("conv_id", F.lit("event").alias("origin")).distinct()
    return texts.without_repeats(idx, ev, "conv_id")


@query("latest_projection", "X12", """SELECT conv_id, arg_max(turn, turn) AS turn, arg_max(role, turn) AS role, arg_max(text, turn) AS text, arg_min(turn, turn) AS created_at FROM conversations GROUP BY 1""")
def latest_projection(spark, sf):
    c = lens.table(spark, sf, "conversations").withColumn("created_at", F.col("turn"))
    return texts.project_latest(c, "conv_id", "turn", "created_at")


