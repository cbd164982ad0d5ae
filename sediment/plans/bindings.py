"""The driver's tables as the domain's: each binding in the DataFrame API and, for the oracles, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.calendar import calendar


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utc(c: str):
    return F.col(c).cast("timestamp")


# --- daily bars from lineitem: one security a supplier, one session a ship date ---------------------------------------

BARS_SQL = """
bars AS (
  SELECT l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS session_date, CAST(l_shipdate AS TIMESTAMP) + INTERVAL 870 MINUTE AS ts,
         round(avg(l_extendedprice / l_quantity), 10) AS open, round(max(l_extendedprice / l_quantity * (1 + l_tax)), 10) AS high,
         round(min(l_extendedprice / l_quantity), 10) AS low, round(avg(l_extendedprice / l_quantity * (1 + l_tax)), 10) AS close,
         CAST(sum(l_quantity) AS BIGINT) AS volume,
         CASE WHEN max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 0 THEN 'normal' WHEN min(l_linestatus) = 'O' THEN 'halted' ELSE 'unknown' END AS trading_status
  FROM lineitem GROUP BY 1, 2, 3)"""


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_extendedprice") / F.col("l_quantity")
    taxed = p * (1 + F.col("l_tax"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("security_id"), F.col("l_shipdate").cast("date").alias("session_date"))
    status = F.when(F.max(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)) == 0, "normal").when(F.min("l_linestatus") == "O", "halted").otherwise("unknown")
    out = rows.agg(F.round(F.avg(p), 10).alias("open"), F.round(F.max(taxed), 10).alias("high"), F.round(F.min(p), 10).alias("low"), F.round(F.avg(taxed), 10).alias("close"), F.sum("l_quantity").cast("long").alias("volume"), status.alias("trading_status"))
    return out.withColumn("ts", F.col("session_date").cast("timestamp") + F.expr("interval 870 minutes"))


INDEX_SQL = """
bench AS (SELECT session_date, round(avg(open), 10) AS open, round(avg(close), 10) AS close FROM bars GROUP BY 1),
sectors AS (SELECT security_id % 5 AS sector, session_date, round(avg(open), 10) AS open, round(avg(close), 10) AS close FROM bars GROUP BY 1, 2),
rets AS (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY ts) - 1 AS ret FROM bars),
factors AS (
  SELECT session_date, round(avg(ret), 10) AS mkt, round(avg(ret) FILTER (WHERE security_id % 2 = 0) - avg(ret) FILTER (WHERE security_id % 2 = 1), 10) AS smb,
         round(avg(ret) FILTER (WHERE security_id % 3 = 0) - avg(ret) FILTER (WHERE security_id % 3 = 2), 10) AS hml, 0.0001::DOUBLE AS rf
  FROM rets GROUP BY 1 HAVING count(ret) FILTER (WHERE security_id % 2 = 0) > 0 AND count(ret) FILTER (WHERE security_id % 2 = 1) > 0
     AND count(ret) FILTER (WHERE security_id % 3 = 0) > 0 AND count(ret) FILTER (WHERE security_id % 3 = 2) > 0)"""


def benchmark(b: DataFrame) -> DataFrame:
    return b.groupBy("session_date").agg(F.round(F.avg("open"), 10).alias("open"), F.round(F.avg("close"), 10).alias("close"))


def sectors(b: DataFrame) -> DataFrame:
    return b.groupBy((F.col("security_id") % 5).alias("sector"), "session_date").agg(F.round(F.avg("open"), 10).alias("open"), F.round(F.avg("close"), 10).alias("close"))


def factors(ranked: DataFrame) -> DataFrame:
    part = lambda m, r: F.avg(F.when(F.col("security_id") % m == r, F.col("ret")))
    out = ranked.groupBy("session_date").agg(F.round(F.avg("ret"), 10).alias("mkt"), F.round(part(2, 0) - part(2, 1), 10).alias("smb"), F.round(part(3, 0) - part(3, 2), 10).alias("hml"))
    return out.dropna().withColumn("rf", F.lit(0.0001))


# --- events of outcomes: orders, on a security by customer --------------------------------------------------


def order_days(spark: SparkSession) -> DataFrame:
    return calendar(spark, 1994, 2002)


def event_days(spark: SparkSession) -> DataFrame:
    return calendar(spark, 2023, 2024)


# The exchange's closed days and early closes of the years that the queries use, for their SQL alone.
CLOSED_DAYS = """
1994-02-21 1994-04-01 1994-04-27 1994-05-30 1994-07-04 1994-09-05 1994-11-24 1994-12-26
1995-01-02 1995-02-20 1995-04-14 1995-05-29 1995-07-04 1995-09-04 1995-11-23 1995-12-25
1996-01-01 1996-02-19 1996-04-05 1996-05-27 1996-07-04 1996-09-02 1996-11-28 1996-12-25
1997-01-01 1997-02-17 1997-03-28 1997-05-26 1997-07-04 1997-09-01 1997-11-27 1997-12-25
1998-01-01 1998-01-19 1998-02-16 1998-04-10 1998-05-25 1998-07-03 1998-09-07 1998-11-26 1998-12-25
1999-01-01 1999-01-18 1999-02-15 1999-04-02 1999-05-31 1999-07-05 1999-09-06 1999-11-25 1999-12-24
2000-01-17 2000-02-21 2000-04-21 2000-05-29 2000-07-04 2000-09-04 2000-11-23 2000-12-25
2001-01-01 2001-01-15 2001-02-19 2001-04-13 2001-05-28 2001-07-04 2001-09-03 2001-09-11 2001-09-12 2001-09-13 2001-09-14 2001-11-22 2001-12-25
2002-01-01 2002-01-21 2002-02-18 2002-03-29 2002-05-27 2002-07-04 2002-09-02 2002-11-28 2002-12-25 2003-01-01
2023-01-02 2023-01-16 2023-02-20 2023-04-07 2023-05-29 2023-06-19 2023-07-04 2023-09-04 2023-11-23 2023-12-25
2024-01-01 2024-01-15 2024-02-19 2024-03-29 2024-05-27 2024-06-19 2024-07-04 2024-09-02 2024-11-28 2024-12-25 2025-01-01"""
SHORT_DAYS = """
1994-11-25 1995-07-03 1995-11-24 1996-07-05 1996-11-29 1996-12-24 1997-07-03 1997-11-28 1997-12-24 1997-12-26 1998-11-27 1998-12-24
1999-11-26 1999-12-31 2000-07-03 2000-11-24 2001-07-03 2001-11-23 2001-12-24 2002-07-05 2002-11-29 2002-12-24
2023-07-03 2023-11-24 2024-07-03 2024-11-29 2024-12-24"""


def days_sql(first: int, last: int) -> str:
    listed = lambda days: ", ".join(f"DATE '{d}'" for d in days.split())
    at = lambda d, time: f"timezone('UTC', timezone('America/New_York', {d} + INTERVAL '{time}'))"
    return f"""
dates AS (SELECT CAST(range AS DATE) AS d FROM range(DATE '{first}-01-01', DATE '{last + 1}-01-15', INTERVAL 1 DAY)),
open_days AS (
  SELECT d AS session_date, {at("d", "9 hours 30 minutes")} AS open_utc, CASE WHEN d IN ({listed(SHORT_DAYS)}) THEN {at("d", "13 hours")} ELSE {at("d", "16 hours")} END AS close_utc
  FROM dates WHERE isodow(d) < 6 AND d NOT IN ({listed(CLOSED_DAYS)})),
chained AS (SELECT *, lag(session_date) OVER o AS previous, lead(session_date) OVER o AS next_session_date, lead(open_utc) OVER o AS next_open_utc FROM open_days WINDOW o AS (ORDER BY session_date)),
days AS (SELECT d AS calendar_date, c.* EXCLUDE previous FROM dates JOIN chained c ON d <= session_date AND (previous IS NULL OR d > previous) WHERE year(d) <= {last})"""


def outcome_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.calendar import tradable_at

    n = table(spark, sf_dir, "supplier").count()
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), (F.col("o_custkey") % n).alias("security_id"), (utc("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))).alias("published"), (F.col("o_orderkey") % 3 + 1).alias("same_day_filings"))
    e = tradable_at(e, order_days(spark), "published")
    return e.withColumn("sector", F.col("security_id") % 5)


def outcome_events_sql() -> str:
    return f"""
{days_sql(1994, 2002)},
pub AS (
  SELECT o_orderkey AS event_id, o_custkey % (SELECT count(*) FROM supplier) AS security_id, o_orderkey % 3 + 1 AS same_day_filings,
         CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS published FROM orders),
local AS (SELECT *, CAST(timezone('America/New_York', timezone('UTC', published)) AS DATE) AS d FROM pub),
outcome_events AS (
  SELECT l.*, l.security_id % 5 AS sector,
         CASE WHEN published < open_utc THEN open_utc + INTERVAL 15 MINUTE WHEN published < close_utc THEN next_open_utc ELSE next_open_utc + INTERVAL 15 MINUTE END AS tradable_at
  FROM local l JOIN days ON l.d = days.calendar_date)"""


# --- knowledge records and requests from events ----------------------------------------------------------------------

KNOWLEDGE_SQL = """
knowledge AS (
  SELECT event_id AS record_id, user_id AS entity_id, event_type AS knowledge_type, json_extract_string(props, '$.k') AS knowledge_key, value, ts AS published FROM events)"""


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("knowledge_type"), F.get_json_object("props", "$.k").alias("knowledge_key"), "value", utc("ts").alias("published"))


REQUESTS_SQL = """
requests AS (
  SELECT event_id AS request_id, 'https://host.example/' || (user_id % 40) AS url, CASE WHEN event_type = 'error' THEN 503 ELSE 200 END AS status,
         CASE WHEN event_type = 'view' AND value > 50 THEN NULL ELSE json_extract_string(props, '$.k') END AS content_hash FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("request_id"), F.concat(F.lit("https://host.example/"), (F.col("user_id") % 40).cast("string")).alias("url"), F.when(F.col("event_type") == "error", 503).otherwise(200).alias("status"),
        F.when((F.col("event_type") == "view") & (F.col("value") > 50), F.lit(None)).otherwise(F.get_json_object("props", "$.k")).alias("content_hash"),
    )


# --- the security master: customers, parts, and intervals between a customer's orders ---------------------------------

MASTER_SQL = """
first_orders AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max(o_orderpriority) AS p FROM orders GROUP BY 1, 2),
history AS (
  SELECT 'cik' AS identifier_type, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS identifier_value, o_custkey AS entity_id, d AS valid_from,
         lead(d) OVER (PARTITION BY o_custkey ORDER BY d) AS valid_to FROM first_orders WHERE o_custkey % 3 <> 0),
tickers AS (SELECT o_custkey * 10 AS security_id, p AS identifier_value, d AS valid_from, lead(d) OVER (PARTITION BY o_custkey ORDER BY d) AS valid_to FROM first_orders),
entities AS (SELECT c_custkey AS entity_id, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, DATE '1996-01-01' AS valid_from, CASE WHEN c_custkey % 7 = 0 THEN DATE '2000-01-01' END AS valid_to FROM customer),
securities AS (SELECT c_custkey AS entity_id, c_custkey * 10 AS security_id, c_mktsegment AS ticker, DATE '1995-06-01' AS valid_from, CAST(NULL AS DATE) AS valid_to,
                      CASE WHEN c_custkey % 5 = 0 THEN DATE '1999-01-01' END AS delisted_at FROM customer),
membership AS (SELECT o_custkey * 10 AS security_id, o_orderstatus AS universe_name, d1 AS membership_start, d1 + INTERVAL 90 DAY AS membership_end
               FROM (SELECT o_custkey, o_orderstatus, CAST(min(o_orderdate) AS DATE) AS d1 FROM orders GROUP BY 1, 2)),
filings AS (SELECT o_orderkey AS query_id, CAST(o_custkey AS VARCHAR) AS raw_cik, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) AS as_of FROM orders)"""


def master(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    first = o.groupBy("o_custkey", F.col("o_orderdate").cast("date").alias("d")).agg(F.max("o_orderpriority").alias("p"))
    spans = first.withColumn("to", F.expr("lead(d) over (partition by o_custkey order by d)"))
    cik = lambda k: F.lpad(F.col(k).cast("string"), 10, "0")
    ciks = spans.where("o_custkey % 3 != 0").select(F.lit("cik").alias("identifier_type"), cik("o_custkey").alias("identifier_value"), F.col("o_custkey").alias("entity_id"), F.lit(None).cast("long").alias("security_id"), F.col("d").alias("valid_from"), F.col("to").alias("valid_to"))
    tickers = spans.select(F.lit("ticker").alias("identifier_type"), F.col("p").alias("identifier_value"), F.col("o_custkey").alias("entity_id"), (F.col("o_custkey") * 10).alias("security_id"), F.col("d").alias("valid_from"), F.col("to").alias("valid_to"))
    day = lambda s: F.lit(s).cast("date")
    none = F.lit(None).cast("date")
    start = o.groupBy("o_custkey", "o_orderstatus").agg(F.min("o_orderdate").cast("date").alias("d1"))
    return {
        "history": ciks.unionByName(tickers),
        "entities": c.select(F.col("c_custkey").alias("entity_id"), cik("c_custkey").alias("cik"), day("1996-01-01").alias("valid_from"), F.when(F.col("c_custkey") % 7 == 0, day("2000-01-01")).alias("valid_to")),
        "securities": c.select(F.col("c_custkey").alias("entity_id"), (F.col("c_custkey") * 10).alias("security_id"), F.col("c_mktsegment").alias("ticker"), day("1995-06-01").alias("valid_from"), none.alias("valid_to"), F.when(F.col("c_custkey") % 5 == 0, day("1999-01-01")).alias("delisted_at")),
        "membership": start.select((F.col("o_custkey") * 10).alias("security_id"), F.col("o_orderstatus").alias("universe_name"), F.col("d1").alias("membership_start"), F.date_add("d1", 90).alias("membership_end")),
        "filings": o.select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").cast("string").alias("cik"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 60).cast("int")).alias("as_of")),
    }


# --- annotations: conversations as a history, events as votes, orders as a graph --------------------------------------

RECORDS_SQL = """
records AS (
  SELECT conv_id * 1000 + turn AS annotation_id, conv_id AS event_id, role AS annotator_id, turn AS created_at, substr(text, 1, 1) AS decision,
         CASE WHEN turn >= 4 THEN conv_id * 1000 + turn - 2 END AS supersedes_annotation_id FROM conversations)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("annotation_id"), F.col("conv_id").alias("event_id"), F.col("role").alias("annotator_id"), F.col("turn").alias("created_at"), F.substring("text", 1, 1).alias("decision"),
        F.when(F.col("turn") >= 4, F.col("conv_id") * 1000 + F.col("turn") - 2).alias("supersedes_annotation_id"),
    )


VOTES_SQL = """
votes AS (
  SELECT user_id, CAST(ts AS DATE) AS day, m[1] AS model, CAST(floor(v / 25) AS BIGINT) AS value
  FROM (SELECT user_id, CAST(ts AS DATE) AS ts, [CASE event_type WHEN 'click' THEN 'A' WHEN 'error' THEN 'B' WHEN 'purchase' THEN 'C' WHEN 'signup' THEN 'D' ELSE 'E' END] AS m, arg_max(value, ts) AS v
        FROM events GROUP BY 1, 2, 3))"""


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    model = F.element_at(F.create_map(*[F.lit(x) for kv in zip(("click", "error", "purchase", "signup", "view"), "ABCDE") for x in kv]), F.col("event_type"))
    last = e.groupBy("user_id", F.col("ts").cast("date").alias("day"), model.alias("model")).agg(F.max_by("value", "ts").alias("v"))
    return last.select("user_id", "day", "model", F.floor(F.col("v") / 25).cast("long").alias("value"))


EXAMPLES_SQL = """
examples AS (
  SELECT d.doc_id, d.text, d.lang AS filing_type, CASE WHEN quality = 1 THEN 'good' ELSE '' END || CASE WHEN toxic = 1 THEN '|toxic' ELSE '' END AS label, quality, toxic
  FROM documents d JOIN labels USING (doc_id))"""


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")  # noqa: E741
    label = F.concat(F.when(F.col("quality") == 1, "good").otherwise(""), F.when(F.col("toxic") == 1, "|toxic").otherwise(""))
    return d.join(l, "doc_id").select("doc_id", "text", F.col("lang").alias("filing_type"), label.alias("label"), "quality", "toxic")
