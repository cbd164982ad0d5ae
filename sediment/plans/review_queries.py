"""Queries of review texts, validation rules and the composites over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from . import bindings as B
from .registry import query
from .text_queries import WHITE_SQL

TERMS = ["the", "and", "license", "de", "la"]


def sections(spark, sf_dir):
    """Documents as sections: a line is a section; lines with a bar are tables, licences are boilerplate."""
    d = B.table(spark, sf_dir, "documents")
    one = lambda x: F.struct(F.lit("").alias("heading"), x.alias("text"), F.contains(x, F.lit("|")).alias("is_table"), F.contains(F.lower(x), F.lit("license")).alias("is_boilerplate"))
    return d.select("doc_id", F.transform(F.split("text", "\n"), one).alias("sections"))


def SCORE(x):
    return " + ".join(f"(length({x}) - length(replace({x}, '{t}', ''))) // {len(t)}" for t in TERMS)


RANKED_SQL = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
u AS (SELECT *, contains(lower(x), 'license') AS b FROM l WHERE trim(x, {WHITE_SQL}) <> '' AND NOT contains(x, '|')),
p AS (SELECT * FROM u WHERE NOT b OR doc_id NOT IN (SELECT doc_id FROM u WHERE NOT b)),
s AS (SELECT *, lower(' ' || substr(x, 1, 2000)) AS c FROM p),
r AS (SELECT doc_id, x, {SCORE('c')} AS score, row_number() OVER (PARTITION BY doc_id ORDER BY {SCORE('c')} DESC, i) AS k FROM s QUALIFY k <= 6)
"""


@query("T2", RANKED_SQL + "SELECT doc_id, count(*) AS n, sum(score)::BIGINT AS score, string_agg(x, '|' ORDER BY k) AS texts FROM r GROUP BY 1")
def t2(spark, sf_dir):
    top = sections(spark, sf_dir).withColumn("top", review.top_sections(F.col("sections"), 6, TERMS)).where("size(top) > 0")
    return top.select("doc_id", F.size("top").cast("long").alias("n"), F.aggregate("top", F.lit(0).cast("long"), lambda a, s: a - s["rank"]).alias("score"), F.array_join(F.transform("top", lambda s: s["text"]), "|").alias("texts"))


@query("T3")
def t3(spark, sf_dir):
    top = sections(spark, sf_dir).withColumn("top", review.top_sections(F.col("sections"), 6, TERMS))
    return top.select("doc_id", review.review_text(F.col("top")).alias("review")).withColumn("n", F.length("review"))


@query("P10", "SELECT p_partkey, ['application/json', 'text/html', 'image/png', 'x/y'][p_partkey % 4 + 1] AS media_type, ['.json', '.html', '.png', '.bin'][p_partkey % 4 + 1] AS extension FROM part")
def p10(spark, sf_dir):
    i = (F.col("p_partkey") % 4 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), i)
    kind = review.media_type(pick("Application/JSON; charset=utf-8", " text/html", "image/png", "x/y"))
    return B.table(spark, sf_dir, "part").select("p_partkey", kind.alias("media_type"), review.extension(kind, pick("http://h/a", "http://h/b.htm", "http://h/c.PNG?x=.zip", "http://h/d.averylongsuffix")).alias("extension"))


# Kinds of values and whether each is valid: numbers must be finite, dates may be compact or by week.
VALUES = [
    ("number", "12.5", True), ("number", "-3e2", True), ("number", "1e999", False), ("number", "true", False), ("string", '"click"', True), ("string", '"\\t\\n"', False), ("boolean", "true", True),
    ("boolean", "1", False), ("date", '"2024-02-29"', True), ("date", '"2023-02-29"', False), ("date", '"20240229"', True), ("date", '"2024-W09-4"', True), ("date", '"2024W09"', True), ("date", '"2024-W094"', False),
    ("date", '"2023-W53"', False), ("date", '"2020-W53-7"', True), ("date", '"0000-01-01"', False), ("date", '"2024-2-9"', False), ("enum", '"one"', True), ("enum", '"other"', False), ("string_list", '["a", "b"]', True),
    ("string_list", '["a", 1]', False), ("string_list", '["a", " "]', False), ("string_list", "[]", True),
]


@query("F13", f"SELECT event_id, {[ok for _, _, ok in VALUES]!r}[event_id % {len(VALUES)} + 1] AND NOT (event_id % {len(VALUES)} = 0 AND value IS NULL) AS ok FROM events")
def f13(spark, sf_dir):
    e, i = B.table(spark, sf_dir, "events"), (F.col("event_id") % len(VALUES) + 1).cast("int")
    pick = lambda k: F.element_at(F.array(*[F.lit(v[k]) for v in VALUES]), i)
    value = F.when(i == 1, F.col("value").cast("string")).otherwise(pick(1))
    return e.select("event_id", review.valid_attribute(pick(0), value, F.array(F.lit("one"), F.lit("two"))).alias("ok"))


@query("F14", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN '' ELSE event_type END AS unknown, CASE WHEN event_type = 'click' AND value > 10 THEN 'view' WHEN event_type = 'view' AND value > 10 THEN 'click' ELSE 'click,view' END AS missing FROM events")
def f14(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    given = F.create_map("event_type", F.when(F.col("value") > 10, F.lit("x")))
    names = F.array(F.lit("click"), F.lit("view"))
    return e.withColumn("r", review.attribute_errors(given, names, names)).select("event_id", F.array_join("r.unknown", ",").alias("unknown"), F.array_join("r.missing", ",").alias("missing"))


@query("F15", "SELECT event_id, 'guidance.a' AS \"left\", 'guidance.b' AS \"right\" FROM events WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'earnings.eps_beat', 'earnings.eps_miss' FROM events WHERE event_id % 2 = 0")
def f15(spark, sf_dir):
    e, i = B.table(spark, sf_dir, "events"), F.col("event_id")
    labels = F.concat(F.array(F.lit("guidance.a"), F.lit("guidance.b"), F.lit("earnings.eps_beat")), F.when(i % 2 == 0, F.array(F.lit("earnings.eps_miss"))).otherwise(F.array().cast("array<string>")))
    channels = F.create_map(F.lit("guidance.a"), F.array(F.lit("revenue")), F.lit("guidance.b"), F.when(i % 3 == 0, F.array(F.lit("margin"))).when(i % 3 == 1, F.array(F.lit("revenue"))).otherwise(F.array().cast("array<string>")))
    pairs = spark.createDataFrame([("guidance.a", "guidance.b"), ("earnings.eps_beat", "earnings.eps_miss")], "left string, right string")
    return review.incompatible(e.select("event_id", labels.alias("labels"), channels.alias("channels")), pairs, "event_id", "labels", "channels")


@query("F18", "SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d %H') AS local FROM events")
def f18(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", F.date_format(F.from_utc_timestamp(B.utc("ts"), "America/New_York"), "yyyy-MM-dd HH").alias("local"))


@query("F19", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE epoch_us(date_trunc('second', ts)) END AS us FROM events")
def f19(spark, sf_dir):
    text = F.when(F.col("event_id") % 3 == 0, " ").otherwise(F.date_format(B.utc("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return B.table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))).alias("us"))


@query("J16", "SELECT event_id, a // 4 AS first_token, (a + n - 1) // 4 + 1 AS stop_token FROM (SELECT event_id, event_id % 30 AS a, 1 + event_id % 7 AS n FROM events)")
def j16(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.struct((i * 4).alias("start"), (i * 4 + 4).alias("stop")))
    s = e.select("event_id", tokens.alias("t"), (F.col("event_id") % 30).alias("a"), (F.col("event_id") % 30 + 1 + F.col("event_id") % 7).alias("b"))
    return review.tokens_over(s, "t", "a", "b").select("event_id", F.col("first_token").cast("long").alias("first_token"), F.col("stop_token").cast("long").alias("stop_token"))
