"""Queries of releases, packages, collection runs and row contracts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import baselines, collection, contracts, graph, panels, releases
from ..operators.tables import shared_dir, stored
from ..sources import sinks
from . import bindings as B
from .annotation_queries import KEYS, SPLIT_SQL
from .registry import query
from .text_queries import BAYES_SQL

# --- releases: an order is a task; every fourth has two annotators, who differ on every eighth ------------------------


def tasks(spark, sf_dir):
    o, day, key = B.table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date").cast("string"), F.col("o_orderkey")
    return o.select(
        key.alias("event_id"), F.concat_ws("/", F.col("o_custkey").cast("string"), F.substring(day, 1, 4)).alias("entity_id"), F.concat_ws("/", day, "o_orderpriority").alias("related_event_group"),
        F.lit("gold").alias("annotation_round"), F.concat(F.lit("Order "), key.cast("string"), F.lit(" is "), F.col("o_orderstatus")).alias("text"), F.col("o_orderpriority").alias("filing_type"),
        F.when(key % 3 != 0, F.concat(F.lit("after "), key.cast("string"))).alias("prior"), day.alias("source_published_at"), day.alias("tradable_at"),
    )


def records(spark, sf_dir):
    o, key = B.table(spark, sf_dir, "orders").select("o_orderkey"), F.col("o_orderkey")
    none, up, down = F.array().cast("array<string>"), F.array(F.lit("guidance.raised")), F.array(F.lit("guidance.lowered"))
    row = lambda i, who, status, labels, at, old, when: F.when(when, F.struct((key * 10 + i).alias("annotation_id"), F.lit(who).alias("annotator_id"), F.lit(status).alias("status"), labels.alias("labels"), F.lit(at).alias("created_at"), (key * 10 + old if old else F.lit(None).cast("long")).alias("supersedes_annotation_id")))
    five, four, eight = key % 5 == 0, key % 4 == 0, key % 8 == 0
    rows = F.array(
        row(1, "a", "submitted", up, 1, 0, F.lit(True)), row(2, "a", "submitted", none, 2, 1, five), row(3, "b", "needs_adjudication", F.when(eight, down).when(five, none).otherwise(up), 1, 0, four),
        row(4, "j", "adjudicated", F.array(F.lit("guidance.lowered"), F.lit("earnings.beat")), 3, 0, eight), row(5, "c", "excluded", down, 1, 0, key % 7 == 0),
    )
    return o.select(key.alias("event_id"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("event_id", "r.*")


MEMBERS_SQL = SPLIT_SQL + """, m AS (
  SELECT event_id, component, CASE WHEN before < target THEN 'eval' ELSE 'train' END AS part,
         CASE WHEN event_id % 8 = 0 THEN event_id * 10 + 4 WHEN event_id % 5 = 0 THEN event_id * 10 + 2 ELSE event_id * 10 + 1 END AS annotation_id,
         CASE WHEN event_id % 8 = 0 THEN ['earnings.beat', 'guidance.lowered'] WHEN event_id % 5 = 0 THEN ['no_material_event'] ELSE ['guidance.raised'] END AS labels,
         event_id % 4 = 0 AS double, event_id % 4 = 0 AND event_id % 8 <> 0 AS exact, event_id % 4 = 0 AND (event_id % 8 <> 0 OR event_id % 5 <> 0) AS family
  FROM parts JOIN o USING (component), t)"""


def members(spark, sf_dir):
    return releases.release(tasks(spark, sf_dir), records(spark, sf_dir), "sediment", 0.2)


@query("C8_members", MEMBERS_SQL + " SELECT event_id, annotation_id, array_to_string(labels, ',') AS labels, \"double\", exact, family, component, part FROM m")
def c8_members(spark, sf_dir):
    return members(spark, sf_dir).withColumn("labels", F.array_join("labels", ",")).select("event_id", "annotation_id", "labels", "double", "exact", "family", "component", "part")


@query("C8", MEMBERS_SQL + """, c AS (SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM m) GROUP BY 1),
ont AS (SELECT label, coalesce(n, 0) AS n FROM (SELECT unnest(['guidance.raised', 'guidance.lowered', 'earnings.beat', 'earnings.miss', 'no_material_event']) AS label) LEFT JOIN c USING (label))
SELECT count(*) AS events, count(*) FILTER (WHERE part = 'train') AS train, count(*) FILTER (WHERE part = 'eval') AS eval, count(*) FILTER (WHERE "double") AS "double",
  round(count(*) FILTER (WHERE "double") / count(*)::DOUBLE, 8) AS double_fraction, round(count(*) FILTER (WHERE exact) / (count(*) FILTER (WHERE "double"))::DOUBLE, 8) AS exact_agreement,
  round(count(*) FILTER (WHERE family) / (count(*) FILTER (WHERE "double"))::DOUBLE, 8) AS family_agreement, count(*) FILTER (WHERE "double" AND NOT exact) AS adjudicated,
  (SELECT string_agg(label || '=' || n, ',' ORDER BY label || '=' || n) FROM ont WHERE n > 0) AS classes, (SELECT string_agg(label || '=' || n, ',' ORDER BY label || '=' || n) FROM ont WHERE n < 200) AS rare_labels,
  (SELECT count(*) FROM (SELECT entity FROM m JOIN nodes USING (event_id) GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS entities, (SELECT count(*) FROM (SELECT related FROM m JOIN nodes USING (event_id) GROUP BY 1 HAVING count(DISTINCT part) > 1)) AS groups, count(*) BETWEEN 100 AND 100000000 AND count(*) FILTER (WHERE "double") / count(*)::DOUBLE >= 0.2 AND count(*) FILTER (WHERE part = 'train') > 0 AS contract_passed FROM m""")
def c8(spark, sf_dir):
    ontology = spark.createDataFrame([("guidance.raised",), ("guidance.lowered",), ("earnings.beat",), ("earnings.miss",)], "label string")
    out = releases.release_report(members(spark, sf_dir), tasks(spark, sf_dir), ontology, 200, 100, 100_000_000, 0.2)
    return out.withColumns({c: F.round(c, 8) for c in ("double_fraction", "exact_agreement", "family_agreement")})


LINE_SQL = """'{"event_id":' || event_id || ',"input":{"filing_type":"' || o_orderpriority || '","prior_company_disclosure":' || CASE WHEN event_id % 3 <> 0 THEN '"after ' || event_id || '"' ELSE 'null' END
 || ',"source_published_at":"' || strftime(o_orderdate, '%Y-%m-%d') || '","text":"Order ' || event_id || ' is ' || o_orderstatus || '","tradable_at":"' || strftime(o_orderdate, '%Y-%m-%d')
 || '"},"target":{"labels":' || CASE WHEN event_id % 8 = 0 THEN '["earnings.beat","guidance.lowered"],"no_material_event":false' WHEN event_id % 5 = 0 THEN '[],"no_material_event":true' ELSE '["guidance.raised"],"no_material_event":false' END || '}}'"""


@query("P12", f"SELECT event_id, {LINE_SQL} AS line FROM (SELECT o_orderkey AS event_id, * FROM orders)")
def p12(spark, sf_dir):
    found = releases.resolved(records(spark, sf_dir)).withColumn("part", F.lit("all"))
    return releases.model_rows(found, tasks(spark, sf_dir)).select("event_id", "line")


PACKAGE_SQL = MEMBERS_SQL + f""", train AS (SELECT * FROM m WHERE part = 'train'),
g2 AS (SELECT component, count(*) AS size, sha256('development:' || string_agg(event_id::VARCHAR, '|' ORDER BY event_id::VARCHAR)) AS h FROM train GROUP BY 1),
o2 AS (SELECT *, sum(size) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS before FROM g2), t2 AS (SELECT greatest(1, round_even(count(*) * 0.2, 0)) AS target FROM train),
r AS (SELECT event_id, CASE WHEN o2.before < t2.target THEN 'validation' ELSE 'train' END AS part FROM train JOIN o2 USING (component), t2),
lines AS (SELECT event_id, part, {LINE_SQL} AS line FROM r JOIN orders ON event_id = o_orderkey)"""


def package(spark, sf_dir):
    """The development package: the release's training part, which is whole components, split again by these; sealed rows
    are kept out."""
    train = members(spark, sf_dir).where("part = 'train'").drop("part")
    parts = graph.split_components(train.select("event_id", "component"), "development", 0.2)
    named = train.drop("component").join(parts.withColumn("part", F.when(F.col("part") == "eval", "validation").otherwise("train")), "event_id")
    return releases.model_rows(named, tasks(spark, sf_dir))


@query("C11", PACKAGE_SQL + " SELECT event_id, part, sha256(line) AS line_sha256 FROM lines")
def c11(spark, sf_dir):
    return package(spark, sf_dir).select("event_id", "part", F.sha2("line", 256).alias("line_sha256"))


@query("K7", PACKAGE_SQL + " SELECT part AS name, count(*) AS items, sha256(string_agg(line || chr(10), '' ORDER BY event_id)) AS sha256 FROM lines GROUP BY 1")
def k7(spark, sf_dir):
    path = f"{shared_dir(spark)}/sediment/package-{uuid.uuid4().hex}"
    rows = stored(package(spark, sf_dir), "package-rows")
    return releases.write_package(rows, path, ["train", "validation"]).where("part is null").drop("part")


@query("F16", "SELECT event_id, array_to_string(list_sort(list_distinct([event_type, 'guidance', 'guidance', split_part(event_type || 's', '.', 1)])), ',') AS families FROM events")
def f16(spark, sf_dir):
    dotted = lambda family, leaf: F.concat(family, F.lit("."), leaf)
    given = F.array(dotted(F.col("event_type"), F.lit("a.b")), F.lit("guidance.up"), F.lit("guidance.down"), F.concat("event_type", F.lit("s")))
    return B.table(spark, sf_dir, "events").select("event_id", F.array_join(releases.families(given), ",").alias("families"))


# --- baselines --------------------------------------------------------------------------------------------------------


@query("C10", BAYES_SQL + """, test AS (SELECT * FROM examples WHERE doc_id % 4 = 0), tr AS (SELECT * FROM examples WHERE doc_id % 4 <> 0),
ev AS (SELECT (SELECT label FROM tr GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) AS g, (SELECT avg(CASE WHEN label <> '' THEN 1.0 ELSE 0 END)::DOUBLE FROM tr) AS p),
ty AS (SELECT filing_type, arg_max(label, (n, -rank)) AS g, sum(n) FILTER (WHERE label <> '') / sum(n)::DOUBLE AS p FROM (SELECT *, row_number() OVER (PARTITION BY filing_type ORDER BY n DESC, label) AS rank FROM (SELECT filing_type, label, count(*) AS n FROM tr GROUP BY 1, 2)) GROUP BY 1),
e1 AS (SELECT doc_id, label, logp, exp(logp - max(logp) OVER (PARTITION BY doc_id)) AS e FROM s),
nb AS (SELECT doc_id, sum(e) FILTER (WHERE label <> '') / sum(e) AS p FROM e1 GROUP BY 1), nbg AS (SELECT doc_id, label AS g FROM e1 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(logp, 6) DESC, label) = 1),
a AS (SELECT 'global_frequency' AS model, label AS truth, ev.g, ev.p FROM test, ev
  UNION ALL SELECT 'filing_type_frequency', label, coalesce(ty.g, ev.g), coalesce(coalesce(ty.p, CASE WHEN ty.g IS NOT NULL THEN 0 END), ev.p) FROM test LEFT JOIN ty USING (filing_type), ev
  UNION ALL SELECT 'lexical_naive_bayes', label, nbg.g, coalesce(nb.p, 0) FROM test JOIN nb USING (doc_id) JOIN nbg USING (doc_id)),
l AS (SELECT model, p, truth <> '' AS y, list_filter(string_split(truth, '|'), lambda x: x <> '') AS t0, list_filter(string_split(g, '|'), lambda x: x <> '') AS g0 FROM a),
l2 AS (SELECT *, CASE WHEN len(t0) = 0 THEN ['no_material_event'] ELSE t0 END AS t1, CASE WHEN len(g0) = 0 THEN ['no_material_event'] ELSE g0 END AS g1 FROM l),
met AS (SELECT model, count(*) AS rows, avg((list_sort(t1) = list_sort(g1))::INT) AS exact, sum(len(list_intersect(t1, g1))) AS tp, sum(len(t1)) AS na, sum(len(g1)) AS nb, avg((p - y::INT) ** 2) AS brier FROM l2 GROUP BY 1),
ece AS (SELECT model, sum(n * abs(p - y)) / sum(n) AS ece FROM (SELECT model, least(floor(p * 5), 4) AS b, count(*) AS n, avg(p) AS p, avg(y::INT) AS y FROM l2 GROUP BY 1, 2) GROUP BY 1)
SELECT model, rows, round(exact, 6) AS exact, round(tp / nb::DOUBLE, 6) AS precision, round(tp / na::DOUBLE, 6) AS recall, round(2 * tp / (na + nb)::DOUBLE, 6) AS f1, round(brier, 6) AS brier, round(ece, 6) AS ece FROM met JOIN ece USING (model)""")
def c10(spark, sf_dir):
    e = B.examples(spark, sf_dir)
    out = baselines.report(e.where("doc_id % 4 != 0"), e.where("doc_id % 4 = 0"), "doc_id", "label", "filing_type", "text")
    return out.select("model", "rows", *[F.round(c, 6).alias(c) for c in ("exact", "precision", "recall", "f1", "brier", "ece")])


# --- collection -------------------------------------------------------------------------------------------------------


def C3_SQL():
    return f"""WITH {B.days_sql(1994, 2002)},
src AS (SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 THEN TIMESTAMP '1997-01-01' + to_hours(CAST(c_custkey % 1500 * 7 AS INTEGER)) END AS pub FROM customer WHERE c_custkey % 6 <> 0),
j AS (SELECT o_orderkey AS n, o_custkey AS s, id, pub FROM orders LEFT JOIN src ON o_custkey = id),
k AS (SELECT j.*, CASE WHEN pub < open_utc THEN open_utc + INTERVAL 15 MINUTE WHEN pub < close_utc THEN next_open_utc ELSE next_open_utc + INTERVAL 15 MINUTE END AS t
      FROM j LEFT JOIN days ON CAST(timezone('America/New_York', timezone('UTC', pub)) AS DATE) = calendar_date)
SELECT n AS normalization_id, CASE WHEN id IS NULL THEN 'missing_source' WHEN pub IS NULL THEN 'missing_acceptance' WHEN s % 11 = 0 THEN 'unresolved_entity' END AS skipped,
  CASE WHEN pub IS NOT NULL AND s % 11 <> 0 THEN 'knowledge_' || sha256('sec-normalized:' || n || ':v1') END AS record_id, CASE WHEN pub IS NOT NULL AND s % 11 <> 0 THEN s * 2 END AS entity_id,
  CASE WHEN pub IS NOT NULL AND s % 11 <> 0 THEN 'acc' || s || ':' || s END AS knowledge_key, CASE WHEN pub IS NOT NULL AND s % 11 <> 0 THEN epoch_us(t) END AS tradable_us FROM k"""


@query("C3", C3_SQL)
def c3(spark, sf_dir):
    c, o = B.table(spark, sf_dir, "customer"), B.table(spark, sf_dir, "orders")
    key = F.col("c_custkey")
    at = F.when(F.col("c_acctbal") >= 0, F.lit("1997-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=(key % 1500 * 7).cast("int")))
    sources = c.where("c_custkey % 6 != 0").select(key.alias("document_id"), F.concat(F.lit("acc"), key.cast("string")).alias("accession_number"), key.alias("cik"), at.alias("acceptance_at"))
    entities = c.where("c_custkey % 11 != 0").select(key.alias("cik"), (key * 2).alias("entity_id"))
    done = o.select(F.col("o_orderkey").alias("normalization_id"), F.col("o_custkey").alias("source_document_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("output_hash"))
    out = collection.materialized(done, sources, B.order_days(spark), "v1", entities)
    return out.select("normalization_id", "skipped", "record_id", "entity_id", "knowledge_key", F.unix_micros("tradable_at").alias("tradable_us"))


RUN_SQL = """WITH src AS (SELECT page_id AS id, page_id // 3 AS acc, page_id % 3 + 1 AS seq, ['8-K', 'EX-99.1', '10-Q'][page_id % 3 + 1] AS kind, sha256(html) AS hash, CASE WHEN page_id % 7 = 3 THEN 'bad' ELSE sha256(html) END AS declared FROM pages),
pri AS (SELECT acc, arg_min(id, (seq, id)) AS p FROM src WHERE kind <> 'EX-99.1' GROUP BY 1),
run AS (SELECT src.*, pri.p, CASE WHEN id % 10 = 0 AND declared = hash THEN 'reused' WHEN declared = hash THEN 'completed' ELSE 'failed' END AS status FROM src LEFT JOIN pri USING (acc))
"""


def normalization(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").where("html is not null")
    i, whole = F.col("page_id"), F.sha2("html", 256)
    kind = F.element_at(F.array(F.lit("8-K"), F.lit("EX-99.1"), F.lit("10-Q")), (i % 3 + 1).cast("int"))
    sources = p.select(i.alias("document_id"), F.floor(i / 3).cast("string").alias("accession_number"), kind.alias("document_type"), (i % 3 + 1).cast("string").alias("sequence"), F.when(i % 7 == 3, "bad").otherwise(whole).alias("content_hash"), F.encode("html", "UTF-8").alias("raw"))
    done = p.where("page_id % 5 = 0").select(i.alias("source_document_id"), F.when(i % 10 == 0, whole).otherwise("old").alias("content_hash"), F.lit("v1").alias("parser_version"), F.lit(True).alias("success"))
    return done, collection.normalization_run(sources, done, "v1")


@query("C6", RUN_SQL + "SELECT id AS source_document_id, status, kind = 'EX-99.1' AS is_exhibit, CASE WHEN kind = 'EX-99.1' THEN p END AS parent_document_id, status <> 'failed' AS success, status = 'completed' AS has_output FROM run WHERE hash IS NOT NULL")
def c6(spark, sf_dir):
    out = normalization(spark, sf_dir)[1]
    return out.select("source_document_id", "status", "is_exhibit", "parent_document_id", "success", F.col("output_hash").isNotNull().alias("has_output"))


@query("K6", RUN_SQL + "SELECT id AS source_document_id, status <> 'failed' AS success, CASE WHEN status = 'failed' THEN 'ValueError' END AS error FROM run WHERE hash IS NOT NULL")
def k6(spark, sf_dir):
    done, out = normalization(spark, sf_dir)
    cols = ["source_document_id", "parser_version", "content_hash", "success", "error", "seq"]
    old = done.withColumns({"error": F.lit(None).cast("string"), "seq": F.lit(0)}).select(*cols)
    new = out.where("status != 'reused'").withColumn("seq", F.lit(1)).select(*cols)
    return sinks.upsert(old, new, ["source_document_id", "parser_version"], "seq").select("source_document_id", "success", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"))


@query("K10", f"WITH {B.REQUESTS_SQL}, e AS (SELECT r.*, event_type = 'view' AS old FROM requests r JOIN events ON request_id = event_id), m AS (SELECT max(request_id) AS m FROM e WHERE old) SELECT request_id, url, status FROM e WHERE old UNION ALL SELECT m + row_number() OVER (ORDER BY request_id), url, status FROM e, m WHERE NOT old")
def k10(spark, sf_dir):
    r = B.requests(spark, sf_dir).drop("content_hash").join(B.table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "event_type"), "request_id")
    log, new = (r.where(c).drop("event_type") for c in ("event_type = 'view'", "event_type != 'view'"))
    return collection.request_log(log, new, ["request_id"]).select("request_id", "url", "status")


@query("K11", """SELECT c_name AS run_id, '{"a":' || c_custkey || ',"z":{"k":"' || c_mktsegment || '"}}' AS config, sha256('{"a":' || c_custkey || ',"z":{"k":"' || c_mktsegment || '"}}') AS config_hash FROM customer WHERE c_custkey % 2 = 1""")
def k11(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    config = F.concat(F.lit('{"z": {"k": "'), F.col("c_mktsegment"), F.lit('"},\n "a": '), F.col("c_custkey").cast("string"), F.lit("}"))
    runs = c.select(F.col("c_name").alias("run_id"), F.lit("m1").alias("model_version"), config.alias("config"), "c_custkey")
    ledger = collection.ledger_rows(runs.where("c_custkey % 2 = 0").drop("c_custkey"))
    return collection.record_runs(ledger, runs.drop("c_custkey")).select("run_id", "config", "config_hash")


# --- row contracts ----------------------------------------------------------------------------------------------------


@query("P11", "SELECT event_id, value > 0 AND value + event_id % 3 - 1 >= value AND value - 2 > 0 AS bar, event_id % 4 <> 1 AS in_order, event_id % 5 < 3 AS span, event_id % 6 IN (0, 2, 5) AS labels FROM events")
def p11(spark, sf_dir):
    i, v, at = F.col("event_id"), F.col("value"), B.utc("ts")
    none, one = F.array().cast("array<string>"), F.array(F.lit("a"))
    later = at + F.when(i % 4 == 1, F.expr("interval -1 second")).otherwise(F.expr("interval 1 second"))
    start = F.when(i % 5 == 3, -1).otherwise(i % 5).cast("int")
    given = F.when(i % 3 == 0, none).when(i % 3 == 1, F.array(F.lit("a"), F.lit("a"))).otherwise(one)
    return B.table(spark, sf_dir, "events").select(
        "event_id", contracts.bar(v, v + i % 3 - 1, v - 2, v - 1, F.lit(0)).alias("bar"), contracts.in_order(at, F.when(i % 2 == 1, F.lit(None).cast("timestamp")).otherwise(at), later).alias("in_order"),
        contracts.span(F.lit("abcdefgh"), start, F.when(i % 5 == 4, 9).otherwise(start + 3).cast("int"), F.substring(F.lit("abcdefgh"), F.greatest(start, F.lit(0)) + 1, F.lit(3))).alias("span"),
        contracts.labels(given, F.when(i % 6 == 3, False).otherwise(i % 3 == 0)).alias("labels"),
    )


@query("P9", "SELECT c_custkey, c_custkey % 5 <> 0 OR DATE '1998-01-01' + CAST(c_custkey % 31 AS INTEGER) < DATE '1999-01-01' - CAST(c_custkey % 900 AS INTEGER) AS tradable FROM customer")
def p9(spark, sf_dir):
    k = F.col("c_custkey")
    gone = F.when(k % 5 == 0, F.date_sub(F.lit("1999-01-01").cast("date"), (k % 900).cast("int")))
    return B.table(spark, sf_dir, "customer").select("c_custkey", contracts.tradable(F.date_add(F.lit("1998-01-01").cast("date"), (k % 31).cast("int")), gone).alias("tradable"))


# --- queues and panels ------------------------------------------------------------------------------------------------


@query("C7")
def c7(spark, sf_dir):
    from .review_queries import sections

    d = B.table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "source", "lang")
    usable = sections(spark, sf_dir).where(F.exists("sections", lambda s: ~s["is_table"] & (F.trim(s["text"]) != "")))
    usable = usable.select(F.col("doc_id").alias("normalization_id"), "sections")
    known = d.join(usable.select(F.col("normalization_id").alias("doc_id")), "doc_id").select(
        F.col("doc_id").alias("normalization_id"), F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"), F.concat_ws("/", "source", (F.col("doc_id") % 50).cast("string")).alias("entity_id"), (F.col("doc_id") % 50).alias("cik"),
        (F.col("doc_id") % 7).cast("string").alias("accession_number"), F.col("lang").alias("document_type"), F.floor(F.col("doc_id") / 100).alias("source_published_at"), F.floor(F.col("doc_id") / 100).alias("tradable_at"),
    )
    companies = spark.range(40).select(F.col("id").alias("cik"), F.concat(F.lit("Company "), F.col("id").cast("string")).alias("name"))
    out = panels.calibration_tasks(usable, known, companies)
    return out.withColumn("candidate_evidence", F.to_json("candidate_evidence"))


@query("C9", """SELECT p_partkey AS task_number, 'task-' || p_partkey AS task_id, CASE WHEN p_partkey % 4 = 0 THEN 'A' ELSE 'A,B,C' END AS source_models,
  CASE WHEN p_partkey % 4 = 0 THEN 0.9 WHEN p_size % 2 = 0 THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN p_partkey % 4 = 0 THEN p_size ELSE p_size + 1 END::BIGINT AS size, CASE WHEN p_partkey % 4 = 0 THEN 'unanimous' ELSE 'strict_majority' END AS rule,
  CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE length(split_part(p_name, ' ', 1)) + 1 END::BIGINT AS start, CASE WHEN p_partkey % 4 = 0 THEN length(split_part(p_name, ' ', 1)) ELSE length(split_part(p_name, ' ', 1)) + 1 + length(split_part(p_name, ' ', 2)) END::BIGINT AS stop,
  CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 9 = 1 THEN 'B=task_' || p_partkey ELSE '' END AS repairs, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 10 = 3 THEN 'other_labels' END AS error
FROM part WHERE split_part(p_name, ' ', 1) <> split_part(p_name, ' ', 2)""")
def c9(spark, sf_dir):
    p = B.table(spark, sf_dir, "part").where("split_part(p_name, ' ', 1) != split_part(p_name, ' ', 2)")
    key, name, one = F.col("p_partkey"), F.concat(F.lit("task-"), F.col("p_partkey").cast("string")), F.array(F.lit("deal.x"))
    word = lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    decisions = p.select(key.alias("task_number"), name.alias("task_id"), one.alias("labels"), (key % 4 == 0).alias("adjudicated"), F.array(*map(F.lit, "ABC")).alias("supporters"))

    def row(model, task_id, labels, confidence, size, quote):
        cell, said = F.array(F.struct(F.lit("deal.x").alias("label"), F.lit("size").alias("field"), size.cast("long").alias("value"))), F.array(F.struct(F.lit("deal.x").alias("label"), quote.alias("quote")))
        return p.select(F.lit(model).alias("model"), key.alias("task_number"), task_id.alias("task_id"), labels.alias("labels"), confidence.cast("double").alias("confidence"), (F.col("p_size") > 20).alias("ambiguity_flag"), cell.alias("attributes"), said.alias("evidence"))

    rows = row("A", name, one, F.lit(0.9), F.col("p_size"), word(1))
    rows = rows.unionByName(row("B", F.when(key % 9 == 1, F.translate(name, "-", "_")).otherwise(name), one, F.when(F.col("p_size") % 2 == 0, 0.3).otherwise(0.5), F.col("p_size") + 1, word(2)))
    rows = rows.unionByName(row("C", name, F.when(key % 10 == 3, F.array(F.lit("deal.y"))).otherwise(one), F.lit(0.1), F.col("p_size") + 1, F.concat(word(2), F.lit("."))))
    out = panels.synthesized(decisions, rows, p.select(name.alias("task_id"), F.col("p_name").alias("text")))
    cell, span = F.get("attributes", F.lit(0)), F.get("evidence", F.lit(0))
    return out.select(
        "task_number", "task_id", F.array_join("source_models", ",").alias("source_models"), "confidence", cell["value"].alias("size"), cell["rule"].alias("rule"),
        span["start"].cast("long").alias("start"), span["stop"].cast("long").alias("stop"), F.array_join("task_id_repairs", ",").alias("repairs"), "error",
    )
