"""Queries of the annotation, graph and metric operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotation, asof, graph, ranking
from . import bindings as B
from .registry import query

R = f"WITH {B.RECORDS_SQL}"
CUR = R + ", cur AS (SELECT * FROM records r WHERE NOT EXISTS (SELECT 1 FROM records s WHERE s.supersedes_annotation_id = r.annotation_id))"


@query("J8", CUR + " SELECT annotation_id, event_id, annotator_id FROM cur")
def j8(spark, sf_dir):
    return annotation.current(B.records(spark, sf_dir)).select("annotation_id", "event_id", "annotator_id")


def _bad(records):
    """The history with planted faults: another annotator's target, a missing one, two for one."""
    k = F.col("event_id") % 5
    target = F.when((F.col("created_at") == 3) & (k == 0), F.col("annotation_id") - 1).when((F.col("created_at") == 3) & (k == 1), F.lit(-1)).when((F.col("created_at") == 3) & (k == 2), F.col("annotation_id") - 3).when((F.col("created_at") == 2) & (k == 2), F.col("annotation_id") - 2).when((F.col("created_at") == 0) & (k == 3), F.col("annotation_id") + 2)
    return records.withColumn("supersedes_annotation_id", target)


@query("W12", R + """, b AS (SELECT annotation_id, event_id, annotator_id, created_at, CASE WHEN created_at = 3 AND event_id % 5 = 0 THEN annotation_id - 1 WHEN created_at = 3 AND event_id % 5 = 1 THEN -1 WHEN created_at = 3 AND event_id % 5 = 2 THEN annotation_id - 3
   WHEN created_at = 2 AND event_id % 5 = 2 THEN annotation_id - 2 WHEN created_at = 0 AND event_id % 5 = 3 THEN annotation_id + 2 END AS s FROM records),
 l AS (SELECT x.*, o.annotation_id AS oid, o.annotator_id AS oa, o.created_at AS oc FROM b x LEFT JOIN b o ON x.s = o.annotation_id WHERE x.s IS NOT NULL)
 SELECT annotation_id, 'missing_target' AS error FROM l WHERE oid IS NULL UNION ALL SELECT annotation_id, 'superseded_twice' FROM l WHERE s IN (SELECT s FROM l GROUP BY s HAVING count(*) > 1)
 UNION ALL SELECT annotation_id, 'other_annotator' FROM l WHERE oa <> annotator_id UNION ALL SELECT annotation_id, 'time_not_increasing' FROM l WHERE created_at <= oc""")
def w12(spark, sf_dir):
    return annotation.chain_errors(_bad(B.records(spark, sf_dir)))


TASKS_SQL = "tasks AS (SELECT DISTINCT event_id, CASE event_id % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'calibration' ELSE 'regular' END AS annotation_round FROM records)"


def tasks(spark, sf_dir):
    k = F.col("event_id") % 3
    return B.records(spark, sf_dir).select("event_id", F.when(k == 0, "gold").when(k == 1, "calibration").otherwise("regular").alias("annotation_round")).distinct()


@query("J9", R + f", {TASKS_SQL}, own AS (SELECT DISTINCT annotator_id, event_id FROM records WHERE NOT (annotator_id = 'user' AND event_id % 7 = 3) AND NOT (annotator_id <> 'user' AND event_id % 11 = 4)), a AS (SELECT DISTINCT annotator_id FROM records) SELECT annotator_id, (SELECT event_id FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.annotator_id = a.annotator_id AND o.event_id = t.event_id) ORDER BY CASE annotation_round WHEN 'calibration' THEN 0 WHEN 'gold' THEN 1 ELSE 2 END, event_id LIMIT 1) AS event_id FROM a")
def j9(spark, sf_dir):
    r = B.records(spark, sf_dir)
    own = r.where("not (annotator_id = 'user' and event_id % 7 = 3) and not (annotator_id != 'user' and event_id % 11 = 4)")
    return annotation.next_task(tasks(spark, sf_dir), own, r.select("annotator_id").distinct())


@query("A14", CUR + f", {TASKS_SQL} SELECT count(*) AS total, sum(CASE WHEN EXISTS (SELECT 1 FROM cur c WHERE c.event_id = t.event_id AND annotator_id = 'assistant') THEN 1 ELSE 0 END)::BIGINT AS done FROM tasks t")
def a14(spark, sf_dir):
    done = annotation.current(B.records(spark, sf_dir)).where("annotator_id = 'assistant'").select("event_id", F.lit(1).alias("d")).distinct()
    return tasks(spark, sf_dir).join(done, "event_id", "left").agg(F.count("*").alias("total"), F.coalesce(F.sum("d"), F.lit(0)).alias("done"))


PAIRS = ", x AS (SELECT event_id, arg_max(decision, created_at) AS a FROM cur WHERE annotator_id = 'user' GROUP BY 1), y AS (SELECT event_id, arg_max(decision, created_at) AS b FROM cur WHERE annotator_id = 'assistant' GROUP BY 1)"


def pairs(spark, sf_dir):
    cur = annotation.current(B.records(spark, sf_dir))
    one = lambda who, name: cur.where(F.col("annotator_id") == who).groupBy("event_id").agg(F.max_by("decision", "created_at").alias(name))
    return tasks(spark, sf_dir).join(one("user", "a"), "event_id", "left").join(one("assistant", "b"), "event_id", "left")


@query("J15", CUR + f", {TASKS_SQL}" + PAIRS + " SELECT event_id, a, b FROM tasks LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id)")
def j15(spark, sf_dir):
    return pairs(spark, sf_dir).select("event_id", "a", "b")


P15_SQL = CUR + f", {TASKS_SQL}" + PAIRS + ", p AS (SELECT event_id, a, b FROM tasks LEFT JOIN x USING (event_id) LEFT JOIN y USING (event_id))"


@query("A15", P15_SQL + """ SELECT unnest(['tasks', 'completed_a', 'completed_b', 'paired', 'agreed']) AS measure, unnest([count(*), count(a), count(b), count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL), count(*) FILTER (WHERE a = b)])::BIGINT AS n, NULL::BIGINT AS event_id FROM p
UNION ALL SELECT 'disagreed', 1, event_id FROM p WHERE a <> b UNION ALL SELECT 'incomplete', 1, event_id FROM p WHERE a IS NULL OR b IS NULL""")
def a15(spark, sf_dir):
    return annotation.calibration_agreement(pairs(spark, sf_dir))


@query("A11", "WITH d AS (SELECT item_id AS event_id, 1 AS who, CASE WHEN item_id % 9 = 0 THEN 'guidance.x' WHEN item_id % 4 = 0 THEN 'earnings.b' ELSE 'earnings.a' END AS t FROM benchmark UNION ALL SELECT item_id, 2, 'earnings.a' FROM benchmark), p AS (SELECT event_id, count(DISTINCT t) AS v, count(DISTINCT split_part(t, '.', 1)) AS f FROM d GROUP BY 1) SELECT count(*) AS events, avg(CASE WHEN v = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS leaf_agreement, avg(CASE WHEN f = 1 THEN 1.0 ELSE 0 END)::DOUBLE AS family_agreement, count(*) FILTER (WHERE v > 1) AS disagreements FROM p")
def a11(spark, sf_dir):
    b = B.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("event_id"))
    one = b.withColumn("event_type", F.when(F.col("event_id") % 9 == 0, "guidance.x").when(F.col("event_id") % 4 == 0, "earnings.b").otherwise("earnings.a"))
    return annotation.agreement(one.unionByName(b.withColumn("event_type", F.lit("earnings.a"))))


@query("A12", CUR + " SELECT count(*) AS events, avg(CASE WHEN n > 1 THEN 1.0 ELSE 0 END)::DOUBLE AS double_fraction, count(*) FILTER (WHERE n > 1 AND v = 1) AS agreed FROM (SELECT event_id, count(DISTINCT annotator_id) AS n, count(DISTINCT decision) AS v FROM cur GROUP BY 1)")
def a12(spark, sf_dir):
    cur = annotation.current(B.records(spark, sf_dir)).groupBy("event_id").agg(F.countDistinct("annotator_id").alias("n"), F.countDistinct("decision").alias("v"))
    return cur.agg(F.count("*").alias("events"), F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)).alias("double_fraction"), F.count(F.when((F.col("n") > 1) & (F.col("v") == 1), 1)).alias("agreed"))


@query("A13", "WITH o AS (SELECT unnest(['click', 'view', 'signup', 'purchase', 'refund']) AS label), l AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1) SELECT label, coalesce(n, 0) AS n, coalesce(n, 0) < 20 AS rare FROM o LEFT JOIN l USING (label)")
def a13(spark, sf_dir):
    labelled = B.table(spark, sf_dir, "events").select(F.array("event_type").alias("labels"))
    return annotation.label_report(labelled, spark.createDataFrame([(x,) for x in ("click", "view", "signup", "purchase", "refund")], "label string"), 20)


@query("A16", f"WITH {B.VOTES_SQL}, c AS (SELECT user_id, day, value, count(*) AS support, min(ascii(model)) AS p, string_agg(model, ',' ORDER BY model) AS supporters FROM votes GROUP BY 1, 2, 3), r AS (SELECT *, sum(support) OVER (PARTITION BY user_id, day)::BIGINT AS voters, row_number() OVER (PARTITION BY user_id, day ORDER BY support DESC, p, value) AS i FROM c) SELECT user_id, strftime(day, '%Y-%m-%d') AS day, value, support, voters, supporters, CASE WHEN support = voters THEN 'unanimous' WHEN support * 2 > voters THEN 'strict_majority' ELSE 'model_priority_tiebreak' END AS rule FROM r WHERE i = 1")
def a16(spark, sf_dir):
    out = annotation.vote(B.votes(spark, sf_dir), ["user_id", "day"])
    return out.withColumn("day", F.col("day").cast("string"))


@query("A17", "SELECT user_id, median(value) AS confidence FROM events GROUP BY 1")
def a17(spark, sf_dir):
    return B.table(spark, sf_dir, "events").groupBy("user_id").agg(F.median("value").alias("confidence"))


@query("A18", "WITH q AS (SELECT user_id, event_type AS model, CAST(floor(value / 20) AS BIGINT) AS s, CAST(floor(value / 20) AS BIGINT) + 1 + event_id % 3 AS e FROM events), c AS (SELECT user_id, s, e, count(DISTINCT model) AS support FROM q GROUP BY 1, 2, 3) SELECT user_id, s AS \"start\", e AS stop, support FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY support DESC, e - s, s, e) = 1")
def a18(spark, sf_dir):
    s = F.floor(F.col("value") / 20).cast("long")
    q = B.table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("model"), s.alias("start"), (s + 1 + F.col("event_id") % 3).alias("stop"))
    return annotation.evidence(q, ["user_id"]).select("user_id", "start", "stop", "support")


@query("J13", "WITH t AS (SELECT conv_id * 1000 + turn AS task_id, conv_id % 20 AS entity_id, conv_id // 20 AS published, text FROM conversations) SELECT task_id, (SELECT substr(arg_max(p.text, (p.published, p.task_id)), 1, 1200) FROM t p WHERE p.entity_id = t.entity_id AND p.published < t.published) AS prior FROM t")
def j13(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("task_id"), (F.col("conv_id") % 20).alias("entity_id"), F.floor(F.col("conv_id") / 20).alias("published"), "text")
    return annotation.prior_disclosure(c).select("task_id", "prior")


# An order's entity is its customer in one year; its related group is the orders of one day and priority.
NODES_SQL = "nodes AS (SELECT o_orderkey AS event_id, o_custkey || '/' || year(o_orderdate) AS entity, strftime(o_orderdate, '%Y-%m-%d') || '/' || o_orderpriority AS related FROM orders)"
COMPONENT_SQL = f"""WITH RECURSIVE {NODES_SQL},
edges AS (SELECT a.event_id AS a, b.event_id AS b FROM nodes a JOIN nodes b USING (entity) UNION SELECT a.event_id, b.event_id FROM nodes a JOIN nodes b USING (related)),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
parts AS (SELECT a AS event_id, min(b) AS component FROM reach GROUP BY 1)"""
KEYS = ["entity", "related"]


def nodes(spark, sf_dir):
    o, day = B.table(spark, sf_dir, "orders"), F.col("o_orderdate").cast("date")
    return o.select(F.col("o_orderkey").alias("event_id"), F.concat_ws("/", F.col("o_custkey").cast("string"), F.year(day).cast("string")).alias("entity"), F.concat_ws("/", day.cast("string"), "o_orderpriority").alias("related"))


@query("U4", COMPONENT_SQL + " SELECT event_id, component FROM parts")
def u4(spark, sf_dir):
    return graph.components(nodes(spark, sf_dir), KEYS)


SPLIT_SQL = COMPONENT_SQL + """, g AS (SELECT component, count(*) AS size, sha256('sediment:' || string_agg(event_id::VARCHAR, '|' ORDER BY event_id::VARCHAR)) AS h FROM parts GROUP BY 1),
o AS (SELECT *, sum(size) OVER (ORDER BY h ROWS UNBOUNDED PRECEDING) - size AS before FROM g),
t AS (SELECT greatest(1, round_even(count(*) * 0.2, 0)) AS target FROM parts)"""


@query("F12", SPLIT_SQL + " SELECT component, h AS hash, size FROM g")
def f12(spark, sf_dir):
    parts = graph.components(nodes(spark, sf_dir), KEYS)
    return graph.group_hashes(parts, "sediment")


@query("W11", SPLIT_SQL + " SELECT event_id, component, CASE WHEN before < target THEN 'eval' ELSE 'train' END AS part FROM parts JOIN o USING (component), t")
def w11(spark, sf_dir):
    return graph.split(nodes(spark, sf_dir), KEYS, "sediment", 0.2)


@query("U2", SPLIT_SQL + ", p AS (SELECT n.*, CASE WHEN before < target THEN 'eval' ELSE 'train' END AS part FROM parts JOIN o USING (component) JOIN nodes n USING (event_id), t) SELECT (SELECT count(*) FROM (SELECT entity FROM p WHERE part = 'eval' INTERSECT SELECT entity FROM p WHERE part = 'train')) AS entities, (SELECT count(*) FROM (SELECT related FROM p WHERE part = 'eval' INTERSECT SELECT related FROM p WHERE part = 'train')) AS groups")
def u2(spark, sf_dir):
    n = nodes(spark, sf_dir)
    p = graph.split(n, KEYS, "sediment", 0.2).join(n, "event_id")
    both = lambda c, name: p.groupBy(c).agg(F.countDistinct("part").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias(name))
    return both("entity", "entities").join(both("related", "groups"), F.lit(True))


@query("U1", "SELECT count(*) AS leaked FROM (SELECT sha256(text) FROM documents WHERE doc_id % 5 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 5 <> 0)")
def u1(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 5 == 0).alias("test"))
    return d.groupBy("h").agg(F.max("test").alias("a"), F.min("test").alias("b")).agg(F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("leaked"))


@query("U3", "SELECT event_id, len(list_intersect(['click', 'view'], [event_type])) AS common, len(list_filter(['click', 'view'], lambda x: x <> event_type)) AS missing FROM events")
def u3(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").withColumn("want", F.array(F.lit("click"), F.lit("view"))).withColumn("have", F.array("event_type"))
    return e.select("event_id", F.size(F.array_intersect("want", "have")).cast("long").alias("common"), F.size(F.array_except("want", "have")).cast("long").alias("missing"))


@query("W10", "SELECT event_id, turn FROM (SELECT event_id, user_id % 13 AS s, row_number() OVER (PARTITION BY user_id % 13 ORDER BY event_id) AS turn FROM events) ORDER BY turn, s, event_id LIMIT 100")
def w10(spark, sf_dir):
    return annotation.round_robin(B.table(spark, sf_dir, "events"), F.col("user_id") % 13, "event_id", 100).select("event_id", F.col("turn").cast("long").alias("turn"))


@query("J4", "SELECT o_orderkey, c_mktsegment, count(*) AS n, round(sum(l_quantity), 4) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def j4(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
    l = B.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")  # noqa: E741
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("q"))


@query("J6", "SELECT CASE WHEN c.c_custkey IS NULL THEN 'missing_source' WHEN c.c_acctbal < 0 THEN 'missing_acceptance' ELSE 'ok' END AS reason, count(*) AS n FROM orders o LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 6 <> 0) c ON o.o_custkey = c.c_custkey GROUP BY 1")
def j6(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").where("c_custkey % 6 != 0").select("c_custkey", "c_acctbal")
    o = B.table(spark, sf_dir, "orders").select("o_custkey").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.groupBy(F.when(F.col("c_custkey").isNull(), "missing_source").when(F.col("c_acctbal") < 0, "missing_acceptance").otherwise("ok").alias("reason")).agg(F.count("*").alias("n"))


@query("J7", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NULL AS only_right FROM (SELECT doc_id FROM labels WHERE doc_id % 3 <> 0) a FULL JOIN (SELECT doc_id FROM labels WHERE doc_id % 4 <> 0) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def j7(spark, sf_dir):
    d = B.table(spark, sf_dir, "labels").select("doc_id")
    a, b = d.where("doc_id % 3 != 0"), d.where("doc_id % 4 != 0")
    return a.join(b, "doc_id", "left_anti").withColumn("only_right", F.lit(False)).unionByName(b.join(a, "doc_id", "left_anti").withColumn("only_right", F.lit(True)))


# The test fold holds the orders of every seventh month, each with a window of 1 to 10 days from its date.
FOLDS_SQL = "w AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(1 + o_orderkey % 10 AS INTEGER) AS e, (year(o_orderdate) * 12 + month(o_orderdate)) % 7 = 0 AS test FROM orders)"


@query("J14", f"WITH {FOLDS_SQL}, r AS (SELECT DISTINCT s, e FROM w WHERE NOT test) SELECT id FROM w t WHERE test AND EXISTS (SELECT 1 FROM r WHERE t.s < r.e AND r.s < t.e)")
def j14(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    w = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), day.alias("s"), F.date_add(day, (1 + F.col("o_orderkey") % 10).cast("int")).alias("e"), ((F.year(day) * 12 + F.month(day)) % 7 == 0).alias("test"))
    return asof.crossing(w, F.col("test"), "s", "e").select("id")


@query("T1", "SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS i FROM events")
def t1(spark, sf_dir):
    return ranking.numbered(B.table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id", "ts", "event_id"], "i").select("event_id", "i")


@query("T4", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 50")
def t4(spark, sf_dir):
    return B.table(spark, sf_dir, "events").select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(50)
