"""Queries of the text, baseline and probe operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import filing
from ..functions import text as T
from ..operators import baselines, probe
from . import bindings as B
from .registry import query

EX = f"WITH {B.EXAMPLES_SQL}"
TOKENS = ", tok AS (SELECT doc_id, label, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM examples), tk AS (SELECT * FROM tok WHERE length(t) >= 2)"


@query("A1", EX + " SELECT label, count(*) AS n FROM examples GROUP BY 1 ORDER BY n DESC, label LIMIT 1")
def a1(spark, sf_dir):
    return baselines.modal(B.examples(spark, sf_dir), "label").select("label", "n")


@query("A2", EX + " SELECT (SELECT label FROM examples GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1) AS label, round(avg(CASE WHEN label <> '' THEN 1.0 ELSE 0 END), 8)::DOUBLE AS material FROM examples")
def a2(spark, sf_dir):
    e = B.examples(spark, sf_dir)
    return e.agg(F.round(F.avg(F.when(F.col("label") != "", 1.0).otherwise(0.0)), 8).alias("material")).join(baselines.modal(e, "label").select("label"), F.lit(True)).select("label", "material")


@query("A3", EX + ", m AS (SELECT filing_type, label FROM examples WHERE doc_id % 3 <> 0 AND filing_type <> 'es' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY filing_type ORDER BY count(*) DESC, label) = 1) SELECT doc_id, coalesce(m.label, (SELECT label FROM examples WHERE doc_id % 3 <> 0 GROUP BY 1 ORDER BY count(*) DESC, label LIMIT 1)) AS guess FROM examples e LEFT JOIN m USING (filing_type) WHERE doc_id % 3 = 0")
def a3(spark, sf_dir):
    e = B.examples(spark, sf_dir)
    train, test = e.where("doc_id % 3 != 0"), e.where("doc_id % 3 = 0")
    by = baselines.modal(train.where("filing_type != 'es'"), "label", ["filing_type"]).select("filing_type", F.col("label").alias("own"))
    every = F.broadcast(baselines.modal(train, "label").select(F.col("label").alias("all")))
    return test.join(by, "filing_type", "left").join(every, F.lit(True)).select("doc_id", F.coalesce("own", "all").alias("guess"))


@query("A4", EX + ", c AS (SELECT label, filing_type AS attribute, quality::BIGINT AS value, count(*) AS n FROM examples GROUP BY 1, 2, 3) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY label, attribute ORDER BY n DESC, value) = 1")
def a4(spark, sf_dir):
    e = B.examples(spark, sf_dir).select("label", F.col("filing_type").alias("attribute"), F.col("quality").cast("long").alias("value"))
    return baselines.modal(e, "value", ["label", "attribute"]).select("label", "attribute", "value", "n")


@query("F7", EX + TOKENS + " SELECT doc_id, count(*) AS n FROM tk GROUP BY 1")
def f7(spark, sf_dir):
    return B.examples(spark, sf_dir).select("doc_id", F.size(baselines.words(F.col("text"))).cast("long").alias("n")).where("n > 0")


@query("A5", EX + TOKENS + " SELECT label, t AS token, count(*) AS n FROM tk GROUP BY 1, 2")
def a5(spark, sf_dir):
    return baselines.fit_bayes(B.examples(spark, sf_dir), "label", "text")[1].select("label", "token", "n")


BAYES_SQL = EX + TOKENS + """, train AS (SELECT * FROM tk WHERE doc_id % 4 <> 0), cls AS (SELECT label, count(*) AS docs FROM examples WHERE doc_id % 4 <> 0 GROUP BY 1),
tot AS (SELECT label, count(*) AS total FROM train GROUP BY 1), by_ AS (SELECT label, t, count(*) AS n FROM train GROUP BY 1, 2), voc AS (SELECT count(DISTINCT t) AS v FROM train),
k AS (SELECT doc_id, t, count(*) AS k FROM tk WHERE doc_id % 4 = 0 AND t IN (SELECT t FROM train) GROUP BY 1, 2),
g AS (SELECT k.doc_id, c.label, sum(k.k * ln((coalesce(b.n, 0) + 1.0::DOUBLE) / (coalesce(tot.total, 0) + voc.v))) AS gain FROM k CROSS JOIN cls c CROSS JOIN voc LEFT JOIN tot ON tot.label = c.label LEFT JOIN by_ b ON b.label = c.label AND b.t = k.t GROUP BY 1, 2),
s AS (SELECT e.doc_id, c.label, ln(c.docs / (SELECT sum(docs) FROM cls)::DOUBLE) + coalesce(g.gain, 0) AS logp FROM (SELECT doc_id FROM examples WHERE doc_id % 4 = 0) e CROSS JOIN cls c LEFT JOIN g ON g.doc_id = e.doc_id AND g.label = c.label)"""


def bayes(spark, sf_dir):
    e = B.examples(spark, sf_dir)
    return baselines.predict_bayes(e.where("doc_id % 4 = 0"), baselines.fit_bayes(e.where("doc_id % 4 != 0"), "label", "text"), "doc_id", "text")


@query("A6", BAYES_SQL + " SELECT doc_id, label, round(logp, 4) AS logp, round(exp(logp - max(logp) OVER (PARTITION BY doc_id)) / sum(exp(logp - (SELECT max(logp) FROM s z WHERE z.doc_id = s.doc_id))) OVER (PARTITION BY doc_id), 5) AS prob FROM s")
def a6(spark, sf_dir):
    return bayes(spark, sf_dir).select("doc_id", "label", F.round("logp", 4).alias("logp"), F.round("prob", 5).alias("prob"))


PAIR = "WITH p AS (SELECT CASE WHEN event_id % 5 = 0 THEN [] WHEN event_id % 2 = 0 THEN [event_type] ELSE [event_type, 'x'] END AS a, CASE WHEN value < 20 THEN [] WHEN event_id % 3 = 0 THEN ['x'] ELSE [event_type] END AS b, least(value / 200, 1.0) AS prob, event_id % 3 = 0 AS truth, event_id FROM events)"


def guesses(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    a = F.when(F.col("event_id") % 5 == 0, none).when(F.col("event_id") % 2 == 0, F.array("event_type")).otherwise(F.array("event_type", F.lit("x")))
    b = F.when(F.col("value") < 20, none).when(F.col("event_id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array("event_type"))
    return e.select("event_id", a.alias("a"), b.alias("b"), F.least(F.col("value") / 200, F.lit(1.0)).alias("prob"), (F.col("event_id") % 3 == 0).alias("truth"))


@query("A7", PAIR + ", q AS (SELECT CASE WHEN len(a) = 0 THEN ['no_material_event'] ELSE a END AS a, CASE WHEN len(b) = 0 THEN ['no_material_event'] ELSE b END AS b FROM p), s AS (SELECT count(*) AS n, sum(CASE WHEN list_sort(a) = list_sort(b) THEN 1 ELSE 0 END) AS same, sum(len(list_intersect(a, b))) AS tp, sum(len(a)) AS na, sum(len(b)) AS nb FROM q) SELECT n AS rows, round(same / n::DOUBLE, 8) AS exact, round(tp / nb::DOUBLE, 8) AS precision, round(tp / na::DOUBLE, 8) AS recall, round(2 * tp / (na + nb)::DOUBLE, 8) AS f1 FROM s")
def a7(spark, sf_dir):
    m = baselines.set_metrics(guesses(spark, sf_dir), "a", "b")
    return m.select("rows", *[F.round(c, 8).alias(c) for c in ("exact", "precision", "recall", "f1")])


@query("A8", PAIR + ", b AS (SELECT least(CAST(floor(prob * 5) AS INT), 4) AS b, count(*) AS n, avg(prob) AS p, avg(CASE WHEN truth THEN 1.0 ELSE 0 END) AS y, sum((prob - CASE WHEN truth THEN 1 ELSE 0 END) ** 2) AS sq FROM p GROUP BY 1) SELECT sum(n)::BIGINT AS rows, round(sum(sq) / sum(n), 8) AS brier, round(sum(n * abs(p - y)) / sum(n), 8) AS ece FROM b")
def a8(spark, sf_dir):
    m = baselines.calibration(guesses(spark, sf_dir), "prob", "truth")
    return m.select("rows", F.round("brier", 8).alias("brier"), F.round("ece", 8).alias("ece"))


@query("A9", "WITH p AS (SELECT event_id, range(event_id % 7, event_id % 7 + 5 + event_id % 11) AS a, range(event_id % 13, event_id % 13 + 4) AS b FROM events), s AS (SELECT sum(len(list_intersect(a, b))) AS tp, sum(len(a)) AS na, sum(len(b)) AS nb FROM p) SELECT round(tp / nb::DOUBLE, 8) AS precision, round(tp / na::DOUBLE, 8) AS recall, round(2 * tp / (na + nb)::DOUBLE, 8) AS f1 FROM s")
def a9(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    span = lambda a, n: F.array(F.struct(a.alias("start"), (a + n).alias("stop")))
    i = F.col("event_id")
    m = baselines.span_overlap(e.select(span(i % 7, 5 + i % 11).alias("a"), span(i % 13, F.lit(4)).alias("b")), "a", "b")
    return m.select(*[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query("A10", "WITH p AS (SELECT event_id % 17 AS a1, event_id % 5 AS a2, CAST(floor(value) AS BIGINT) % 17 AS b1, event_id % 3 AS b2 FROM events), s AS (SELECT count(*) AS n, sum((a1 = b1)::INT + (a2 = b2)::INT) AS tp, sum((a1 = b1 AND a2 = b2)::INT) AS exact FROM p) SELECT round(tp / (2 * n)::DOUBLE, 8) AS precision, round(tp / (2 * n)::DOUBLE, 8) AS recall, round(tp / (2 * n)::DOUBLE, 8) AS f1, round(exact / n::DOUBLE, 8) AS record_exact FROM s")
def a10(spark, sf_dir):
    e, i = B.table(spark, sf_dir, "events"), F.col("event_id")
    cell = lambda k, v: F.concat(F.lit(k), v.cast("long").cast("string"))
    d = e.select(F.array(cell("p=", i % 17), cell("q=", i % 5)).alias("a"), F.array(cell("p=", F.floor("value") % 17), cell("q=", i % 3)).alias("b"))
    m = baselines.set_metrics(d, "a", "b")
    return m.select(*[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], F.round("exact", 8).alias("record_exact"))


@query("F8", "SELECT p_partkey, levenshtein(p_name, 'small ring') <= 2 AS near FROM part")
def f8(spark, sf_dir):
    return B.table(spark, sf_dir, "part").select("p_partkey", T.near(F.col("p_name"), F.lit("small ring")).alias("near"))


@query("F5", "SELECT doc_id, lower(coalesce(source, '') || ['', ' Safe HARBOR', 'x', ' signatures'][doc_id % 4 + 1] || ' ' || coalesce(text, '')) SIMILAR TO '(.|\n)*(safe harbor|signature|forward-looking statement|pursuant to the requirements)(.|\n)*' AS boilerplate FROM documents")
def f5(spark, sf_dir):
    extra = F.element_at(F.array(*map(F.lit, ("", " Safe HARBOR", "x", " signatures"))), (F.col("doc_id") % 4 + 1).cast("int"))
    heading = F.concat(F.coalesce("source", F.lit("")), extra)
    return B.table(spark, sf_dir, "documents").select("doc_id", filing.is_boilerplate(heading, F.col("text")).alias("boilerplate"))


@query("F6", "WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) < 5 THEN 'unknown' WHEN len(list_filter(w, lambda x: x IN ('and', 'company', 'for', 'in', 'of', 'the', 'to'))) >= 2 THEN 'en' ELSE 'unknown' END AS language FROM w")
def f6(spark, sf_dir):
    w = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = B.table(spark, sf_dir, "documents").select("doc_id", w.alias("w"))
    hits = F.size(F.filter("w", lambda x: x.isin(*sorted(T.STOP_WORDS))))
    return d.select("doc_id", F.when((F.size("w") >= 5) & (hits >= 2), "en").otherwise("unknown").alias("language"))


@query("F11", "SELECT event_id, 'knowledge_' || sha256('events' || event_id || ':v1') AS id FROM events")
def f11(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    return e.select("event_id", F.concat(F.lit("knowledge_"), F.sha2(F.concat(F.lit("events"), F.col("event_id").cast("string"), F.lit(":v1")), 256)).alias("id"))


# All white space, for the SQL alone.
WHITE_SQL = " || ".join(f"chr({i})" for i in (9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288))
BLANK_SQL = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

# Every third text is led by blank paragraphs and padded; every seventh has nothing else.
PADDED_SQL = "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 7 = 0 THEN chr(9) || chr(10) || chr(160) || chr(10) WHEN (conv_id + turn) % 3 = 0 THEN chr(9) || chr(10) || chr(10) || '  ' || text || chr(12) || chr(10) || ' ' || chr(10) || 'more' ELSE text END AS text FROM conversations"


@query("F22", f"SELECT conv_id, turn, coalesce(list_filter(list_transform(string_split_regex(text, '\n{BLANK_SQL}*\n'), lambda x: trim(x, {WHITE_SQL})), lambda x: x <> '')[1], '') AS first_paragraph FROM ({PADDED_SQL})")
def f22(spark, sf_dir):
    c, i = B.table(spark, sf_dir, "conversations"), F.col("conv_id") + F.col("turn")
    text = F.when(i % 7 == 0, F.lit("\t\n\xa0\n")).when(i % 3 == 0, F.concat(F.lit("\t\n\n  "), "text", F.lit("\f\n \nmore"))).otherwise(F.col("text"))
    return c.select("conv_id", "turn", T.first_paragraph(text).alias("first_paragraph"))


# Tokens of a text: its words and the single characters of other kinds, white space being part of none. Every second span
# begins inside a word and every third ends with white space, so some can't be told in whole tokens.
SPANS_SQL = """WITH d AS (SELECT doc_id, text, doc_id % 90 AS a, doc_id % 90 + 5 + doc_id % 41 AS b FROM documents),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+|[ \t\n]+|[^A-Za-z0-9 \t\n]')) AS x, generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9]+|[ \t\n]+|[^A-Za-z0-9 \t\n]'), 1) AS k FROM d),
o AS (SELECT *, CAST(sum(length(x)) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS e FROM t),
w AS (SELECT doc_id, e - length(x) AS s, e, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i FROM o WHERE NOT regexp_matches(x, '^[ \t\n]')),
h AS (SELECT d.doc_id, min(i) AS first_token, max(i) + 1 AS stop_token, min(s) AS l, max(e) AS r, any_value(a) AS a, any_value(b) AS b, any_value(text) AS text FROM d JOIN w ON w.doc_id = d.doc_id AND s < b AND e > a GROUP BY 1),
g AS (SELECT doc_id, first_token, stop_token FROM h WHERE l <= a AND r >= b AND b <= length(text) AND trim(substr(text, l + 1, a - l), ' ' || chr(9) || chr(10)) = '' AND trim(substr(text, b + 1, r - b), ' ' || chr(9) || chr(10)) = '')"""


@query("F17", SPANS_SQL + " SELECT doc_id, first_token::BIGINT AS first_token, stop_token::BIGINT AS stop_token FROM d LEFT JOIN g USING (doc_id)")
def f17(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") % 90).cast("int").alias("a"), (F.col("doc_id") % 90 + 5 + F.col("doc_id") % 41).cast("int").alias("b"))
    span = T.token_span(F.col("text"), F.col("offsets"), F.col("a"), F.col("b"))
    return d.withColumn("offsets", T.token_offsets(F.col("text"))).withColumn("s", span).select("doc_id", F.col("s.first").cast("long").alias("first_token"), F.col("s.stop").cast("long").alias("stop_token"))


@query("P13", "SELECT doc_id, 'Filing type: ' || coalesce(nullif(lang, ''), 'unknown') || chr(10) || chr(10) || text AS input, length('Filing type: ' || coalesce(nullif(lang, ''), 'unknown')) + 2 AS at FROM documents".replace(" AS at ", " AS text_start "))
def p13(spark, sf_dir):
    head = F.concat(F.lit("Filing type: "), F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")), F.lit("\n\n"))
    return B.table(spark, sf_dir, "documents").select("doc_id", F.concat(head, "text").alias("input"), F.length(head).cast("long").alias("text_start"))


@query("F1")
def f1(spark, sf_dir):
    return B.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_text()("text").alias("clean"))


@query("F2")
def f2(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"), F.lit("8-K").alias("document_type"))
    return filing.normalize_filings(p).select("page_id", "language", "parsing_quality", F.size("sections").alias("n_sections"), F.sha2(F.to_json("sections"), 256).alias("sections_hash"))


def normalized_pages(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", F.encode("html", "UTF-8").alias("raw"), F.when(F.col("page_id") % 2 == 0, "EX-99.1").otherwise("8-K").alias("document_type"))
    return filing.normalize_filings(p)


@query("F3")
def f3(spark, sf_dir):
    out = normalized_pages(spark, sf_dir).select("page_id", F.posexplode("sections").alias("position", "s"))
    return out.select("page_id", "position", F.col("s.section_id").alias("section_id"), F.col("s.heading").alias("heading"), F.col("s.is_table").alias("is_table"), F.col("s.is_boilerplate").alias("is_boilerplate"), F.sha2("s.text", 256).alias("text_sha256"))


@query("F4")
def f4(spark, sf_dir):
    return normalized_pages(spark, sf_dir).select("page_id", "is_exhibit", F.array_join("warnings", ",").alias("warnings"), "parsing_quality")


@query("F9")
def f9(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.substring("text", 10, 40).alias("quote"))
    return c.withColumn("a", T.align_quote()("text", "quote")).select("conv_id", "turn", "a.start", "a.stop")


def probed(spark, sf_dir):
    """Heads on four vectors of five, and what they say of the fifth."""
    e = B.table(spark, sf_dir, "embeddings")
    heads = probe.fit_heads(e.where("vec_id % 5 != 0"), "label", "embedding")
    test = e.where("vec_id % 5 = 0")
    return test, probe.predict_heads(test, heads, "vec_id", "embedding")


@query("A26")
def a26(spark, sf_dir):
    return probed(spark, sf_dir)[1].select("vec_id", "label", F.round("prob", 6).alias("prob"))


@query("C12")
def c12(spark, sf_dir):
    """The probe's report; the frozen encoder's vectors are given."""
    test, told = probed(spark, sf_dir)
    cells = told.join(test.select("vec_id", F.col("label").cast("string").alias("own")), "vec_id")
    return probe.probe_report(cells, F.col("label") == F.col("own"))
