"""Queries of sources and sinks: files are rebuilt from the driver's tables and read back by the parsers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds
from ..operators.tables import shared_dir, stored
from ..sources import content_store, sqlite_tables
from ..sources import filings as S
from ..sources import sinks as K
from . import bindings as B
from .registry import query

RQ = f"WITH {B.REQUESTS_SQL}"


@query("S2", RQ + " SELECT url, max(request_id) AS request_id, arg_max(content_hash, request_id) AS content_hash FROM requests WHERE status = 200 AND content_hash IS NOT NULL GROUP BY 1")
def s2(spark, sf_dir):
    return S.latest_success(B.requests(spark, sf_dir)).select("url", "request_id", "content_hash")


@query("S3", RQ + " SELECT request_id, content_hash <> lag(content_hash) OVER (PARTITION BY url ORDER BY request_id) AS content_changed FROM requests WHERE status = 200 AND content_hash IS NOT NULL")
def s3(spark, sf_dir):
    return S.content_changes(B.requests(spark, sf_dir)).select("request_id", "content_changed")


def submissions(spark, sf_dir):
    """One columnar JSON a customer, recent shape for even keys and flat for odd ones."""
    o = B.table(spark, sf_dir, "orders")
    form = F.element_at(F.array(*map(F.lit, ("8-K", "8-K/A", "4", "10-Q"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    row = F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("accessionNumber"), day.alias("filingDate"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(day, F.lit("T10:00:00.000Z"))).alias("acceptanceDateTime"), form.alias("form"), F.lit("d.htm").alias("primaryDocument"), F.when(F.col("o_orderkey") % 2 == 0, "1.01, 9.01").otherwise("").alias("items"))
    r = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(row)).alias("r"))
    flat = F.struct(*[F.col("r")[c].alias(c) for c in S.COLUMNS])
    files = F.array(F.struct(F.lit("a.json").alias("name"), F.lit("1995-01-01").alias("filingFrom"), F.lit("1996-06-30").alias("filingTo")), F.struct(F.lit("b.json").alias("name"), F.lit("1999-01-01").alias("filingFrom"), F.lit("2000-06-30").alias("filingTo")))
    return r.select(F.col("o_custkey").cast("string").alias("cik"), F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct(F.struct(flat.alias("recent"), files.alias("files")).alias("filings")))).otherwise(F.to_json(flat)).alias("payload"))


@query("S5", "SELECT o_orderkey::VARCHAR AS accession_number, lpad(o_custkey::VARCHAR, 10, '0') AS cik, strftime(o_orderdate, '%Y-%m-%d') AS filing_date, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE epoch_us(o_orderdate + INTERVAL 10 HOUR) END AS acceptance_us, ['8-K', '8-K/A', '4', '10-Q'][o_orderkey % 4 + 1] AS form, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 0 END::BIGINT AS n_items, o_orderkey % 4 = 1 AS is_amendment, epoch_us(CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 10 HOUR END) AS sort_us FROM orders WHERE o_orderkey % 4 <> 2 AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31'")
def s5(spark, sf_dir):
    out = S.submission_filings(submissions(spark, sf_dir), "payload", "cik", "1996-01-01", "1998-12-31", ["8-K", "8-K/A", "10-Q"])
    return out.select("accession_number", "cik", F.col("filing_date").cast("string").alias("filing_date"), F.unix_micros("acceptance_at").alias("acceptance_us"), "form", F.size("items").cast("long").alias("n_items"), "is_amendment", F.unix_micros("sort_at").alias("sort_us"))


@query("S6", "SELECT 'a.json' AS name, count(DISTINCT o_custkey) AS n FROM orders WHERE o_custkey % 2 = 0")
def s6(spark, sf_dir):
    return S.history_files(submissions(spark, sf_dir), "payload", "1996-01-01", "1998-12-31").groupBy("name").agg(F.count("*").alias("n"))


@query("S7", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS p FROM orders")
def s7(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_orderkey")
    return S.first_wins([o.where("o_orderkey % 2 = 0").withColumn("p", F.lit(0)), o.where("o_orderkey % 3 = 0").withColumn("p", F.lit(1)), o.withColumn("p", F.lit(2))], "o_orderkey")


DOC = "'<DOCUMENT>' || chr(10) || '<TYPE>8-K' || chr(10) || '<SEQUENCE>' || turn || chr(10) || '<FILENAME>f' || turn || '.htm' || chr(10) || '<TEXT>' || conv_id || '</TEXT>' || chr(10) || '</DOCUMENT>'"


@query("S8", f"SELECT conv_id, turn AS position, '8-K' AS type, turn::VARCHAR AS sequence, 'f' || turn || '.htm' AS filename, sha256({DOC}) AS content_hash FROM conversations")
def s8(spark, sf_dir):
    c = B.table(spark, sf_dir, "conversations")
    t, v = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    block = F.concat(F.lit("<DOCUMENT>\n<TYPE>8-K\n<SEQUENCE>"), t, F.lit("\n<FILENAME>f"), t, F.lit(".htm\n<TEXT>"), v, F.lit("</TEXT>\n</DOCUMENT>"))
    whole = c.groupBy("conv_id").agg(F.encode(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\nnoise\n"), "UTF-8").alias("raw"))
    return S.submission_documents(whole, "raw", "conv_id").select("conv_id", F.col("position").cast("long").alias("position"), "type", "sequence", "filename", "content_hash")


@query("S10", "SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, round(max(o_custkey) / 100.0, 8)::DOUBLE AS mkt, round(count(*) / 100.0, 8)::DOUBLE AS smb FROM orders GROUP BY 1")
def s10(spark, sf_dir):
    d = B.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("d")).agg(F.max("o_custkey").alias("a"), F.count("*").alias("b"))
    lines = d.select(F.concat_ws(",", "d", "a", F.concat(F.lit("  "), F.col("b").cast("string")), F.lit("0.5"), F.lit("0.01")).alias("value")).union(spark.createDataFrame([("This file was created by hand",), (",Mkt-RF,SMB,HML,RF",), ("199501,1,2,3,4",), ("",)], "value string"))
    return S.factor_rows(lines).select(F.col("session_date").cast("string").alias("day"), F.round("mkt", 8).alias("mkt"), F.round("smb", 8).alias("smb"))


@query("S12", "SELECT user_id::VARCHAR AS symbol, epoch_us(date_trunc('second', ts)) AS us, value AS open, event_id AS volume FROM events")
def s12(spark, sf_dir):
    e = B.table(spark, sf_dir, "events").withColumn("page", F.floor(F.col("event_id") / 500))
    bar = F.struct(F.date_format(B.utc("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("t"), F.col("value").alias("o"), F.col("value").alias("h"), F.col("value").alias("l"), F.col("value").alias("c"), F.col("event_id").alias("v"))
    pages = e.groupBy("page", F.col("user_id").cast("string").alias("s")).agg(F.collect_list(bar).alias("b")).groupBy("page").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("s", "b"))).alias("bars"))).alias("value"))
    return S.paged_bars(pages).select("symbol", F.unix_micros("ts").alias("us"), "open", "volume")


@query("S13", "SELECT o_orderkey::VARCHAR AS action_id, CASE WHEN o_orderkey % 2 = 0 THEN 'cash_dividend' ELSE 'merger' END AS action_type, o_custkey::VARCHAR AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 7 <> 0")
def s13(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    k, sym, day = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    entry = F.struct(k.cast("string").alias("id"), F.when(k % 3 == 0, sym).alias("symbol"), F.when(k % 3 != 0, sym).alias("acquiree_symbol"), F.when((k % 5 == 0) & (k % 7 != 0), day).alias("ex_date"), F.when((k % 5 != 0) & (k % 7 != 0), day).alias("payable_date"))
    groups = o.groupBy((k % 50).alias("page"), F.when(k % 2 == 0, "cash_dividends").otherwise("mergers").alias("g")).agg(F.collect_list(entry).alias("a"))
    pages = groups.groupBy("page").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("g", "a"))).alias("corporate_actions"))).alias("value"))
    return S.corporate_actions(pages).select("action_id", "action_type", "symbol", F.col("effective_date").cast("string").alias("day"))


@query("S17", "SELECT lpad(c_custkey::VARCHAR, 10, '0') AS cik, c_name AS name FROM customer WHERE c_custkey % 4 <> 0")
def s17(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    url = F.concat(F.lit("https://data.example/CIK"), F.lpad(F.col("c_custkey").cast("string"), 10, "0"), F.lit(".json"))
    rows = lambda i, name: c.select(url.alias("url"), F.to_json(F.struct(name.alias("name"))).alias("body"), F.lit(i).alias("request_id"))
    keyed = F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_name"))
    return S.company_names(rows(1, F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.lit("old"))).unionByName(rows(2, keyed)).unionByName(rows(3, F.lit("  "))))


@query("P5", "SELECT p_partkey FROM (SELECT p_partkey, ['.htm', '.HTML', '.pdf', '.txt'][p_partkey % 4 + 1] AS x, ['8-K', 'ex-99.1', 'GRAPHIC'][p_partkey % 3 + 1] AS k FROM part) WHERE x <> '.pdf' AND k <> 'GRAPHIC'")
def p5(spark, sf_dir):
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (F.col("p_partkey") % len(names) + 1).cast("int"))
    p = B.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("doc"), pick([".htm", ".HTML", ".pdf", ".txt"])).alias("filename"), F.lit(None).cast("string").alias("path"), pick(["8-K", "ex-99.1", "GRAPHIC"]).alias("document_type"))
    return S.eligible(p).select("p_partkey")


@query("P6", "SELECT p_partkey, p_partkey % 3 = 1 AS is_exhibit, p_partkey % 3 = 2 AS is_amendment FROM part")
def p6(spark, sf_dir):
    f = F.element_at(F.array(*map(F.lit, ("8-K", "ex-99.1", "10-Q/A"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return B.table(spark, sf_dir, "part").select("p_partkey", F.upper(f).startswith("EX-").alias("is_exhibit"), F.endswith(f, F.lit("/A")).alias("is_amendment"))


@query("P7", "SELECT o_orderkey, 'https://archive.example/' || o_custkey || '/' || lpad(o_orderkey::VARCHAR, 10, '0') || '95' || '000001' AS url FROM orders")
def p7(spark, sf_dir):
    accession = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-95-000001"))
    return B.table(spark, sf_dir, "orders").select("o_orderkey", S.archive_url(F.lpad(F.col("o_custkey").cast("string"), 10, "0"), accession).alias("url"))


@query("K2", "SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 20 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 20 = 0) GROUP BY 1")
def k2(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return K.insert_or_ignore(o.where("o_orderkey % 20 = 0"), o.where("o_orderkey % 20 != 0"), ["o_custkey"], "o_orderkey")


UPSERT = "SELECT o_custkey, arg_max(o_totalprice, (o_orderkey % 2, o_orderkey)) AS price, arg_max(o_orderkey, (o_orderkey % 2, o_orderkey)) AS o_orderkey, min(o_orderdate) AS first_seen FROM orders GROUP BY 1"


def _upsert(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_totalprice").alias("price"), "o_orderkey", F.col("o_orderdate").alias("first_seen"))
    return K.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey", keep_least=["first_seen"])


@query("K3", f"SELECT o_custkey, o_orderkey, price FROM ({UPSERT})")
def k3(spark, sf_dir):
    return _upsert(spark, sf_dir).select("o_custkey", "o_orderkey", "price")


@query("K4", f"SELECT o_custkey, strftime(first_seen, '%Y-%m-%d') AS first_seen FROM ({UPSERT})")
def k4(spark, sf_dir):
    return _upsert(spark, sf_dir).select("o_custkey", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


@query("K5", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 1")
def k5(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return K.checked_insert(c.where("c_custkey % 2 = 0"), c, "c_custkey", "c_name")


@query("A27", "SELECT user_id, sha256(string_agg(event_type, '' ORDER BY event_id)) AS hash FROM events GROUP BY 1")
def a27(spark, sf_dir):
    return folds.ordered_digest(B.table(spark, sf_dir, "events"), ["user_id"], [F.col("event_id")], F.col("event_type")).drop("n")


@query("A25", "SELECT l_orderkey, min(l_linenumber)::BIGINT AS first_line FROM lineitem GROUP BY 1")
def a25(spark, sf_dir):
    l = B.table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_orderkey").agg(F.min_by(F.col("l_linenumber"), F.struct(F.col("l_linenumber").cast("int"), F.col("l_linenumber").cast("string"))).cast("long").alias("first_line"))


# --- bodies, archives and stores -------------------------------------------------------------------------------------


@query("S4", "SELECT page_id, sha256(coalesce(html, '')) AS sha, (CASE page_id % 3 WHEN 0 THEN 'gzip' WHEN 1 THEN 'Deflate' ELSE 'none' END) AS encoding FROM pages WHERE html IS NOT NULL")
def s4(spark, sf_dir):
    """Pages sent with gzip, deflate or neither, and decoded."""
    kind = F.when(F.col("page_id") % 3 == 0, "gzip").when(F.col("page_id") % 3 == 1, "Deflate").otherwise("none")
    sent = B.table(spark, sf_dir, "pages").where("html is not null").select("page_id", kind.alias("encoding"), S.encoded_body()(F.encode("html", "UTF-8"), kind).alias("body"))
    return sent.select("page_id", F.sha2(S.decoded_body()("body", "encoding"), 256).alias("sha"), "encoding")


@query("S9", "SELECT p_partkey, p_type AS type, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS description, NULL::VARCHAR AS sequence FROM part")
def s9(spark, sf_dir):
    """Tags in any case, padded, blank (null) and missing."""
    name = F.when(F.col("p_partkey") % 3 == 0, "  ").otherwise(F.col("p_name"))
    block = F.concat(F.lit("<DOCUMENT>\n<type> "), "p_type", F.lit("  \r\n<DESCRIPTION>"), name, F.lit("<FILENAME>x.htm\n</DOCUMENT>"))
    tag = lambda t: S.sgml_tag(F.decode(F.encode(block, "UTF-8"), "ISO-8859-1"), t)
    return B.table(spark, sf_dir, "part").select("p_partkey", tag("TYPE").alias("type"), tag("DESCRIPTION").alias("description"), tag("SEQUENCE").alias("sequence"))


@query("K1", "SELECT path, any_value(n) AS n_bytes FROM (SELECT substr(sha256(html), 1, 2) || '/' || sha256(html) || '.html' AS path, strlen(html) AS n FROM pages WHERE html <> '') GROUP BY 1")
def k1(spark, sf_dir):
    """Pages into a content-addressed store, each body twice, and what the store has then."""
    root = f"{shared_dir(spark)}/sediment/store-{uuid.uuid4().hex}"
    pages = B.table(spark, sf_dir, "pages").where("html != ''").select(F.encode("html", "UTF-8").alias("body"), F.lit(".html").alias("suffix"))
    content_store.store_bodies(pages.unionAll(pages), root)
    return content_store.stored_bodies(spark, root).select("path", "n_bytes")


@query("S16", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 1000 AND o_orderstatus IN ('F', 'O') AND o_totalprice <= 150000")
def s16(spark, sf_dir):
    """Orders in SQLite files, a file a task; the scan reads three columns, and SQLite filters."""
    root = f"{shared_dir(spark)}/sediment/sqlite-{uuid.uuid4().hex}"
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    sqlite_tables.write_sqlite(o, root, "orders")
    found = sqlite_tables.read_sqlite(spark, root, "orders", "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double")
    return found.where("o_orderkey > 1000 and o_orderstatus in ('F', 'O') and o_totalprice <= 150000").drop("o_orderstatus")


# --- a walk over downloaded files: each customer is a company; orders up to 1995 stand in a history file ---------------


def downloads(spark, sf_dir):
    """(companies, requests, bodies). Customers divisible by 5 name no history file; complete submissions of orders divisible
    by 3 were not downloaded; each index was downloaded twice, an empty one first and at last in vain."""
    o = B.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("d"))
    cik = F.lpad(F.col("o_custkey").cast("string"), 10, "0")
    row = F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("accessionNumber"), F.col("d").cast("string").alias("filingDate"), F.lit("").alias("acceptanceDateTime"), F.when(F.col("o_orderkey") % 4 == 0, "8-K/A").otherwise("8-K").alias("form"), F.lit("d.htm").alias("primaryDocument"), F.lit("").alias("items"))
    late = F.col("d") >= F.lit("1996-01-01").cast("date")
    sorted_ = lambda when: F.sort_array(F.collect_list(F.when(when, row)))
    by = o.groupBy("o_custkey").agg(sorted_(late).alias("new"), sorted_(~late).alias("old"))
    flat = lambda c: F.struct(*[c[k].alias(k) for k in S.COLUMNS])
    name = F.concat(F.lit("CIK"), cik, F.lit("-old.json"))
    none = F.array().cast("array<struct<name:string,filingFrom:string,filingTo:string>>")
    files = lambda c: F.when(F.col("o_custkey") % 5 == 0, none).otherwise(F.array(F.struct(name.alias("name"), F.lit("1992-01-01").alias("filingFrom"), F.lit("1995-12-31").alias("filingTo")), F.struct(F.lit("missing.json").alias("name"), F.lit("1980-01-01").alias("filingFrom"), F.lit("1981-12-31").alias("filingTo"))))
    index = F.concat(F.lit("https://data.example/submissions/CIK"), cik, F.lit(".json"))
    main = by.select(F.col("o_custkey").alias("i"), index.alias("url"), F.to_json(F.struct(F.struct(flat(F.col("new")).alias("recent"), files(None).alias("files")).alias("filings"))).alias("t"))
    old = by.select(F.col("o_custkey").alias("i"), F.concat(F.lit("https://data.example/submissions/"), name).alias("url"), F.to_json(flat(F.col("old"))).alias("t"))
    folder = F.concat(F.lit("https://archive.example/"), F.col("o_custkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"), F.lit("/"), F.col("o_orderkey").cast("string"))
    text = F.concat(F.lit("<DOCUMENT>\n<TYPE>8-K\n<TEXT>"), F.col("o_orderkey").cast("string"), F.lit("</TEXT>\n</DOCUMENT>\n<DOCUMENT>\n<TYPE>EX-99.1\n</DOCUMENT>"))
    whole = o.where("o_orderkey % 3 != 0").select(F.col("o_orderkey").alias("i"), F.concat(folder, F.lit(".txt")).alias("url"), text.alias("t"))
    empty = by.select(F.col("o_custkey").alias("i"), index.alias("url"), F.lit("{}").alias("t"))
    made = lambda d, k: d.select((F.col("i") * 10 + k).alias("request_id"), "url", F.lit(200).alias("status"), F.sha2("t", 256).alias("content_hash"), F.encode("t", "UTF-8").alias("body"))
    all_ = stored(made(empty, 1).unionByName(made(main, 2)).unionByName(made(old, 3)).unionByName(made(whole, 4)), "downloads")
    failed = by.select((F.col("o_custkey") * 10 + 9).alias("request_id"), index.alias("url"), F.lit(503).alias("status"), F.lit(None).cast("string").alias("content_hash"))
    requests = all_.drop("body").unionByName(failed)
    return by.select(F.col("o_custkey").cast("string").alias("cik")), requests, all_.select("content_hash", "body").dropDuplicates(["content_hash"])


WALK_SQL = """WITH f AS (
  SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_orderdate >= TIMESTAMP '1996-01-01' THEN 'submissions' ELSE 'historical_submissions' END AS found_in FROM orders
  WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderkey % 4 <> 0 AND (o_orderdate >= TIMESTAMP '1996-01-01' OR o_custkey % 5 <> 0))"""


def walked(spark, sf_dir):
    companies, requests, bodies = downloads(spark, sf_dir)
    return S.collect_companies(requests, bodies, companies, "1995-06-01", "1997-12-31", ["8-K"])


@query("C14", WALK_SQL + """ SELECT k::VARCHAR AS accession_number, lpad(c::VARCHAR, 10, '0') AS cik, strftime(d, '%Y-%m-%d') AS filing_date, found_in, 3 AS pages, CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END AS found, CASE WHEN k % 3 = 0 THEN '' ELSE '8-K,EX-99.1' END AS documents FROM f""")
def c14(spark, sf_dir):
    found = walked(spark, sf_dir)
    key = ["cik", "accession_number"]
    pages = found["sources"].where("accession_number is not null").groupBy(*key).agg(F.count("*").alias("pages"), F.count("request_id").alias("found"))
    documents = found["documents"].groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("type")), ",").alias("documents"))  # a filing's documents
    out = found["filings"].join(pages, key).join(documents, key, "left")
    return out.select("accession_number", "cik", F.col("filing_date").cast("string").alias("filing_date"), "found_in", "pages", "found", F.coalesce("documents", F.lit("")).alias("documents"))


@query("F10", """SELECT event_id, sha256('{"a":[1,' || event_id || '],"é":"' || event_type || '"}') AS plain, sha256('{"a":[1,' || event_id || '],"' || chr(92) || 'u00e9":"' || event_type || '"}') AS ascii, sha256('{"é":"' || event_type || '","a":[1,' || event_id || ']}') AS as_given FROM events""")
def f10(spark, sf_dir):
    """The three canonical forms: keys sorted, the same in ASCII, and keys as given."""
    e = B.table(spark, sf_dir, "events")
    given = F.concat(F.lit('{ "é" : "'), "event_type", F.lit('", "a": [1, '), F.col("event_id").cast("string"), F.lit("]}"))
    sha = lambda f: F.sha2(f(given), 256)
    return e.select("event_id", sha(T.canonical_json()).alias("plain"), sha(T.canonical_json(ascii_only=True)).alias("ascii"), sha(T.canonical_json(sort=False)).alias("as_given"))
