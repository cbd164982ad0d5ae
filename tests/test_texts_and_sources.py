"""Text functions, parsers and sinks on golden values."""

import gzip
import io
import json
import zipfile
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.functions import filing
from sediment.functions import text as T
from sediment.operators import annotation, baselines, graph, probe
from sediment.sources import filings as S
from sediment.sources import sinks as K


def test_normalised_filings(spark):
    cases = {
        "ordinary": (b"<html><head><title>no</title></head><body><h1>Item 1.01 Lease Signed</h1><p>The company and the landlord agreed to terms.</p></body></html>", "8-K"),
        "malformed": (b"<h2>Item 2.02 Numbers<p>Sales rose", "8-K"),
        "table": (b"<h2>Item 9</h2><table><tr><th>Year</th><th>Units</th></tr><tr><td> 2023 </td><td>7</td></tr><tr><td></td></tr></table>", "8-K"),
        "exhibit": (b"<p>Text of a letter</p>", "ex-99.1"),
        "long": (b"<h1>Item 1.01 X</h1>" + b"<p>Paragraph of some length.</p>" * 2000, "10-Q"),
        "hidden": (b"<nav><p>menu</p></nav><h1>Item 5</h1><p style='display: none'>no</p><ix:hidden><p>no</p></ix:hidden><div style='visibility:hidden'><div>no</div>no</div><p>Sales were <ix:nonfraction>12</ix:nonfraction> million.</p><footer>no</footer>", "8-K"),
        "empty": (b"", "8-K"),
        "styled": (b"<p>Item 3.01 short</p><p><b>Bold line</b></p><p>one</p><div style='font-weight: 700'>Other</div><p>safe harbor</p>", "8-K"),
        "bold": (b"<p><strong>Risks</strong></p><p>one<br>two &amp;amp; three</p><p style='font-weight:bold'>Signatures</p><p>end</p>", "8-K"),
        "cp1252": (b"<h1>T</h1><p>caf\xe9 \x93quoted\x94 a \x96 b</p>", "8-K"),
        "loose": (b"loose <p>in</p> loose <div>outer <p>inner</p> lost</div>", "8-K"),
        "item_table": (b"<table><tr><td>Item 8.01</td><td>Other</td></tr></table><p>after</p>", "8-K"),
        "many_words": (b"<p>Item 1 " + b"word " * 60 + b"</p><p>x</p>", "8-K"),
    }
    df = spark.createDataFrame([(k, bytearray(v), d) for k, (v, d) in cases.items()], "k string, raw binary, document_type string")
    out = {r.k: r for r in filing.normalize_filings(df).collect()}
    texts = lambda k: [(s.heading, s.text) for s in out[k].sections]
    assert texts("ordinary") == [("Item 1.01 Lease Signed", "The company and the landlord agreed to terms.")]
    assert out["ordinary"].language == "en" and out["ordinary"].parsing_quality == 1 and out["ordinary"].sections[0].section_id == "section_001"
    raw, s = cases["ordinary"][0], out["ordinary"].sections[0]
    assert raw[s.source_start : s.source_end].startswith(b"<h1>Item") and raw[s.source_start : s.source_end].endswith(b"terms.</p>")
    assert out["malformed"].warnings == ["malformed_html"] and texts("malformed") == [("Item 2.02 Numbers", "Sales rose")]
    assert texts("table") == [("Item 9", "Year\tUnits\n2023\t7")] and out["table"].sections[0].is_table
    assert out["exhibit"].is_exhibit and out["exhibit"].warnings == ["missing_headings"]
    assert out["long"].sections[0].text.count("Paragraph") == 2000
    assert texts("hidden") == [("Item 5", "Sales were 12 million.")] and not out["hidden"].warnings
    assert out["empty"].warnings == ["missing_headings", "no_text"] and out["empty"].parsing_quality == 0
    assert texts("styled") == [("Item 3.01 short", "Bold line\n\none"), ("Item 3.01 short", "Other\n\nsafe harbor")] and out["styled"].sections[1].is_boilerplate
    assert texts("bold") == [("Risks", "one two & three"), ("Signatures", "end")] and [x.is_boilerplate for x in out["bold"].sections] == [False, True]
    assert texts("cp1252") == [("T", 'caf\xe9 "quoted" a \u2013 b')]
    assert texts("loose") == [(None, "in\n\nouter\n\ninner")] and out["loose"].warnings == ["missing_headings"]
    assert texts("item_table") == [("Item 8.01 Other", "Item 8.01\tOther"), ("Item 8.01 Other", "after")]
    assert texts("many_words")[0][0] is None


def test_clean_and_align():
    assert T.clean("“A b”\n — ﬁn &amp; co") == '"A b" — fin & co'
    source = "Heading\n\nThe board—acting  today—approved a “buyback”."
    whole = source[9:-1]
    at = lambda q: (lambda r: r and source[r[0] : r[1]])(T.align(source, q))
    assert at('The board-acting today-approved a "buyback"') == whole == at('- The board-acting today-approved a "buyback"') == at('The board-acting today-approved a "buyback";')
    assert at('- The board-acting today-approved a "buyback";') is None and at("not there") is None and at("") is None and at(" ") is None


def test_align_folds_both_sides_alike():
    same = lambda t: T.align(t, t) == (0, len(t))
    assert same("cafe\u0301 noir") and same("A &amp; B") and same("ﬁne − print")
    assert T.align("a − b", "a - b") == (0, 5) and T.align("ﬁne", "fine") == (0, 3) and T.align("  a\u3000\u2003b ", "a b") == (2, 6)
    assert T.align("revenue rose", "revenue rose...") is None and T.align("revenue rose", "revenue rose.") == (0, 12)
    assert T.align("it fell", "\ufffd it fell") == (0, 7) == T.align("it fell", "• * it fell") and T.align("it fell", "· it fell") is None
    assert T.align("", "a") is None and T.align("a", ".") is None and T.align("x &amp; y", "x & y") is None


def test_paragraphs_and_white_space(spark):
    cases = {"  lead\n\nx": "lead", "\t": "", "": "", "\n\xa0\n\u2003a \x1c\n\x1f\nb": "a", "a\nb\n \n c": "a\nb", None: None}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert df.where(~T.first_paragraph(F.col("t")).eqNullSafe(F.col("want"))).collect() == []
    assert spark.createDataFrame([("\u3000\x85x\u2029",)], "t string").select(T.strip(F.col("t"))).first()[0] == "x" and len(T.WHITE) == 29


def test_blank_sections_do_not_count(spark):
    from sediment.operators import review

    rows = [("\n\t\n", False), ("the order text", True)]
    df = spark.createDataFrame([([(None, t, False, b) for t, b in rows],)], "s array<struct<heading:string,text:string,is_table:boolean,is_boilerplate:boolean>>")
    top = df.withColumn("top", review.top_sections(F.col("s")))
    assert [r["text"] for r in top.first()["top"]] == ["the order text"]
    padded = spark.createDataFrame([([("\u3000Head\t", "\n body \x1f\n\n\nmore", False, False), ("\t", "second", False, False)],)], df.schema).withColumn("top", review.top_sections(F.col("s"), 2, []))
    r = padded.select(review.review_text(F.col("top")).alias("t"), review.review_with_spans(F.col("top")).alias("s")).first()
    assert r.t == r.s["text"] == "Head\n\nbody \x1f\n\n\nmore\n\n---\n\nsecond" and [x["text"] for x in r.s["spans"]] == ["body", "second"]


def test_boilerplate_stands_in_only_alone(spark):
    from sediment.operators import review

    kind = "s array<struct<heading:string,text:string,is_table:boolean,is_boilerplate:boolean>>"
    rows = [("a", "order order debt", False, True), (None, "é plain", None, None), ("b", "debt", False, False), ("c", "Debt", False, False), ("d", "debt order", True, False), ("e", None, False, False)]
    cases = [rows, [r for r in rows if r[3]], [rows[4]], None, [rows[1], rows[0]]]
    top = spark.createDataFrame([(c,) for c in cases], kind).select(review.top_sections(F.col("s"), 3).alias("t")).collect()
    told = [None if r.t is None else [(-x["rank"], x["heading"]) for x in r.t] for r in top]
    assert told == [[(1, "b"), (1, "c"), (0, None)], [(3, "a")], [], None, [(0, None)]]


def test_sections_are_scored_once(spark):
    """Inside lambdas nothing is shared: a section's text was lower-cased twice for each term, and paragraphs were split again for each use."""
    from sediment.operators import review

    df = spark.createDataFrame([], "s array<struct<heading:string,text:string,is_table:boolean,is_boilerplate:boolean>>")
    shown = df.select(review.review_with_spans(review.top_sections(F.col("s"))).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("lower(") == 1 and shown.count("split(") == 1


def test_attribute_values(spark):
    from datetime import date

    from sediment.operators import review

    dates = ["2024-01-15", "20240115", "2024-W03", "2024W031", "2024-W03-1", "2024W03-1", "2024-W031", "2024-W00-1", "2024-W54-1", "2020-W53-7", "2021-W53-1", "2024-02-30", "20240230", "2024-1-5", "0000-01-01", "0001-01-01", "", " 2024-01-15", "2024-01-15T00:00", "2024-W03-8", "9999-12-31"]

    def valid(t):
        try:
            return date.fromisoformat(t) is not None
        except ValueError:
            return False

    df = spark.createDataFrame([("date", json.dumps(t), valid(t)) for t in dates] + [("number", v, ok) for v, ok in (("1e308", True), ("1e309", False), ("-1e999", False), ("0", True), ("NaN", False), ("9" * 400, False))], "k string, v string, want boolean")
    assert df.where(review.valid_attribute(F.col("k"), F.col("v"), F.array(F.lit(""))) != F.col("want")).collect() == []


def test_models_without_priority_cannot_vote(spark):
    from sediment.operators import annotation

    votes = spark.createDataFrame([(1, "A", "x"), (1, "Z", "y")], "i int, model string, value string")
    assert annotation.vote(votes.where("model = 'A'"), ["i"]).first()["value"] == "x"
    with pytest.raises(Exception, match="no such model: Z"):
        annotation.vote(votes, ["i"]).collect()


def test_unequal_filing_columns_are_refused(spark):
    flat = {"accessionNumber": ["1", "2"], "filingDate": ["2024-01-02", "2024-01-03"], "form": ["8-K", "8-K"], "primaryDocument": ["a", "b"], "items": ["1.01"]}
    read = lambda p, cik="42", a="2024-01-01", b="2024-12-31": S.submission_filings(spark.createDataFrame([(cik, json.dumps(p))], "cik string, payload string"), "payload", "cik", a, b, ["8-K"]).collect()
    out = sorted(read(flat), key=lambda r: r.accession_number)
    assert [(r.cik, r["items"], r.acceptance_at) for r in out] == [("0000000042", ["1.01"], None), ("0000000042", [], None)]
    for bad in ({**flat, "form": ["8-K"]}, {k: v for k, v in flat.items() if k != "form"}, {**flat, "filingDate": ["x", "2024-01-02"]}):
        with pytest.raises(Exception, match="unequally long|no filing date"):
            read(bad)
    with pytest.raises(Exception, match="no CIK"):
        read(flat, cik="4x2")
    with pytest.raises(ValueError, match="precede"):
        read(flat, a="2025-01-01")


def test_token_spans(spark):
    """Spans against a walk over all tokens, with tokens of other texts and without text between."""
    text = "head body of it "

    def plain(offsets, sequence, start, stop, quote):
        if not 0 <= start < stop <= len(text) or quote is not None and text[start:stop] != quote:
            return None
        own = [i for i, ((a, b), s) in enumerate(zip(offsets, sequence)) if s == 0 and a < b and a < stop and b > start]
        if not own:
            return None
        left, right = offsets[own[0]][0], offsets[own[-1]][1]
        return None if left > start or right < stop or text[left:start].strip() or text[stop:right].strip() else (own[0], own[-1] + 1)

    tokens = [([(0, 0), (0, 4), (4, 10), (10, 15), (0, 0), (0, 4)], [None, 0, 0, 0, None, 1]), ([(0, 4), (5, 5), (5, 9), (10, 12), (13, 15)], [0] * 5), ([(0, 2), (2, 4), (4, 5), (5, 9)], [0] * 4), ([], [])]
    rows = []
    for offsets, sequence in tokens:
        for a in range(-1, 17):
            for b in range(-1, 18):
                for quote in (None, "body of"):
                    rows.append((text, [(x, y, s) for (x, y), s in zip(offsets, sequence)], a, b, quote, plain(offsets, sequence, a, b, quote)))
    df = spark.createDataFrame(rows, "t string, o array<struct<start:int,stop:int,sequence:int>>, a int, b int, q string, want struct<first:int,stop:int>")
    got = df.withColumn("got", T.token_span(F.col("t"), T.own_tokens(F.col("o")), F.col("a"), F.col("b"), F.col("q")))
    assert got.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == [] and got.where("got is not null").count() > 20


def test_offsets_of_a_real_tokenizer(spark):
    import os

    path = "/opt/tokenizers/word_bpe_49k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer files")
    text = "Le café 𝒜 est né — a tokenizer's text.\n\nSecond"
    df = spark.createDataFrame([(text, text.index("est né"), text.index("est né") + 6), (None, 0, 1)], "t string, a int, b int").withColumn("o", T.tokenizer_offsets(path)("t"))
    r = df.withColumn("s", T.token_span(F.col("t"), F.col("o"), F.col("a"), F.col("b"))).where("t is not null").first()
    assert r.s is not None and text[r.o[r.s["first"]]["start"] : r.o[r.s["stop"] - 1]["stop"]].strip() == "est né"



def test_canonical():
    assert T.canonical({"b": 1, "a": "é"}) == '{"a":"é","b":1}' and T.canonical({"a": "é"}, ascii_only=True) == '{"a":"\\u00e9"}'


def test_bodies_and_archives(spark):
    raw = b"body"
    df = spark.createDataFrame([(1, bytearray(gzip.compress(raw)), "gzip"), (2, bytearray(zlib.compress(raw)), "deflate"), (3, bytearray(raw), None)], "i int, b binary, e string")
    assert {bytes(r.x) for r in df.select(S.decoded_body()("b", "e").alias("x")).collect()} == {raw}
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("f.csv", "head\n20240102,1.0,2.0,3.0,0.02\nshort,1\n20240103, -1.5,0,0,0.02\n")
    lines = spark.createDataFrame([(bytearray(buf.getvalue()),)], "a binary").select(F.explode(S.zipped_csv_lines()("a")).alias("value"))
    out = S.factor_rows(lines).orderBy("session_date").collect()
    assert [(str(r.session_date), r.mkt) for r in out] == [("2024-01-02", 0.01), ("2024-01-03", -0.015)]


def test_submissions(spark):
    cols = {"accessionNumber": ["a1", "a2", "a3"], "filingDate": ["2024-01-02", "2024-01-03", "2024-01-04"], "acceptanceDateTime": ["2024-01-02T21:00:00.000Z", "", ""], "form": ["8-K", "8-K/A", "4"], "primaryDocument": ["x.htm"] * 3, "items": ["1.01,9.01", "", ""]}
    files = [{"name": "old.json", "filingFrom": "2010-01-01", "filingTo": "2014-12-31"}, {"name": "mid.json", "filingFrom": "2015-01-01", "filingTo": "2019-12-31"}]
    df = spark.createDataFrame([("1", json.dumps({"filings": {"recent": cols, "files": files}})), ("2", json.dumps(cols))], "cik string, p string")
    out = S.submission_filings(df, "p", "cik", "2024-01-01", "2024-12-31", ["8-K", "8-K/A"]).collect()
    assert len(out) == 4 and sum(r.is_amendment for r in out) == 2
    assert [r.name for r in S.history_files(df, "p", "2015-01-01", "2020-01-01").collect()] == ["mid.json"]


def test_sgml(spark):
    blocks = [b"<DOCUMENT>\n<TYPE>10-Q\n<SEQUENCE>1\n<FILENAME>a.htm\n<TEXT>caf\xe9\x00</TEXT>\n</DOCUMENT>", b"<document >\n<TYPE>EX-99.1\n<SEQUENCE>2\n<DESCRIPTION> \n</DOCUMENT>"]
    df = spark.createDataFrame([(1, bytearray(b"head\n" + blocks[0] + b"\nmid\n" + blocks[1]))], "k int, raw binary")
    out = S.submission_documents(df, "raw", "k").orderBy("position").collect()
    assert [(r.type, r.sequence, r.filename, r.description) for r in out] == [("10-Q", "1", "a.htm", None), ("EX-99.1", "2", None, None)]
    assert [r.content_hash for r in out] == [sha256(b).hexdigest() for b in blocks]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("k1", 1, 5, "h1")], "k string, o int, seen int, h string")
    new = spark.createDataFrame([("k1", 2, 3, "h2"), ("k2", 1, 9, "h3"), ("k2", 2, 8, "h4")], "k string, o int, seen int, h string")
    assert {(r.k, r.o) for r in K.insert_or_ignore(old, new, ["k"], "o").collect()} == {("k2", 1)}
    out = {r.k: r for r in K.upsert(old, new, ["k"], "o", keep_least=["seen"], keep_first=["h"]).collect()}
    assert (out["k1"].o, out["k1"].seen, out["k1"].h) == (2, 3, "h1") and (out["k2"].o, out["k2"].seen) == (2, 8)
    assert K.checked_insert(old, old, "k", "h").count() == 0
    with pytest.raises(ValueError):
        K.checked_insert(old, new.limit(1), "k", "h")


def test_stream_of_versions(spark, tmp_path):
    from sediment.streaming.versions import ingest

    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    rows = lambda *ks: spark.createDataFrame([(k, v) for k, v in ks], "k string, v int")
    rows(("a", 1), ("a", 2), ("b", 1)).coalesce(1).write.parquet(src)
    ingest(spark, src, "k string, v int", out, ["k"], "v", mark).awaitTermination(120)
    rows(("a", 9), ("c", 1)).coalesce(1).write.mode("append").parquet(src)
    ingest(spark, src, "k string, v int", out, ["k"], "v", mark).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1), ("b", 1), ("c", 1)]


def test_votes(spark):
    rows = [("i", m, v) for m, v in (("A", "neutral"), ("B", "positive"), ("D", "positive"), ("E", "neutral"))] + [("j", m, "x") for m in "AB"] + [("k", "A", "x"), ("k", "B", "y"), ("k", "C", "y")]
    out = {r.item: r for r in annotation.vote(spark.createDataFrame(rows, "item string, model string, value string"), ["item"]).collect()}
    assert (out["i"].value, out["i"].supporters, out["i"].rule) == ("neutral", "A,E", "model_priority_tiebreak")
    assert out["j"].rule == "unanimous" and (out["k"].value, out["k"].rule) == ("y", "strict_majority")


def test_agreement(spark):
    rows = []
    for i in range(100):
        rows += [(f"e{i:03d}", "a", "earnings.revenue_beat"), (f"e{i:03d}", "b", "earnings.revenue_beat" if i < 90 else "earnings.eps_beat" if i < 95 else "guidance.raised")]
    r = annotation.agreement(spark.createDataFrame(rows, "event_id string, annotator_id string, event_type string")).first()
    assert (r.events, r.leaf_agreement, r.family_agreement, r.disagreements) == (100, 0.9, 0.95, 10)


def test_components_and_split(spark):
    rows = [("evt-1", "a", "g1"), ("evt-2", "a", "g2"), ("evt-3", "b", "g2"), ("evt-4", "c", None), ("evt-5", "d", None)]
    df = spark.createDataFrame(rows, "event_id string, entity string, grp string")
    parts = {r.event_id: r.component for r in graph.components(df, ["entity", "grp"]).collect()}
    assert parts == {"evt-1": "evt-1", "evt-2": "evt-1", "evt-3": "evt-1", "evt-4": "evt-4", "evt-5": "evt-5"}
    out = {r.event_id: r.part for r in graph.split(df, ["entity", "grp"], "seed", 0.2).collect()}
    assert len({out[f"evt-{i}"] for i in (1, 2, 3)}) == 1 and set(out.values()) == {"eval", "train"}
    hashes = sorted((sha256(f"seed:{ids}".encode()).hexdigest(), ids) for ids in ("evt-1|evt-2|evt-3", "evt-4", "evt-5"))
    assert {e for e, p in out.items() if p == "eval"} == set(hashes[0][1].split("|"))


def test_long_chain_of_components(spark):
    df = spark.range(200).selectExpr("id as event_id", "id div 2 as a", "(id + 1) div 2 as b")
    assert {r.component for r in graph.components(df, ["a", "b"]).collect()} == {0}


def test_calibration_and_sets(spark):
    r = baselines.calibration(spark.createDataFrame([(0.1, False), (0.9, True)], "p double, y boolean"), "p", "y").first()
    assert r.brier == pytest.approx(0.01) and r.ece == pytest.approx(0.1)
    m = baselines.set_metrics(spark.createDataFrame([([], []), (["a"], ["b"]), (["a", "b"], ["b", "a"])], "t array<string>, g array<string>"), "t", "g").first()
    assert m.exact == pytest.approx(2 / 3) and m.precision == pytest.approx(3 / 4)


def test_naive_bayes(spark):
    train = spark.createDataFrame([("n1", "weather was mild", ""), ("n2", "weather again", ""), ("n3", "routine notice", ""), ("b1", "board approved share buyback", "buyback"), ("b2", "share buyback program", "buyback")], "id string, text string, label string")
    test = spark.createDataFrame([("q1", "new share buyback announced"), ("q2", "mild weather"), ("q3", "unseen tokens only")], "id string, text string")
    out = {}
    for r in baselines.predict_bayes(test, baselines.fit_bayes(train, "label", "text"), "id", "text").collect():
        out.setdefault(r.id, {})[r.label] = r.prob
    assert out["q1"]["buyback"] == pytest.approx(6 / 7) and out["q2"][""] > 0.8 and out["q3"][""] == pytest.approx(0.6)
    assert all(sum(v.values()) == pytest.approx(1) for v in out.values())


def test_probe(spark):
    rows = [("yes" if s > 0 else "no", [float(s * k), 0.0]) for s in (1, -1) for k in (1, 2, 3)]
    df = spark.createDataFrame([(i, label, v) for i, (label, v) in enumerate(rows)], "id int, label string, v array<double>")
    heads = probe.fit_heads(df, "label", "v")
    out = probe.predict_heads(df, heads, "id", "v").where("label = 'yes'").collect()
    assert all((r.prob > 0.5) == (rows[r.id][0] == "yes") for r in out)


def test_review_with_spans(spark):
    """The review text and its spans against a plain version."""
    from sediment.operators import review

    def plain(sections, budget):
        text, spans = "", []
        for s in sections:
            if len(text) >= budget:
                break
            heading, body = (s[0] or "").strip(), s[1].strip()
            text += review.SEPARATOR if text else ""
            block = (f"{heading}\n\n{body}" if heading else body)[: max(0, budget - len(text))].rstrip()
            at = len(text) + (len(heading) + 2 if heading else 0)
            said = next(p.strip() for p in body.split("\n\n") if p.strip())[:600].rstrip()
            if at + len(said) <= len(text) + len(block):
                spans.append((at, at + len(said), said))
            text += block
        return text, spans[:4]

    found = [(f"H{i}" if i % 2 else "", f"order of section {i}. " * (i * 7 + 1) + "\n\nmore words " * i) for i in range(6)]
    for budget in (50, 400, 12_000):
        df = spark.createDataFrame([([(0, i, h, t) for i, (h, t) in enumerate(found)],)], "s array<struct<rank int, place int, heading string, text string>>")
        got = df.select(review.review_with_spans(F.col("s"), budget).alias("r")).first().r
        assert (got.text, [tuple(x) for x in got.spans]) == plain(found, budget)


def test_releases(spark, tmp_path):
    from sediment.operators import releases

    tasks = spark.createDataFrame([(i, f"c{i // 2}", None, "gold", f"text {i}", "8-K", None, "2024-01-01", "2024-01-02") for i in range(10)], "event_id long, entity_id string, related_event_group string, annotation_round string, text string, filing_type string, prior string, source_published_at string, tradable_at string")
    schema = "annotation_id long, event_id long, annotator_id string, status string, labels array<string>, created_at int, supersedes_annotation_id long"
    good = [(i, i, "a", "submitted", ["x.a"], 1, None) for i in range(10)] + [(100, 0, "b", "submitted", ["x.b"], 1, None), (101, 0, "j", "adjudicated", ["x.b"], 2, None)]
    out = {r.event_id: r for r in releases.release(tasks, spark.createDataFrame(good, schema), "s", 0.3).collect()}
    assert len(out) == 10 and out[0].annotation_id == 101 and out[0].double and not out[0].exact and out[0].family
    assert all(out[i].part == out[i + 1].part for i in range(0, 10, 2))
    for bad in ([(100, 0, "b", "submitted", ["x.b"], 1, None)], [(100, 0, "a", "submitted", ["x.a"], 1, None)], [(100, 0, "a", "submitted", [], 2, 77)], [(100, 55, "a", "submitted", [], 2, None)]):
        with pytest.raises(ValueError):
            releases.release(tasks, spark.createDataFrame(good[:10] + bad, schema), "s", 0.3)
    lines = releases.model_rows(releases.release(tasks, spark.createDataFrame(good, schema), "s", 0.3), tasks)
    told = {r.part: (r["items"], r.sha256) for r in releases.write_lines(lines, str(tmp_path / "all.jsonl")).collect()}
    files = {int(p.name.split("-")[1]): p.read_bytes() for p in (tmp_path / "all.jsonl").glob("part-*")}
    data = b"".join(files[i] for i in sorted(files))
    assert told == {None: (10, sha256(data).hexdigest())} | {i: (len(f.splitlines()), sha256(f).hexdigest()) for i, f in files.items()} and len(files) > 1
    rows = [json.loads(x) for x in data.decode().splitlines()]
    assert [r["event_id"] for r in rows] == list(range(10)) and rows[0]["target"] == {"labels": ["x.b"], "no_material_event": False} and "entity_id" not in data.decode()
    assert [json.dumps(r, sort_keys=True, separators=(",", ":")) for r in rows] == data.decode().splitlines()
    with pytest.raises(ValueError, match="b"):
        releases.contract(a=True, b=False)


def test_token_offsets_stay_with_their_row(spark):
    from pyspark.sql import functions as F

    from sediment.functions import text as T

    rows = [(1, "ab, \u00e9x\U0001f600 9\r\n"), (2, " \t\n"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "i int, text string").select("i", T.token_offsets(F.col("text")).alias("o"))
    got = {r.i: r.o and [tuple(x) for x in r.o] for r in df.collect()}
    assert got == {1: [(0, 2), (2, 3), (4, 5), (5, 6), (6, 7), (8, 9), (9, 10)], 2: None, 3: None, 4: None}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_tokens_of_a_column_are_those_of_each_text(monkeypatch):
    """Found in one pass over all bytes, in stretches of any size: the same tokens as by a regular expression, text by text."""
    import random
    import re

    import pyarrow as pa

    rng = random.Random(11)
    texts = ["", "ab", "cd", None, "\u00e9", "9", " ", "\U0001f600", "a\r\n\t b"]
    texts += ["".join(rng.choice("aZ9 \t\n.-\r\x0b\xa0\u00e9\u4e2d\U0001f600") for _ in range(rng.randrange(40))) for _ in range(300)]
    want = [[m.span() for m in re.finditer(r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n]", t or "")] or None for t in texts]
    for stretch in (1, 16, 1 << 20):
        monkeypatch.setattr(T, "STRETCH", stretch)
        for column, own in ((pa.array(texts), want), (pa.array(texts).slice(3), want[3:])):
            assert [o and [(x["start"], x["stop"]) for x in o] for o in T.found_tokens(column).to_pylist()] == own
    assert T.found_tokens(pa.array([], pa.string())).to_pylist() == []


def test_token_spans_read_their_tokens_once(spark):
    """The list of tokens is made once a span, not at each step of each search."""
    df = spark.sql("SELECT repeat('ab, ', 3) AS t, array(struct(0 AS start, 2 AS stop), struct(2 AS start, 3 AS stop)) AS o")
    span = df.select(T.token_span(F.col("t"), F.col("o"), F.lit(0), F.lit(3)).alias("s"))
    assert tuple(span.first().s) == (0, 2)
    assert span._jdf.queryExecution().analyzed().toString().count("filter(") == 1


def test_filings_are_normalised_in_slices(spark):
    """A batch of any number of rows gives the same rows in order, and no more than a slice's sections are held at once."""
    from sediment.functions import filing

    page = lambda i: f"<html><body><h1>Item {i}</h1><p>Text {i} of the company.</p></body></html>".encode()
    n = 2 * filing.SLICE + 3
    df = spark.createDataFrame([(i, page(i), "8-K") for i in range(n)], "i int, raw binary, document_type string").coalesce(1)
    got = {r.i: r.sections[-1].text for r in filing.normalize_filings(df).collect()}
    assert got == {i: filing.normalized(page(i), "8-K")["sections"][-1]["text"] for i in range(n)}
