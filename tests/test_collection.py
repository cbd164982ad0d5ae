"""The walk over downloaded files and the stream of requests."""

import json
from hashlib import sha256

import pytest

from sediment.sources import filings as S
from sediment.streaming import requests as R

BASE, ARCHIVE = "https://data.example/submissions", "https://archive.example"


def columns(*rows):
    return {"accessionNumber": [r[0] for r in rows], "filingDate": [r[1] for r in rows], "form": [r[2] for r in rows], "primaryDocument": [f"{r[0]}.htm" for r in rows]}


def tables(spark, files):
    """requests and bodies of (url, text or None for a failure), in order."""
    rows = [(i, u, 200 if t is not None else 500, None if t is None else sha256(t.encode()).hexdigest()) for i, (u, t) in enumerate(files)]
    bodies = {sha256(t.encode()).hexdigest(): bytearray(t.encode()) for _, t in files if t is not None}
    return spark.createDataFrame(rows, "request_id long, url string, status int, content_hash string"), spark.createDataFrame(list(bodies.items()), "content_hash string, body binary")


def walk(spark, files, ciks=("7",)):
    requests, bodies = tables(spark, files)
    found = S.collect_companies(requests, bodies, spark.createDataFrame([(c,) for c in ciks], "cik string"), "2024-01-01", "2024-12-31", ["8-K"])
    return {k: v.collect() for k, v in found.items()}


INDEX = {"filings": {"recent": columns(("a-1", "2024-05-01", "8-K"), ("a-2", "2024-06-01", "4"), ("a-3", "2023-06-01", "8-K")), "files": [{"name": "h1.json", "filingFrom": "2023-01-01", "filingTo": "2024-02-01"}, {"name": "h2.json", "filingFrom": "2020-01-01", "filingTo": "2023-12-31"}, {"name": "h3.json", "filingFrom": "2024-12-31", "filingTo": "2025-12-31"}]}}


def test_a_company_is_walked(spark):
    files = [
        (f"{BASE}/CIK0000000007.json", json.dumps({"filings": {"recent": columns(), "files": []}})),
        (f"{BASE}/CIK0000000007.json", json.dumps(INDEX)),
        (f"{BASE}/CIK0000000007.json", None),
        (f"{BASE}/h1.json", json.dumps(columns(("a-1", "2024-01-01", "8-K"), ("b-1", "2024-01-02", "8-K")))),
        (f"{BASE}/h2.json", "broken, and never read"),
        (f"{ARCHIVE}/7/a1/a-1.txt", "<DOCUMENT>\n<TYPE>8-K\n<FILENAME>x.htm\n</DOCUMENT>noise<document>\n<type>EX-1\n</document>"),
        (f"{ARCHIVE}/7/b1/b-1.htm", "primary"),
    ]
    out = walk(spark, files)
    assert sorted((r.accession_number, str(r.filing_date), r.found_in) for r in out["filings"]) == [("a-1", "2024-05-01", "submissions"), ("b-1", "2024-01-02", "historical_submissions")]
    told = {(r.accession_number, r.role, r.url.split("/")[-1]): r.request_id for r in out["sources"]}
    assert told == {
        (None, "submissions", "CIK0000000007.json"): 1, (None, "historical_submissions", "h1.json"): 3, (None, "historical_submissions", "h3.json"): None,
        ("a-1", "primary_document", "a-1.htm"): None, ("a-1", "complete_submission", "a-1.txt"): 5, ("a-1", "filing_index", "a-1-index.html"): None,
        ("b-1", "primary_document", "b-1.htm"): 6, ("b-1", "complete_submission", "b-1.txt"): None, ("b-1", "filing_index", "b-1-index.html"): None,
    }
    assert sorted((r.accession_number, r.position, r.type, r.filename) for r in out["documents"]) == [("a-1", 0, "8-K", "x.htm"), ("a-1", 1, "EX-1", None)]


def test_a_payload_is_parsed_once(spark):
    """Its columns are mentioned some thirty times, and each mention parsed the JSON again."""
    payloads = spark.createDataFrame([("7", json.dumps(INDEX)), ("8", None)], "cik string, payload string")
    told = S.submission_filings(payloads, "payload", "cik", "2024-01-01", "2024-12-31", ["8-K"])
    assert told._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [(r.cik, r.accession_number, str(r.filing_date)) for r in told.collect()] == [("0000000007", "a-1", "2024-05-01")]


def test_companies_without_files(spark):
    out = walk(spark, [(f"{BASE}/CIK0000000007.json", None)], ("7", " 7 ", "8"))
    assert out["filings"] == [] and out["documents"] == [] and sorted((r.cik, r.request_id) for r in out["sources"]) == [("0000000007", None), ("0000000008", None)]
    with pytest.raises(Exception, match="no CIK"):
        walk(spark, [], ("x",))


# --- the stream -------------------------------------------------------------------------------------------------------

SCHEMA = "request_id long, url string, status int, content_hash string"


def test_changes_are_told_once(spark, tmp_path):
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put = lambda *rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    told = lambda: sorted(tuple(r) for r in spark.read.schema(R.TOLD).parquet(out).select("request_id", "url", "content_changed").collect())

    def run():
        R.follow(spark, src, SCHEMA, out, mark).awaitTermination()

    put((1, "u", 200, "a"), (2, "u", 200, "a"), (3, "u", 500, "x"), (4, "u", 200, None), (5, "v", 204, "k"), (6, None, 200, "z"))
    run()
    first = [(1, "u", None), (2, "u", False), (5, "v", None)]
    assert told() == first
    run()  # the same folder again
    assert told() == first
    put((8, "u", 200, "b"), (7, "u", 200, "a"), (9, "v", 200, "k"))
    run()
    assert told() == [*first, (7, "u", False), (8, "u", True), (9, "v", False)]
    put((8, "u", 200, "b"), (2, "u", 200, "a"))  # told before
    run()
    put((10, "u", 200, "b"))
    run()
    assert told() == [*first, (7, "u", False), (8, "u", True), (9, "v", False), (10, "u", False)]


def test_the_stream_tells_what_the_batch_tells(spark, tmp_path):
    import random

    rng = random.Random(4)
    rows = [(i, f"u{rng.randint(0, 5)}", rng.choice([200, 200, 404]), rng.choice(["a", "b", None])) for i in range(200)]
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for i in range(0, 200, 50):
        spark.createDataFrame(rows[i : i + 50], SCHEMA).coalesce(2).write.mode("append").parquet(src)
        R.follow(spark, src, SCHEMA, out, mark).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(R.TOLD).parquet(out).select("request_id", "content_changed").collect())
    assert got == sorted(tuple(r) for r in S.content_changes(spark.createDataFrame(rows, SCHEMA)).select("request_id", "content_changed").collect())
