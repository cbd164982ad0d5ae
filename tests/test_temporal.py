"""Calendar, as-of and security-master operators on golden values."""

from datetime import date, datetime

from sediment.operators import asof, calendar, master


def ts(s):
    return datetime.fromisoformat(s)


def test_tradability(spark):
    cases = [
        ("2024-01-02T15:00", None, "2024-01-03T14:30"),
        ("2024-01-02T22:00", None, "2024-01-03T14:45"),
        ("2024-01-06T17:00", None, "2024-01-08T14:45"),
        ("2024-07-03T18:00", None, "2024-07-05T13:45"),
        ("2024-01-02T15:00", "2024-01-04T16:00", "2024-01-05T14:30"),
    ]
    df = spark.createDataFrame([(i, ts(p), ts(r) if r else None) for i, (p, r, _) in enumerate(cases)], "i int, published timestamp, resumed timestamp")
    out = {r.i: r.tradable_at for r in calendar.tradable_at(df, calendar.calendar(spark, 2024, 2024), "published", "resumed").collect()}
    for i, (_, _, want) in enumerate(cases):
        assert out[i] == ts(want), i


def test_holidays():
    days = {d for d, _, _ in calendar.sessions(2001, 2025)}
    closed = [date(2001, 9, 11), date(2012, 10, 29), date(2024, 3, 29), date(2022, 6, 20), date(2021, 12, 24), date(2023, 1, 2), date(2024, 11, 28), date(2025, 1, 9)]
    assert not days & set(closed)
    assert {date(2021, 12, 31), date(2021, 6, 18), date(2024, 11, 29)} <= days
    assert sum(d.year == 2024 for d in days) == 252


def test_early_closes():
    """Half days against a plain list of them, and the calendar's rows against the one that the SQL uses."""
    import duckdb

    from sediment.plans import bindings

    short = lambda a, b: {str(d) for d, opened, closed in calendar.sessions(a, b) if (closed - opened).seconds < 4 * 3600}
    assert short(1994, 2002) | short(2023, 2024) == set(bindings.SHORT_DAYS.split())
    for a, b in ((1994, 2002), (2023, 2024)):
        rows = duckdb.sql(f"WITH {bindings.days_sql(a, b)} SELECT calendar_date, session_date, open_utc, close_utc, next_session_date, next_open_utc FROM days ORDER BY 1").fetchall()
        bare = lambda row: tuple(x.replace(tzinfo=None) if isinstance(x, datetime) else x for x in row)
        assert rows == [bare(r) for r in calendar.calendar_rows(a, b)]


def test_visibility_is_inclusive_and_latest_wins(spark):
    rows = [(1, "e", "sector", "Tech", ts("2024-01-03T14:30:00")), (2, "e", "sector", "Industry", ts("2024-01-08T14:30:00")), (3, "e", "sector", "Technology", ts("2024-01-03T14:30:00"))]
    df = spark.createDataFrame(rows, "record_id int, entity_id string, knowledge_key string, v string, tradable_at timestamp")
    from pyspark.sql import functions as F

    at = lambda s: F.lit(s).cast("timestamp")
    assert asof.known_at(df, at("2024-01-03 14:29:59")).count() == 0
    assert asof.known_at(df, at("2024-01-03 14:30:00")).count() == 2
    (one,) = asof.known_at(df, at("2024-01-04 14:05:00"), keys=["entity_id", "knowledge_key"], order=["tradable_at", "record_id"]).collect()
    assert one.v == "Technology"


def test_asof_rows(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 1), (4, "a", 7)], "i int, k string, t int")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("b", 2, "z")], "k string, u int, v string")
    out = {r.i: r.v for r in asof.asof_rows(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert out == {1: "y", 2: "x", 3: None, 4: "x"}
    strict = {r.i: r.v for r in asof.asof_rows(left, right, ["k"], "t", "u", ["v"], inclusive=False).collect()}
    assert strict == {1: "y", 2: None, 3: None, 4: "x"}


def test_overlaps(spark):
    d = lambda s: date.fromisoformat(s)
    df = spark.createDataFrame([("k", d("2020-01-01"), d("2021-01-01")), ("k", d("2021-01-01"), None), ("j", d("2020-01-01"), None), ("j", d("2022-01-01"), d("2023-01-01"))], "k string, a date, b date")
    assert [(r.k, r.a) for r in asof.overlapping(df, ["k"], "a", "b").collect()] == [("j", d("2022-01-01"))]


def test_security_master(spark):
    d = lambda s: date.fromisoformat(s) if s else None
    history = spark.createDataFrame(
        [("cik", "0000320193", 1, None, d("2010-01-01"), None), ("ticker", "AAPL-OLD", 1, 10, d("2010-01-01"), d("2020-01-01")), ("ticker", "AAPL", 1, 10, d("2020-01-01"), None)],
        "identifier_type string, identifier_value string, entity_id long, security_id long, valid_from date, valid_to date",
    )
    entities = spark.createDataFrame([(1, "0000320193", d("2010-01-01"), None), (2, "0000000007", d("2010-01-01"), d("2030-01-01"))], "entity_id long, cik string, valid_from date, valid_to date")
    securities = spark.createDataFrame([(1, 10, "BASE", d("2010-01-01"), None, d("2021-01-01")), (2, 20, "OWN", d("2010-01-01"), None, None)], "entity_id long, security_id long, ticker string, valid_from date, valid_to date, delisted_at date")
    membership = spark.createDataFrame([(10, "core", d("2019-01-01"), d("2021-01-01"))], "security_id long, universe_name string, membership_start date, membership_end date")
    asks = [(1, "320193", "2019-12-31"), (2, " 320193", "2020-01-01"), (3, "320193", "2021-01-01"), (4, "7", "2029-12-31"), (5, "7", "2030-01-01"), (6, "x", "2020-01-01")]
    filings = spark.createDataFrame([(i, c, d(t)) for i, c, t in asks], "query_id long, cik string, as_of date")
    out = {r.query_id: (r.ticker, r.tradable, r.in_universe) for r in master.resolve_filings(filings, history, entities, securities, membership, "core").collect()}
    assert out == {1: ("AAPL-OLD", True, True), 2: ("AAPL", True, True), 3: ("AAPL", False, False), 4: ("OWN", True, False)}
