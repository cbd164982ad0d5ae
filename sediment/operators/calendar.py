"""Exchange sessions and the time from which a disclosure can be traded on."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEW_YORK = ZoneInfo("America/New_York")
#: Full-day closures outside the yearly rules.
CLOSED = {date(2001, 9, d) for d in (11, 12, 13, 14)} | {date(1994, 4, 27), date(2004, 6, 11), date(2007, 1, 2), date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9)}
#: Early closes outside the yearly rules.
SHORT = {date(1997, 12, 26), date(1999, 12, 31), date(2003, 12, 26)}
SCHEMA = "calendar_date date, session_date date, open_utc timestamp, close_utc timestamp, next_session_date date, next_open_utc timestamp"


def _nth(year: int, month: int, weekday: int, n: int) -> date:
    if n > 0:
        first = date(year, month, 1)
        return first + timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
    return last - timedelta((last.weekday() - weekday) % 7)


def _easter(year: int) -> date:
    a, b, c = year % 19, year // 100, year % 100
    h = (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30
    k = (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7
    m = (a + 11 * h + 22 * k) // 451
    return date(year, (h + k - 7 * m + 114) // 31, (h + k - 7 * m + 114) % 31 + 1)


def _observed(d: date, saturday: bool = True) -> date | None:
    if d.weekday() == 5:
        return d - timedelta(1) if saturday else None
    return d + timedelta(1) if d.weekday() == 6 else d


def holidays(year: int) -> set[date]:
    out = {_observed(date(year, 1, 1), False), _nth(year, 2, 0, 3), _easter(year) - timedelta(2), _nth(year, 5, 0, -1), _observed(date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4), _observed(date(year, 12, 25))}
    if year >= 1998:
        out.add(_nth(year, 1, 0, 3))
    if year >= 2022:
        out.add(_observed(date(year, 6, 19)))
    return {d for d in out if d}


def early_closes(year: int) -> set[date]:
    """Days that close at 13:00, from 1993: the one after Thanksgiving and the 24th of December; from 1995 the 3rd of July
    on a Monday, Tuesday or Thursday, and before 2013 a Friday after the holiday, since then a Wednesday before it."""
    out = {_nth(year, 11, 3, 4) + timedelta(1), date(year, 12, 24)} | SHORT if year >= 1993 else set()
    third = date(year, 7, 3)
    if year >= 1995 and third.weekday() in (0, 1, 3) or year >= 2013 and third.weekday() == 2:
        out.add(third)
    if 1995 <= year < 2013 and third.weekday() == 2:
        out.add(date(year, 7, 5))
    return out


def sessions(first: int, last: int) -> list[tuple[date, datetime, datetime]]:
    """(session, open, close) in UTC of the years first..last by the exchange's yearly rules."""
    out = []
    for year in range(first, last + 1):
        off = holidays(year) | CLOSED
        short = early_closes(year)
        d = date(year, 1, 1)
        while d.year == year:
            if d.weekday() < 5 and d not in off:
                at = lambda h, m: datetime.combine(d, time(h, m), NEW_YORK).astimezone(timezone.utc)  # noqa: B023, E731
                out.append((d, at(9, 30), at(13, 0) if d in short else at(16, 0)))
            d += timedelta(1)
    return out


def calendar_rows(first: int, last: int) -> list[tuple]:
    """One row for each calendar date: its session (the first on or after it) and the session after that."""
    found, rows, i = sessions(first, last + 1), [], 0
    d = date(first, 1, 1)
    while d <= date(last, 12, 31):
        while found[i][0] < d:
            i += 1
        (s, opened, closed), (n, n_open, _) = found[i], found[i + 1]
        rows.append((d, s, opened, closed, n, n_open))
        d += timedelta(1)
    return rows


def calendar(spark: SparkSession, first: int, last: int) -> DataFrame:
    """The calendar dimension: 366 rows a year at most, whatever the data's size."""
    return spark.createDataFrame(calendar_rows(first, last), SCHEMA)


def next_session(df: DataFrame, days: DataFrame, at: str, latency_minutes: int = 15, out: str = "tradable_at") -> DataFrame:
    """df with the first moment at which something published at `at` can be traded on.

    Before its day's open: the open plus latency. In session: the next session's open. At or after the close: the next
    session's open plus latency. Dates outside the calendar give null. An equi-join with a broadcast dimension.
    """
    local = F.to_date(F.from_utc_timestamp(F.col(at), "America/New_York"))
    wait = F.expr(f"interval {latency_minutes} minutes")
    c = F.broadcast(days.select(F.col("calendar_date").alias("_d"), "open_utc", "close_utc", "next_open_utc"))
    t = F.col(at)
    when = F.when(t < F.col("open_utc"), F.col("open_utc") + wait).when(t < F.col("close_utc"), F.col("next_open_utc")).otherwise(F.col("next_open_utc") + wait)
    return df.withColumn("_d0", local).join(c, F.col("_d0") == F.col("_d"), "left").withColumn(out, F.when(F.col("_d").isNotNull(), when)).drop("_d0", "_d", "open_utc", "close_utc", "next_open_utc")


def tradable_at(df: DataFrame, days: DataFrame, published: str, resumed: str | None = None, latency_minutes: int = 15) -> DataFrame:
    """next_session of the publication; of the resumption instead, where a halt ended after that."""
    out = next_session(df, days, published, latency_minutes)
    if resumed:
        again = next_session(out, days, resumed, latency_minutes, "_again")
        out = again.withColumn("tradable_at", F.when(F.col(resumed) > F.col("tradable_at"), F.col("_again")).otherwise(F.col("tradable_at"))).drop("_again")
    return out
