"""Outcome labels on golden values."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from sediment.operators import market
from sediment.operators.calendar import sessions

BARS = "security_id long, session_date date, ts timestamp, open double, high double, low double, close double, volume long, trading_status string"


def bars(security, days, growth, volume=lambda i: 1000, status="normal"):
    out = []
    for i, d in enumerate(days):
        o, c = 100 * growth**i, 100 * growth ** (i + 1)
        out.append((security, d, datetime(d.year, d.month, d.day, 14, 30), o, max(o, c) * 1.01, min(o, c) * 0.99, c, volume(i), status))
    return out


def test_outcomes(spark):
    days = [d for d, _, _ in sessions(2023, 2024)]
    at = next(i for i, d in enumerate(days) if d.isoformat() == "2024-01-02")
    prior, after = days[at - 30 : at], days[at : at + 20]
    rng = np.random.default_rng(4)
    flat = [(1, d, datetime(d.year, d.month, d.day, 14, 30), 100.0, 101.0, 99.0, float(100.0 * (1 + x)), 1000, "normal") for d, x in zip(prior, rng.normal(0, 0.01, 30))]
    stock = spark.createDataFrame(flat + bars(1, after, 1.01, lambda i: 2000 if i < 5 else 1000), BARS)
    bench = spark.createDataFrame([(b[1], b[3], b[6]) for b in bars(0, after, 1.005)], "session_date date, open double, close double")
    sector = spark.createDataFrame([(7, b[1], b[3], b[6]) for b in bars(0, after, 1.007)], "sector long, session_date date, open double, close double")
    factors = spark.createDataFrame([(d, float(a), float(b), float(c), 1e-4) for d, a, b, c in zip(prior + after, *rng.normal(0, 0.01, (3, 50)))], "session_date date, mkt double, smb double, hml double, rf double")
    events = spark.createDataFrame([(1, 1, 7, datetime(2024, 1, 2, 14, 30), 2), (2, 1, 7, datetime(2024, 1, 2, 14, 45), 1), (3, 1, 7, datetime(2024, 2, 20), 1)], "event_id long, security_id long, sector long, tradable_at timestamp, same_day_filings long")
    out = {r.event_id: r for r in market.outcome_labels(events, stock, bench, sector, factors, least=20).collect()}
    r = out[1]
    for h in (1, 5, 20):
        assert r[f"raw_return_{h}d"] == pytest.approx(1.01**h - 1)
        assert r[f"market_adjusted_return_{h}d"] == pytest.approx(1.01**h - 1.005**h)
    assert r.sector_adjusted_return_5d == pytest.approx(1.01**5 - 1.007**5)
    assert r.realized_volatility_20d == pytest.approx(0, abs=1e-9)
    assert r.mae_20d == pytest.approx(-0.01) and r.mfe_20d == pytest.approx(1.01**21 - 1)
    assert r.volume_abnormality_5d == pytest.approx(1.0) and r.low_liquidity and r.trading_halt is False
    assert r.factor_residual_return_20d is not None and r.multiple_same_day_filings and not r.missing_price_data
    assert out[2].start_session == after[1] and out[2].raw_return_20d is None and out[2].missing_price_data
    assert out[3].start_session is None and out[3].raw_return_1d is None and out[3].missing_price_data and out[3].alpha is None


def test_status_unknown_and_short(spark):
    days = [d for d, _, _ in sessions(2024, 2024)][:1]
    stock = spark.createDataFrame(bars(1, days, 1.01, status="unknown"), BARS)
    none = spark.createDataFrame([], "sector long, session_date date, open double, close double")
    factors = spark.createDataFrame([], "session_date date, mkt double, smb double, hml double, rf double")
    events = spark.createDataFrame([(1, 1, 7, datetime(2024, 1, 2, 14, 30), 1)], "event_id long, security_id long, sector long, tradable_at timestamp, same_day_filings long")
    (r,) = market.outcome_labels(events, stock, none.drop("sector"), none, factors).collect()
    assert r.trading_halt is None and r.raw_return_1d == pytest.approx(0.01) and r.raw_return_5d is None and r.missing_price_data and r.extreme_market_move is None


def test_factor_model():
    i = np.arange(30)
    m, s, h = (i - 15) / 1e4, ((i % 5) - 2) / 2e4, ((i % 7) - 3) / 3e4
    pdf = pd.DataFrame({"mkt": m, "smb": s, "hml": h, "rf": 1e-4, "ret": 1e-4 + 2e-4 + 1.2 * m + 0.3 * s - 0.2 * h})
    assert market.fitted(pdf, 20) == pytest.approx((2e-4, 1.2, 0.3, -0.2, 30))
    assert market.fitted(pdf, 31) is None
    assert market.fitted(pdf.assign(smb=0.0), 20) is None


def test_estimation_window_takes_the_last_252(spark):
    rng = np.random.default_rng(1)
    rows = [(1, -253 + i, 9.9 if i == 0 else float(2e-4 + x), float(x), float(y), float(z), 1e-4) for i, (x, y, z) in enumerate(rng.normal(0, 0.01, (253, 3)))]
    df = spark.createDataFrame([(a, k, r, x, y, z, f) for a, k, r, x, y, z, f in rows], "event_id long, k int, ret double, mkt double, smb double, hml double, rf double")
    (r,) = market.factor_models(df, 120).collect()
    assert r.n_obs == 252 and r.alpha == pytest.approx(1e-4) and r.beta_market == pytest.approx(1)


def test_bars_outside_sessions_are_refused(spark):
    from sediment.operators.calendar import calendar

    bar = lambda *at: spark.createDataFrame([("X", datetime(*a), 1, 10.0, 12.0, 9.0, 11.0) for a in at], "symbol string, ts timestamp, seq int, open double, high double, low double, close double")
    days = calendar(spark, 2024, 2024)
    (r,) = market.paired_bars(bar((2024, 1, 2, 5)), bar((2024, 1, 2, 5)), days).collect()
    assert (r.session_date.isoformat(), r.session_open, r.adjustment_factor) == ("2024-01-02", datetime(2024, 1, 2, 14, 30), 1.0)
    for off in ((2024, 1, 6, 15), (2024, 1, 1, 15), (2031, 1, 2, 15)):
        with pytest.raises(Exception, match="no session on"):
            market.paired_bars(bar(off), bar(off), days).collect()


def test_a_close_of_zero_has_the_factor_of_ieee_754(spark):
    at = datetime(2024, 1, 2, 15)
    bar = lambda *closes: spark.createDataFrame([(f"S{i}", at, 1, 1.0, 1.0, 1.0, c) for i, c in enumerate(closes)], "symbol string, ts timestamp, seq int, open double, high double, low double, close double")
    out = {r.symbol: r.adjustment_factor for r in market.paired_bars(bar(0.0, 0.0, -0.0, 4.0, None), bar(1.1, 0.0, 1.1, 2.0, 1.0)).collect()}
    assert out["S0"] == np.inf and np.isnan(out["S1"]) and out["S2"] == -np.inf and out["S3"] == 0.5 and out["S4"] is None


def test_measures_of_starts_move_no_window(spark):
    """Each event meets one row of its own moment: what is shuffled for it doesn't grow with the bars around it."""
    days = [d for d, _, _ in sessions(2023, 2023)][:60]
    stock = spark.createDataFrame([b for k in (1, 2) for b in bars(k, days, 1.01, lambda i: i)], BARS)
    moments = {1: days[0], 2: days[30], 3: days[59], 4: days[59] + timedelta(9)}  # the last is after all bars
    events = spark.createDataFrame([(10 * k + i, k, datetime(d.year, d.month, d.day, 14, 30)) for k in (1, 2, 3) for i, d in moments.items()] + [(40, 1, None)], "event_id long, security_id long, tradable_at timestamp")
    w = market.ahead
    from pyspark.sql import functions as F

    rows = market.timelines(events, stock, 120)
    df = market.at_starts(events, rows, {"day": F.col("session_date"), "n": F.count("*").over(w(0, 19)), "last": F.lead("volume", 19).over(market.in_time())}, {"n": F.count("*").over(w(-19, 0)), "sum": F.sum("volume").over(w(-19, 0))})
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    out = {r.event_id: r for r in df.collect()}
    for k in (1, 2):
        assert tuple(out[10 * k + 1]._start) == (days[0], 20, 19) and out[10 * k + 1]._prior is None
        assert tuple(out[10 * k + 2]._start) == (days[30], 20, 49) and tuple(out[10 * k + 2]._prior) == (20, sum(range(10, 30)))
        assert tuple(out[10 * k + 3]._start) == (days[59], 1, None) and tuple(out[10 * k + 3]._prior) == (20, sum(range(39, 59)))
        assert out[10 * k + 4]._start is None and tuple(out[10 * k + 4]._prior) == (20, sum(range(40, 60)))
    assert all(out[i]._start is None and out[i]._prior is None for i in (31, 32, 33, 34, 40))


def test_deviation_with_a_first_day(spark):
    from pyspark.sql import functions as F

    rows = [(1, 0.5, [0.1, 0.2, 0.4]), (2, None, [0.1, 0.2, 0.4]), (3, 0.5, []), (4, 0.5, [0.5]), (5, None, [0.1])]
    df = spark.createDataFrame([(i, d, len(r), float(np.mean(r)) if r else None, float(np.var(r)) if r else None) for i, d, r in rows], "i long, d double, n long, mean double, var double")
    got = {r.i: r.sd for r in df.select("i", market.deviation("d", "n", "mean", "var").alias("sd")).collect()}
    for i, d, r in rows:
        x = [v for v in [d, *r] if v is not None]
        assert got[i] == (pytest.approx(np.std(x, ddof=1)) if len(x) > 1 else None), i


def test_latest_versions(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t.date(), t + timedelta(k), k, s) for k, s in ((1, "a"), (3, "b"), (2, "a"))], "security_id long, session_date date, source_received_at timestamp, bar_id long, source string")
    from pyspark.sql import functions as F

    assert [r.source for r in market.latest_bars(df).collect()] == ["b"]
    assert [r.bar_id for r in market.latest_bars(df, F.lit(t + timedelta(2))).collect()] == [2]
