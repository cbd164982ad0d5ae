"""Running aggregates over ranges, and the operators that stand on them, under hot keys and odd values."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sediment.operators import annotation, asof, market
from sediment.operators.running import RANGE, Running, ranged, running


@pytest.fixture(scope="module")
def hot(spark):
    """A third of all rows in one key, null keys, null values."""
    rng = random.Random(1)
    rows = [(0 if i % 3 == 0 else None if i % 31 == 0 else rng.randint(1, 60), i, rng.choice([None, *range(9)])) for i in rng.sample(range(6000), 6000)]
    return rows, spark.createDataFrame(rows, "k int, t int, v int").repartition(5).cache()


def test_ranges_are_even(hot):
    """The hot key is dealt over ranges: none has above twice the mean, and the tasks of a running aggregate are the ranges."""
    _, df = hot
    dealt = ranged(df, ["k"], ["t"], 12)
    sizes = [r["count"] for r in dealt.groupBy(RANGE).count().collect()]
    assert len(sizes) == 12 and max(sizes) < 2 * 6000 / 12
    assert dealt.where("k = 0").select(RANGE).distinct().count() >= 4


def test_running(hot):
    rows, df = hot
    what = {"s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), before=True), "l": Running("last", F.col("v")), "p": Running("last", F.struct("v"), before=True)}
    got = {r["t"]: (r["s"], r["m"], r["l"], r["p"] and (r["p"]["v"],)) for r in running(ranged(df, ["k"], ["t"], 9), ["k"], ["t"], what).collect()}
    want, seen = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        past = seen.setdefault(k, [])
        known = [x for x in past if x is not None]
        here = known + ([v] if v is not None else [])
        want[t] = (sum(here) if here else None, max(known, default=None), here[-1] if here else None, (past[-1],) if past else None)
        past.append(v)
    assert got == want


def test_running_without_key_and_rows(spark, hot):
    rows, df = hot
    got = {r["t"]: r["n"] for r in running(ranged(df, [], ["t"], 7), [], ["t"], {"n": Running("sum", F.lit(1))}).collect()}
    assert got == {t: t + 1 for _, t, _ in rows}
    none = df.limit(0)
    assert running(ranged(none, ["k"], ["t"]), ["k"], ["t"], {"n": Running("sum", F.lit(1))}).collect() == []


def test_asof_under_a_hot_key(spark, hot):
    rows, df = hot
    left, right = df.where("t % 2 = 0").select("k", "t"), df.where("t % 2 = 1 and v is not null").select("k", F.col("t").alias("u"), "v")
    got = {r["t"]: r["v"] for r in asof.asof_rows(left, right, ["k"], "t", "u", ["v"]).collect()}
    want, last = {}, {}
    for k, t, v in sorted(rows, key=lambda r: r[1]):
        if t % 2 == 0:
            want[t] = last.get(k)
        elif v is not None:
            last[k] = v
    assert got == want
    ranks = right.withColumn("rank", F.expr("row_number() over (partition by k order by u)"))
    by = {r["t"]: r["start_rank"] for r in asof.rank_at(left, ranks, ["k"], "t", "u").collect()}
    assert by == {t: 1 + sum(1 for kk, u, v in rows if kk == k and u % 2 and u < t and v is not None) for k, t, _ in rows if t % 2 == 0}


def test_prior_disclosure_of_a_hot_entity(spark):
    rows = [(i, 7 if i % 3 else i, datetime(2024, 1, 1) + timedelta(hours=i // 2), f"text {i}" if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "task_id long, entity_id long, published timestamp, text string").repartition(4)
    got = {r.task_id: r.prior for r in annotation.prior_disclosure(df, 6).collect()}
    for i, e, at, _ in rows:
        past = [(t, j, x) for j, f, t, x in rows if f == e and t < at and x is not None or f == e and t < at]
        moment = max((t for t, *_ in past), default=None)
        last = max(((j, x) for t, j, x in past if t == moment), default=(0, None))[1]
        assert got[i] == (last and last[:6]), i


# --- the guard against windows that cross folds -----------------------------------------------------------------------


def spans(spark, rows):
    at = lambda h: None if h is None else datetime(2024, 1, 1) + timedelta(hours=h)
    return spark.createDataFrame([(i, e, at(a), at(b), t) for i, (e, a, b, t) in enumerate(rows)], "i int, entity string, a timestamp, b timestamp, test boolean")


def test_crossing_against_pairs(spark):
    rng = random.Random(5)
    rows = [(f"e{i % 9}", a := rng.randint(0, 4000), a + rng.choice([1, 1, 2, 3, 900 if i % 400 == 0 else 4]), rng.random() < 0.4 if i % 50 else None) for i in range(2000)]
    got = {r.i for r in asof.crossing(spans(spark, rows).repartition(6), F.col("test"), "a", "b").collect()}
    train = [(a, b) for _, a, b, t in rows if not t]
    want = {i for i, (_, a, b, t) in enumerate(rows) if t and any(a < y and x < b for x, y in train)}
    assert got == want and 0 < len(want) < sum(bool(t) for *_, t in rows)


def test_overlap_between_different_entities_is_found(spark):
    df = spans(spark, [("one", 0, 10, False), ("two", 9, 12, True), ("three", 10, 11, True)])
    assert [r.i for r in asof.crossing(df, F.col("test"), "a", "b").collect()] == [1]
    with pytest.raises(ValueError, match="across folds"):
        asof.assert_no_crossing(df, F.col("test"), "a", "b")
    asof.assert_no_crossing(df.where("i != 1"), F.col("test"), "a", "b")
    assert asof.crossing(df.limit(0), F.col("test"), "a", "b").collect() == []


@pytest.mark.parametrize("bad", [(5, 5), (5, 4), (None, 4), (4, None)])
@pytest.mark.parametrize("fold", [True, False])
def test_bad_windows_are_refused(spark, bad, fold):
    with pytest.raises(Exception, match="end must come after"):
        asof.crossing(spans(spark, [("x", 0, 1, True), ("y", *bad, fold)]), F.col("test"), "a", "b").collect()


# --- rolling models ---------------------------------------------------------------------------------------------------


def series(n, seed=2, security=1):
    rng = np.random.default_rng(seed)
    f = rng.normal(0, 0.01, (n, 3))
    ret = 1e-4 + 2e-4 + f @ [1.2, 0.3, -0.2] + rng.normal(0, 0.002, n)
    return f, ret, [(security, i + 1, float(r), *map(float, x), 1e-4) for i, (r, x) in enumerate(zip(ret, f))]


SESSIONS = "security_id long, m long, ret double, mkt double, smb double, hml double, rf double"


def models(spark, rows, ends, least=120, estimation=252):
    upto = spark.createDataFrame([(i, s, m) for i, (s, m) in enumerate(ends)], "event_id long, security_id long, upto long")
    return {ends[r.event_id]: r for r in market.rolling_models(upto, spark.createDataFrame(rows, SESSIONS), least, estimation).collect()}


def test_models_equal_least_squares_on_a_long_series(spark):
    f, ret, rows = series(10_000)
    ends = [(1, m) for m in (0, 119, 120, 251, 252, 253, 300, 503, 504, 505, 5000, 9999, 10_000)]
    got = models(spark, rows, ends)
    assert set(got) == {e for e in ends if e[1] >= 120}
    for (_, m), r in got.items():
        lo = max(0, m - 252)
        x = np.column_stack([np.ones(m - lo), f[lo:m]])
        want = np.linalg.lstsq(x, ret[lo:m] - 1e-4, rcond=None)[0]
        assert (r.alpha, r.beta_market, r.beta_smb, r.beta_hml) == pytest.approx(tuple(want), rel=1e-8, abs=1e-11) and r.n_obs == m - lo


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_one_bad_return_spoils_only_its_windows(spark, bad):
    _, _, rows = series(800)
    clean = models(spark, rows, [(1, m) for m in range(252, 801, 4)])
    rows[299] = (*rows[299][:2], bad, *rows[299][3:])
    got = models(spark, rows, [(1, m) for m in range(252, 801, 4)])
    assert set(clean) - set(got) == {(1, m) for m in range(252, 801, 4) if m - 252 < 300 <= m}
    assert all(got[e].beta_market == pytest.approx(clean[e].beta_market) for e in got)


def test_models_of_several_securities(spark):
    rows = series(600, 3, 1)[2] + series(130, 4, 2)[2] + series(20, 5, 3)[2]
    alone = models(spark, series(130, 4, 2)[2], [(2, 130)])
    got = models(spark, rows, [(1, 600), (2, 130), (3, 20)])
    assert set(got) == {(1, 600), (2, 130)} and got[2, 130].alpha == pytest.approx(alone[2, 130].alpha)
