"""Market bars, factors, and forward outcomes of events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from .asof import latest
from .tables import stored

HORIZONS, WINDOW, ESTIMATION = (1, 5, 20), 20, 252


def latest_bars(bars: DataFrame, as_of: Column | None = None) -> DataFrame:
    """The last received version of each security's session, across sources; with as_of only what was received by then."""
    seen = bars if as_of is None else bars.where(F.col("source_received_at") <= as_of)
    return latest(seen, ["security_id", "session_date"], ["source_received_at", "bar_id"])


def paired_bars(raw: DataFrame, adjusted: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Raw bars with their adjusted twin by (symbol, timestamp) and its factor; unmatched bars drop, later twins win.

    With the calendar's days (calendar_date, session_date, open_utc) a bar's session_open is told too, and a bar that
    stands on no session (or on a date outside the calendar) is an error.
    """
    twin = latest(adjusted, ["symbol", "ts"], ["seq"]).select("symbol", "ts", F.col("open").alias("adjusted_open"), F.col("high").alias("adjusted_high"), F.col("low").alias("adjusted_low"), F.col("close").alias("adjusted_close"))
    out = raw.join(twin, ["symbol", "ts"])
    # A close of 0 gives what IEEE 754 has for it (infinite, or NaN of 0 / 0) under ANSI mode too, where `/` is an error.
    factor = F.when(F.col("close") == 0, F.col("adjusted_close") * F.pow("close", F.lit(-1.0))).otherwise(F.try_divide("adjusted_close", "close"))
    out = out.withColumn("adjustment_factor", factor).withColumn("session_date", F.to_date(F.from_utc_timestamp("ts", "America/New_York")))
    if days is None:
        return out
    opens = days.where("calendar_date = session_date").select("session_date", F.col("open_utc").alias("_open"))
    none = F.raise_error(F.concat(F.lit("no session on "), F.col("session_date").cast("string"))).cast("timestamp")
    return out.join(opens, "session_date", "left").withColumn("session_open", F.when(F.col("_open").isNotNull(), F.col("_open")).otherwise(none)).drop("_open")


def ranked_bars(bars: DataFrame) -> DataFrame:
    """bars with rank in their security by time, the previous close and the simple return from it. A security has one bar
    a session at most, so the calendar bounds what is sorted together."""
    along = Window.partitionBy("security_id").orderBy("ts", "session_date")
    out = bars.withColumns({"rank": F.row_number().over(along).cast("long"), "prev_close": F.lag("close").over(along)})
    return out.withColumn("ret", F.try_divide("close", "prev_close") - 1)


#: Rows of a task at most about so many, whatever the number of shuffle partitions is.
TASK_ROWS = 400_000


def in_time() -> WindowSpec:
    """The bars of a security in time, apart from the moments that events ask for; measures of a bar are frames of it."""
    return Window.partitionBy("security_id", "_bar").orderBy("ts", "session_date")


def ahead(first: int, last: int) -> WindowSpec:
    """The frame from the first-th bar after a bar (0: itself, negative: before it) to the last-th."""
    return in_time().rowsBetween(first, last)


def timelines(events: DataFrame, bars: DataFrame, n_bars: int) -> DataFrame:
    """Bars (_bar 1) with ret, and the distinct moments at which events ask for a security (_bar 0), dealt by security once:
    all that follows sorts within these tasks. Sessions bound a security's bars and, as moments are opens, its moments;
    its events, which nothing bounds, are not dealt so. n_bars is about how many bars there are, or more."""
    asked = events.select("security_id", F.col("tradable_at").alias("ts")).dropna().distinct()
    parts = max(int(bars.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bars // TASK_ROWS))
    rows = bars.withColumn("_bar", F.lit(1)).unionByName(asked.withColumn("_bar", F.lit(0)), allowMissingColumns=True)
    return rows.repartition(parts, "security_id").withColumn("ret", F.try_divide("close", F.lag("close").over(in_time())) - 1)


def at_starts(events: DataFrame, rows: DataFrame, start: dict[str, Column], prior: dict[str, Column] | None = None, told: dict[str, Column] | None = None) -> DataFrame:
    """events (security_id, tradable_at, ...) with measures of the bar at which they start (the first at or after tradable_at)
    and, by `prior`, of the last bar before; the structs _start and _prior are null where there is no such bar.

    rows are timelines(events, ...), measures are frames of in_time(), computed along the bars; `told`, if given, is computed
    from the measures for bars at which an event starts alone. No event meets more than its own moment's row.
    """
    order = ["ts", "_bar", "session_date"]
    merged = Window.partitionBy("security_id").orderBy(*order)
    if prior:
        rows = rows.withColumns({f"_p_{n}": c for n, c in prior.items()})
        before = F.when(F.col("_bar") == 1, F.struct(*[F.col(f"_p_{n}").alias(n) for n in prior]))
        rows = rows.withColumn("_prior", before).withColumn("_prior", F.last("_prior", ignorenulls=True).over(merged.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_starts", (F.col("_bar") == 1) & (F.lag("_bar").over(merged) == 0))
    rows = rows.withColumns({f"_m_{n}": c for n, c in start.items()}).where((F.col("_bar") == 0) | F.col("_starts"))
    kept = rows.select("security_id", *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *(["_prior"] if prior else []), *[F.col(f"_m_{n}").alias(n) for n in start])
    carried = F.struct(*[c.alias(n) for n, c in told.items()] if told else [F.col(n) for n in start])
    kept = kept.select("security_id", "_o0", "_o1", "_o2", *(["_prior"] if prior else []), F.when(F.col("_o1") == 1, carried).alias("_start"))
    back = Window.partitionBy("security_id").orderBy(*[F.col(f"_o{i}").desc() for i in range(3)]).rowsBetween(Window.unboundedPreceding, 0)
    found = kept.withColumn("_start", F.last("_start", ignorenulls=True).over(back)).where("_o1 = 0")
    return events.join(found.select("security_id", F.col("_o0").alias("tradable_at"), "_start", *(["_prior"] if prior else [])), ["security_id", "tradable_at"], "left")


def first_day() -> Column:
    """A start bar's return within its session."""
    return F.try_divide("close", "open") - 1


def deviation(day: str, n: str, mean: str, var: str) -> Column:
    """The sample deviation of `day` and of n values of which mean and population variance are known; null under two."""
    m2, gap = F.col(var) * F.col(n), F.col(day) - F.col(mean)
    both = F.when(F.col(n) > 0, F.sqrt((m2 + gap * gap * F.col(n) / (F.col(n) + 1)) / F.col(n)))
    return F.when(F.col(day).isNotNull(), both).otherwise(F.when(F.col(n) > 1, F.sqrt(m2 / (F.col(n) - 1))))


def later_returns() -> dict[str, Column]:
    """What deviation() needs of a start bar: the return within the session, and those from session to session after it."""
    w = ahead(1, WINDOW - 1)
    return {"day": first_day(), "n_ret": F.count("ret").over(w), "mean_ret": F.avg("ret").over(w), "var_ret": F.var_pop("ret").over(w)}


def fitted(pdf: pd.DataFrame, least: int) -> tuple | None:
    """(alpha, b_market, b_smb, b_hml, n) of excess returns on three factors by least squares; None if short or rank-deficient."""
    if len(pdf) < least:
        return None
    x = np.column_stack([np.ones(len(pdf)), pdf[["mkt", "smb", "hml"]].to_numpy(float)])
    y = pdf["ret"].to_numpy(float) - pdf["rf"].to_numpy(float)
    coef, _, rank, _ = np.linalg.lstsq(x, y, rcond=None)
    return None if rank < 4 else (*map(float, coef), len(pdf))


def factor_models(observations: DataFrame, least: int = 120, estimation: int = ESTIMATION) -> DataFrame:
    """observations (event_id, k < 0, ret, mkt, smb, hml, rf) to one model an event over its last `estimation` rows.

    A group is one event's rows, so it is bounded by what the caller puts in; k orders them.
    """

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        model = fitted(pdf.sort_values("k").tail(estimation), least)
        cols = ["event_id", "alpha", "beta_market", "beta_smb", "beta_hml", "n_obs"]
        return pd.DataFrame([(key[0], *model)] if model else [], columns=cols)

    return observations.groupBy("event_id").applyInPandas(fit, "event_id long, alpha double, beta_market double, beta_smb double, beta_hml double, n_obs long")


X = ["mkt", "smb", "hml"]


def terms() -> dict[str, Column]:
    y = F.col("ret") - F.col("rf")
    return {"y": y, **{a: F.col(a) for a in X}, **{f"{a}_{b}": F.col(a) * F.col(b) for i, a in enumerate(X) for b in X[i:]}, **{f"{a}_y": F.col(a) * y for a in X}}


def rolling_sums(rows: DataFrame, keys: list[str], estimation: int) -> DataFrame:
    """rows (keys, m: 1, 2, ... in each key) with _sums: of each of terms() over the last `estimation` rows of the key.

    Rows stand in blocks of `estimation`. Sums run from each block's start and, backwards, from its end, so a window is the
    end of one block and the start of the next: no differences, and what is not finite spoils only windows that hold it.
    """
    what = terms()
    block = Window.partitionBy(*keys, "_block")
    upto, onward = (block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.col("m"), F.col("m").desc()))
    sums = lambda w: F.struct(*[F.sum(t).over(w).alias(n) for n, t in what.items()])
    rows = rows.withColumn("_block", F.floor((F.col("m") - 1) / estimation)).withColumn("_down", sums(onward)).withColumn("_up", sums(upto))
    # A window that is a block, or all there is so far, needs no other block's end.
    rows = rows.withColumn("_rest", F.lag("_down", estimation - 1).over(Window.partitionBy(*keys).orderBy("m")))
    rest = F.when(F.col("m") % estimation != 0, F.col("_rest"))
    both = F.struct(*[(F.col("_up")[n] + F.coalesce(rest[n], F.lit(0.0))).alias(n) for n in what])
    return rows.withColumn("_sums", both).drop("_block", "_down", "_up", "_rest")


MODEL = ["alpha", "beta_market", "beta_smb", "beta_hml", "n_obs"]


def solved(df: DataFrame, least: int, estimation: int, carry: list[str]) -> DataFrame:
    """df (m, _sums, carry) as carry and MODEL, the least squares fit of the last min(m, estimation) rows; all of it is null
    for under `least` rows, a value that is not finite, or dependent factors."""
    n = F.least(F.col("m"), F.lit(estimation))
    names = list(terms())
    ok = F.col("m").isNotNull() & (n >= least)
    told = df.select(*carry, ok.alias("_ok"), n.cast("long").alias("n_obs"), *[(F.col("_sums")[t] / n).alias(f"e_{t}") for t in names])
    for t in names:
        told = told.withColumn("_ok", F.col("_ok") & (F.abs(f"e_{t}") < float("inf")))
    e = lambda t: F.col(f"e_{t}")
    cov = lambda a, b: e(f"{a}_{b}") - e(a) * e(b)
    moments = {f"c{i}{j}": cov(a, b) for i, a in enumerate(X) for j, b in enumerate(X) if i <= j} | {f"r{i}": cov(a, "y") for i, a in enumerate(X)}
    told = told.select(*carry, "_ok", "n_obs", "e_y", *[f"e_{a}" for a in X], *[v.alias(k) for k, v in moments.items()])
    c = lambda i, j: F.col(f"c{min(i, j)}{max(i, j)}")
    minor = lambda i, j: c((i + 1) % 3, (j + 1) % 3) * c((i + 2) % 3, (j + 2) % 3) - c((i + 1) % 3, (j + 2) % 3) * c((i + 2) % 3, (j + 1) % 3)
    det = sum((c(0, j) * minor(0, j) for j in range(1, 3)), c(0, 0) * minor(0, 0))
    told = told.withColumn("det", det).withColumn("_ok", F.coalesce(F.col("_ok") & (F.col("det") > c(0, 0) * c(1, 1) * c(2, 2) * 1e-12), F.lit(False)))
    beta = [F.try_divide(sum((F.col(f"r{j}") * minor(i, j) for j in range(1, 3)), F.col("r0") * minor(i, 0)), F.col("det")) for i in range(3)]
    told = told.withColumns({f"b{i}": v for i, v in enumerate(beta)})
    alpha = F.col("e_y") - F.col("b0") * F.col("e_mkt") - F.col("b1") * F.col("e_smb") - F.col("b2") * F.col("e_hml")
    return told.select(*carry, *[F.when(F.col("_ok"), v).alias(k) for k, v in zip(MODEL, (alpha, F.col("b0"), F.col("b1"), F.col("b2"), F.col("n_obs")))])


def rolling_models(upto: DataFrame, matched: DataFrame, least: int, estimation: int) -> DataFrame:
    """(event_id, alpha, beta_market, beta_smb, beta_hml, n_obs): for each event (event_id, security_id, upto) a least
    squares fit over the security's last `estimation` matched sessions (numbered m) up to `upto`, where there is one."""
    sums = rolling_sums(matched, ["security_id"], estimation).select("security_id", F.col("m").alias("upto"), "m", "_sums")
    return solved(upto.join(sums, ["security_id", "upto"]), least, estimation, ["event_id"]).where("n_obs is not null").select("event_id", *MODEL)


def halts() -> dict[str, Column]:
    """Measures of a start bar's sessions for halted_of()."""
    of = lambda status, f: f(F.when(F.col("trading_status") == status, 1).otherwise(0)).over(ahead(0, WINDOW - 1))
    return {"some_halted": of("halted", F.max), "all_normal": of("normal", F.min)}


def halted_of(some_halted: str, all_normal: str) -> Column:
    """true if any status is halted, false if all are normal, else null."""
    return F.when(F.col(some_halted) == 1, True).when(F.col(all_normal) == 1, False)


def aligned(name: str, horizons=HORIZONS) -> dict[str, Column]:
    """Measures of a start bar from another series' {name}_open and {name}_close of the same sessions: for each horizon how
    many of its sessions the series has, and its close at the last."""
    c = f"{name}_close"
    return {f"{name}_open": F.col(f"{name}_open")} | {f"{name}_n{h}": F.count(c).over(ahead(0, h - 1)) for h in horizons} | {f"{name}_close{h}": F.lead(c, h - 1).over(in_time()) for h in horizons}


def aligned_return(name: str, h: int) -> Column:
    """From aligned(): close of the h-th session over open of the first; null unless the event has h sessions and the series
    has all of them."""
    return F.when(F.col(f"{name}_n{h}") == h, F.try_divide(f"{name}_close{h}", f"{name}_open") - 1)


def outcome_labels(events: DataFrame, bars: DataFrame, benchmark: DataFrame, sectors: DataFrame, factors: DataFrame, least: int = 120, low_liquidity: float = 5e6, extreme: float = 0.03, estimation: int = ESTIMATION) -> DataFrame:
    """One outcome label for each event (event_id, security_id, sector, tradable_at, same_day_filings).

    bars: latest versions (security_id, session_date, ts, open, high, low, close, volume, trading_status), adjusted;
    benchmark: (session_date, open, close); sectors: the same with sector; factors: (session_date, mkt, smb, hml, rf).
    All measures are null where the event has no bar at or after tradable_at.
    """
    rows = with_series(timelines(events, bars, bars.count()), factors, benchmark)
    rows = with_models(rows, least, estimation)
    after, first5, before = ahead(0, WINDOW - 1), ahead(0, 4), ahead(-WINDOW, -1)
    step = F.struct((F.col("ret") - F.col("rf")).alias("y"), *FACTORS)
    start = {
        "n_after": F.count("*").over(after), "start_session": F.col("session_date"), "start_price_timestamp": F.col("ts"), "open0": F.col("open"),
        **{f"close_{h}": F.lead("close", h - 1).over(in_time()) for h in HORIZONS}, **later_returns(),
        "low20": F.min("low").over(after), "high20": F.max("high").over(after), "vol5": F.avg("volume").over(first5), "vol20": F.avg("volume").over(before),
        "dollars": F.avg(F.col("close") * F.col("volume")).over(before), **halts(),
        **aligned("b"), **{f"day{i}": F.lead("session_date", i).over(in_time()) for i in range(1, 5)}, **{c: F.col(c) for c in MODEL}, "path": F.collect_list(step).over(after),
    }
    left = lambda y, s: y - F.col("alpha") - F.col("beta_market") * s["mkt"] - F.col("beta_smb") * s["smb"] - F.col("beta_hml") * s["hml"]
    path = F.col("path")
    zero = F.get(path, F.lit(0))
    # A null in any session makes the product null: a residual needs all of them.
    residual = F.when(F.size(path) == WINDOW, F.aggregate(F.slice(path, 2, WINDOW), 1 + left(F.col("day") - zero["rf"], zero), lambda p, s: p * (1 + left(s["y"], s))) - 1)
    told = {c: F.col(c) for c in start if c not in ("path", "day", "n_ret", "mean_ret", "var_ret", "some_halted", "all_normal") and not c.startswith("b_")}
    told |= {f"bench_{h}": aligned_return("b", h) for h in HORIZONS} | {"sd": deviation("day", "n_ret", "mean_ret", "var_ret"), "residual": residual}
    told |= {"n_day": F.col("n_ret") + F.col("day").isNotNull().cast("int"), "trading_halt": halted_of("some_halted", "all_normal")}
    found = at_starts(events, rows, start, told=told)
    out = found.select(*events.columns, "_start.*")
    s = stored(sectors.select("sector", "session_date", F.col("open").alias("_open"), F.col("close").alias("_close")), "sectors")
    for i in range(5):  # a sector's series is as long as the calendar
        on = ["sector", "start_session" if i == 0 else f"day{i}"]
        out = out.join(s.select("sector", F.col("session_date").alias(on[1]), *([F.col("_open").alias("_s_open")] if i == 0 else []), F.col("_close").alias(f"_s{i}")), on, "left")
    whole = F.lit(True)
    for i in range(5):
        whole &= F.col(f"_s{i}").isNotNull()
    out = out.withColumn("sector_5", F.when(whole, F.try_divide("_s4", "_s_open") - 1))
    raw = lambda h: F.when(F.col("n_after") >= h, F.try_divide(F.col(f"close_{h}"), F.col("open0")) - 1)
    n = F.coalesce("n_after", F.lit(0))
    return out.select(
        "event_id", "security_id", "tradable_at", "start_session", "start_price_timestamp",
        *[raw(h).alias(f"raw_return_{h}d") for h in HORIZONS],
        *[(raw(h) - F.col(f"bench_{h}")).alias(f"market_adjusted_return_{h}d") for h in HORIZONS],
        (raw(5) - F.col("sector_5")).alias("sector_adjusted_return_5d"),
        F.when(F.col("n_day") >= 2, F.col("sd") * (252**0.5)).alias("realized_volatility_20d"),
        (F.try_divide("low20", "open0") - 1).alias("mae_20d"), (F.try_divide("high20", "open0") - 1).alias("mfe_20d"),
        F.when((n >= 5) & (F.col("vol20") > 0), F.try_divide("vol5", "vol20") - 1).alias("volume_abnormality_5d"),
        *[F.when(n > 0, F.col(c)).alias(c) for c in ("alpha", "beta_market", "beta_smb", "beta_hml", "n_obs")], F.when(n >= 20, F.col("residual")).alias("factor_residual_return_20d"),
        F.when(n > 0, F.col("dollars") < low_liquidity).alias("low_liquidity"),
        (F.abs("bench_1") >= extreme).alias("extreme_market_move"),
        F.when(n > 0, F.col("trading_halt")).alias("trading_halt"),
        ((n < 20) | F.col("bench_1").isNull() | F.col("bench_5").isNull() | F.col("bench_20").isNull() | F.col("sector_5").isNull()).alias("missing_price_data"),
        (F.col("same_day_filings") > 1).alias("multiple_same_day_filings"),
    )


FACTORS = ["mkt", "smb", "hml", "rf"]


def with_series(rows: DataFrame, factors: DataFrame, benchmark: DataFrame | None = None) -> DataFrame:
    """timelines with their session's factors (and the benchmark's b_open and b_close). Series have one row a session, so the
    calendar bounds them: they are broadcast, and what was dealt by security stays so."""
    out = rows.join(F.broadcast(factors.select("session_date", *FACTORS)), "session_date", "left")
    if benchmark is not None:
        out = out.join(F.broadcast(benchmark.select("session_date", F.col("open").alias("b_open"), F.col("close").alias("b_close"))), "session_date", "left")
    return out


def with_models(rows: DataFrame, least: int, estimation: int) -> DataFrame:
    """with_series with MODEL: of each bar over its security's last `estimation` matched sessions before it, those that have
    a return and factors. Sessions are matched with factors before a window is cut, so a model uses sessions, not bars."""
    carry = rows.columns
    matched = (F.col("mkt").isNotNull() & F.col("ret").isNotNull()).cast("int")
    rows = rows.withColumn("_matched", matched).withColumn("m", F.sum("_matched").over(ahead(Window.unboundedPreceding, 0)))
    rows = rolling_sums(rows, ["security_id", "_bar", "_matched"], estimation)
    last = F.last(F.when(F.col("_matched") == 1, F.struct("m", "_sums")), ignorenulls=True).over(ahead(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_last", last).select(*carry, F.col("_last.m").alias("m"), F.col("_last._sums").alias("_sums"))
    return solved(rows, least, estimation, carry)


def event_models(events: DataFrame, bars: DataFrame, factors: DataFrame, least: int = 120, estimation: int = ESTIMATION) -> DataFrame:
    """The models of outcome_labels alone: of events that start at a bar and have one."""
    slim = bars.select("security_id", "session_date", "ts", "close")
    rows = with_models(with_series(timelines(events, slim, bars.count()), factors), least, estimation)
    found = at_starts(events.select("event_id", "security_id", "tradable_at"), rows, {c: F.col(c) for c in MODEL})
    return found.where("_start.n_obs is not null").select("event_id", "_start.*")
