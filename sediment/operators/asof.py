"""As-of operators: validity intervals, versions, and the last or next row by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import Running, ranged, running


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def valid_at(t: str | Column, start: str | Column, end: str | Column) -> Column:
    """Half-open validity: start <= t < end; a null end is open."""
    return (col(start) <= col(t)) & (col(end).isNull() | (col(t) < col(end)))


def overlapping(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose half-open interval begins before an earlier one of the same key ends.

    One sort by ranges instead of a self-join: a row overlaps if the latest end so far lies after its start.
    """
    far = F.lit("9999-12-31").cast(df.schema[end].dataType)
    rows = df.withColumn("_end", F.coalesce(F.col(end), far)).withColumn("_tie", F.xxhash64(*df.columns))
    order = [start, "_end", "_tie"]
    found = running(ranged(rows, keys, order), keys, order, {"_far": Running("max", F.col("_end"), before=True)})
    return found.where(F.col("_far") > F.col(start)).select(*df.columns)


def crossing(df: DataFrame, test: Column, start: str, end: str) -> DataFrame:
    """The rows for which `test` holds whose half-open window overlaps a window of any row for which it doesn't.

    A sweep without a key: other rows stand at their start, test rows at their end, and a test row is crossed if of all
    windows that start before its end the latest end lies after its start. One sort by ranges, each of which carries its
    furthest end on; no pairs, whatever the windows share. Rows whose window is null or ends at or before its start are
    refused with an error when the result is computed; a null `test` is one of the other rows.
    """
    other = ~F.coalesce(test, F.lit(False))
    bad = F.col(start).isNull() | F.col(end).isNull() | (F.col(end) <= F.col(start))
    told = F.when(bad, F.raise_error(F.lit("a window's end must come after its start"))).otherwise(F.when(other, F.col(start)).otherwise(F.col(end)))
    # At one moment a test row comes first: a window that starts where it ends is not crossed.
    rows = df.select(F.struct(*df.columns).alias("_row"), told.alias("_t"), other.cast("int").alias("_o"), F.col(start).alias("_s"), F.when(other, F.col(end)).alias("_e"))
    rows = rows.withColumn("_tie", F.xxhash64("_row"))
    order = ["_t", "_o", "_tie"]
    found = running(ranged(rows, [], order), [], order, {"_far": Running("max", F.col("_e"), before=True)})
    return found.where((F.col("_o") == 0) & (F.col("_far") > F.col("_s"))).select("_row.*")


def assert_no_crossing(df: DataFrame, test: Column, start: str, end: str) -> None:
    """Raises ValueError if a window of the test rows overlaps one of the others; names at most five of them."""
    found = crossing(df, test, start, end).limit(5).collect()
    if found:
        raise ValueError(f"windows overlap across folds: {[r.asDict() for r in found]}")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, whose last column should be unique."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def known_at(df: DataFrame, t: Column, visible: str = "tradable_at", keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Rows visible at t (inclusive); with keys only the latest of each."""
    seen = df.where(F.col(visible) <= t)
    return latest(seen, keys, order) if keys else seen


def asof_rows(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, values: list[str], inclusive: bool = True) -> DataFrame:
    """left with `values` of right's last row at or before left's time (before it, unless inclusive).

    Both sides are dealt by ranges of (key, time) once, and each range's last row of right is carried to the next, so a
    key with a third of all rows is many tasks. Of right's rows at one time the one with the largest hash speaks: give it
    one row a time where that matters.
    """
    tag_left, tag_right = (1, 0) if inclusive else (0, 1)
    value = F.struct(*values)
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(tag_left).alias("_o"), F.xxhash64(F.struct(*left.columns)).alias("_h"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(tag_right).alias("_o"), F.xxhash64(value).alias("_h"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"), value.alias("_r"))
    order = ["_t", "_o", "_h"]
    found = running(ranged(a.unionByName(b), keys, order), keys, order, {"_v": Running("last", F.col("_r"))})
    return found.where(F.col("_l").isNotNull()).select("_l.*", *[F.col("_v")[v].alias(v) for v in values])


def rank_at(left: DataFrame, ranked: DataFrame, keys: list[str], left_time: str, right_time: str) -> DataFrame:
    """left with start_rank: the rank of the first row of `ranked` (ranked from 1 by time in its key) at or after left's
    time. Dealt by ranges of (key, time), each of which carries its count on."""
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0).alias("_o"), F.xxhash64(F.struct(*left.columns)).alias("_h"), F.struct(*left.columns).alias("_l"))
    b = ranked.select(*keys, F.col(right_time).alias("_t"), F.lit(1).alias("_o"), F.lit(0).cast("long").alias("_h"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    order = ["_t", "_o", "_h"]
    found = running(ranged(a.unionByName(b), keys, order), keys, order, {"_n": Running("sum", F.col("_o"))})
    return found.where(F.col("_l").isNotNull()).select("_l.*", (F.col("_n") + 1).alias("start_rank"))
