"""Running aggregates over (key, order) that no key makes one task of: ranges of rows, and what each range carries on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

RANGE = "_range"


@dataclass(frozen=True)
class Running:
    """What to compute of the rows of a key up to a row, or strictly before it: the sum or the largest of a column, or its
    last value (nulls are passed over; wrap a value in a struct to see its nulls)."""

    kind: str
    of: Column
    before: bool = False


def ranged(df: DataFrame, keys: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df as a stored table with _range: rows are dealt by ranges of (keys, order) of near-equal size, so a key with a third
    of all rows is in a third of the ranges. Rows equal in all of keys and order stay together: let order end in what
    tells rows apart. A first key that a range has in common with the range before is its only one."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(df: DataFrame, keys: list[str], order: list[str], what: dict[str, Running]) -> DataFrame:
    """A ranged table with a column more for each of `what`.

    Each range is a task: it computes its own rows, and adds what the ranges before have of the key that runs on into it.
    That is at most one key, so at most one row a range, which is broadcast. Null keys are one key.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = {"sum": F.sum, "max": F.max}
    total: Callable[[Running], Column] = lambda r: by[r.kind](r.of) if r.kind in by else F.max_by(r.of, F.when(r.of.isNotNull(), F.struct(*order)))
    over: Callable[[Running, Column, object], Column] = lambda r, c, w: by[r.kind](c).over(w) if r.kind in by else F.last(c, ignorenulls=True).over(w)
    ends = df.groupBy(RANGE, *keys).agg(*[total(r).alias(f"_e_{n}") for n, r in what.items()])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(RANGE, *keys, F.count("*").over(earlier).alias("_earlier"), *[over(r, F.col(f"_e_{n}"), earlier).alias(f"_c_{n}") for n, r in what.items()])
    carried = carried.where("_earlier > 0").drop("_earlier").toDF(RANGE, *[f"_k_{i}" for i in range(len(keys))], *[f"_c_{n}" for n in what])
    dealt = df.repartitionById(parts, F.col(RANGE))
    own = Window.partitionBy(RANGE, *keys).orderBy(*order)
    frame = lambda r: own.rowsBetween(Window.unboundedPreceding, -1 if r.before else 0)
    dealt = dealt.withColumns({f"_w_{n}": over(r, r.of, frame(r)) for n, r in what.items()})
    same = dealt[RANGE] == carried[RANGE]
    for i, key in enumerate(keys):
        same &= dealt[key].eqNullSafe(carried[f"_k_{i}"])
    both = dealt.join(F.broadcast(carried), same, "left")

    def told(n: str, r: Running) -> Column:
        own, before = F.col(f"_w_{n}"), F.col(f"_c_{n}")
        if r.kind == "sum":
            return F.when(own.isNotNull() & before.isNotNull(), own + before).otherwise(F.coalesce(own, before))
        return F.greatest(own, before) if r.kind == "max" else F.coalesce(own, before)

    return both.select(*[dealt[c] for c in df.columns], *[told(n, r).alias(n) for n, r in what.items()])
