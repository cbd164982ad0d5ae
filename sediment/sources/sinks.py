"""Sinks: insert-or-ignore, upserts and checked inserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of new to append: those whose key is neither stored nor earlier in the batch (by `order`)."""
    w = Window.partitionBy(*keys).orderBy(order)
    first = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: str, keep_least: list[str] = (), keep_first: list[str] = ()) -> DataFrame:
    """existing with new merged in: the latest row of each key by `order` (new over old at a tie) wins.

    Columns in keep_least take the least value of all versions, those in keep_first the stored one's.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    cols = existing.columns
    last = F.max_by(F.struct(*cols), F.struct("_new", order)).alias("_l")
    more = [F.min(c).alias(f"_m_{c}") for c in keep_least] + [F.min_by(c, F.struct("_new", order)).alias(f"_f_{c}") for c in keep_first]
    agg = both.groupBy(*keys).agg(last, *more)
    value = lambda c: F.col(f"_m_{c}") if c in keep_least else F.col(f"_f_{c}") if c in keep_first else F.col("_l")[c]
    return agg.select(*[F.col(c) if c in keys else value(c).alias(c) for c in cols])


def checked_insert(existing: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """Rows of new to append; the same key with the same content is no change, with another content an error."""
    old = existing.select(F.col(key), F.col(content).alias("_old"))
    both = new.join(old, key, "left")
    clash = both.where(F.col("_old").isNotNull() & (F.col("_old") != F.col(content))).select(key).limit(5).collect()
    if clash:
        raise ValueError(f"stored with other content: {[r[0] for r in clash]}")
    return both.where(F.col("_old").isNull()).drop("_old")
