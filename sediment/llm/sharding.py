"""Sharding by sampled splitters, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import range_index, split_ranges, stored


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, ranges: int | None = None, points: int = 16384) -> DataFrame:
    """Puts every row into one of `shards` shards of near-equal size (law `bytes`), equal texts side by side.

    A row's size is its text's UTF-8 bytes plus 1. Rows are ordered by (hash of the text, id, place in the input); keys
    are sampled in proportion to size, quantiles of the sample split the key space into `ranges` ranges (None: one for each
    million rows, 512 to 4096), overfull ranges
    are subdivided, and runs of whole ranges make the shards, so a shard is off its share by about half a range, or by
    one row where single rows are larger. A group of equal texts stays in one shard unless it spans a boundary: no group,
    however large, lands in one task.

    Returns the columns of `carry` (all by default) with size long, text_crc32 long, law string, shard int, slot long
    (gapless from 0 in its shard, in key order) and grown_shard int (null: it belongs to the law `key`).
    Only slim columns are shuffled where `carry` is slim.

    Defined cases: a null text has no bytes (size 1) and crc32 0; null ids come first among equal texts; repeated rows
    are kept, each with a slot; an empty table gives an empty result; columns named as the results are replaced.
    """
    carry = [c for c in (carry or df.columns) if c not in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [f"c{i}" for i in range(len(carry))]  # no column of the caller's meets the names used here
    slim = df.select(
        *[F.col(f"`{c}`").alias(o) for c, o in zip(carry, own)],
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_k1"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("_k2"),
        F.monotonically_increasing_id().alias("_k3"),
    )
    keys = stored(slim, "shard-keys")
    cols = ["_k1", "_k2", "_k3"]
    ranges = ranges or min(4096, max(512, keys.count() // 1_000_000))
    bounds, sizes = split_ranges(keys.select(*cols, "size"), cols, "size", ranges, points)
    total = sum(s for s, _ in sizes)
    before, first, where, filled = 0, [], [], [0] * shards
    for s, n in sizes:
        k = min(shards - 1, int((before + s / 2) * shards / total)) if total else 0
        where.append(k)
        first.append(filled[k])
        filled[k] += n
        before += s
    r = F.col("_r") + 1
    within = F.row_number().over(Window.partitionBy("_r").orderBy(*cols))
    return (
        keys.withColumn("_r", range_index(cols, bounds))
        .withColumn("_n", within.cast("long"))
        .select(
            *[F.col(o).alias(c) for c, o in zip(carry, own)], "size", "text_crc32", F.lit("bytes").alias("law"),
            F.element_at(F.lit(where), r).cast("int").alias("shard"),
            (F.element_at(F.lit(first), r) + F.col("_n") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )

