"""Exact deduplication by two passes over Bloom filters."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, fresh, join_hot, shared_dir, stored

#: Bits a row, and the most bits of one filter: larger inputs are filtered in slices of the hash space.
BITS_A_ROW, MOST_BITS = 16, 1 << 28
#: Slices that run side by side (so many filters are broadcast at a time), and the tasks that deal the rows of one slice.
SIDE, WAYS = 4, 8
#: Words of 64 bits that are merged in one task.
CHUNK = 1 << 16


def _marks(hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocked Bloom filter: for each hash the 64-bit word it falls into and four bits there."""
    h = hashes.astype(np.uint64)
    word = ((h >> np.uint64(32)) * np.uint64(words)) >> np.uint64(32)
    m = h * np.uint64(0x9E3779B97F4A7C15)
    mask = np.zeros(len(h), np.uint64)
    for shift in (58, 46, 34, 22):
        mask |= np.uint64(1) << ((m >> np.uint64(shift)) & np.uint64(63))
    return word.astype(np.int64), mask


def _fold(word: np.ndarray, once: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges marks of equal words: a bit met in two marks is set in twice."""
    order = np.argsort(word, kind="stable")
    word, once, twice = word[order], once[order], twice[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]]) if len(word) else np.zeros(0, int)
    rank = np.arange(len(word)) - np.repeat(first, np.diff(np.r_[first, len(word)]))
    one, two = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64)
    at = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(word)]))
    if len(word) and rank.max() > 64:  # long runs: bit by bit, without a pass for each repeat
        for b in range(64):
            bit = np.uint64(1) << np.uint64(b)
            hits = np.bincount(at, weights=(once & bit) != 0, minlength=len(first))
            one |= np.where(hits >= 1, bit, np.uint64(0))
            two |= np.where(hits >= 2, bit, np.uint64(0))
        np.bitwise_or.at(two, at, twice)
    else:
        for k in range(int(rank.max()) + 1 if len(word) else 0):
            at_k, rows = at[rank == k], rank == k
            two[at_k] |= (one[at_k] & once[rows]) | twice[rows]
            one[at_k] |= once[rows]
    return word[first], one, two


def _tested(bits, words: int):
    @F.pandas_udf("boolean")
    def repeated(h: pd.Series) -> pd.Series:
        word, mask = _marks(h.to_numpy(), words)
        return pd.Series((bits.value[word] & mask) == mask)

    return repeated


def flag_repeated(keys: DataFrame, hash_col: str, rows: int) -> DataFrame:
    """keys with a column maybe: true for every row whose hash another row has too, and for about one in a hundred others.

    First pass: each task marks its hashes in a filter of bits met once and one of bits met twice, sends only the words
    it touched, and chunks of words are merged on the executors. Second pass: rows whose bits are all met twice are
    flagged. A filter has 16 bits a row and 2^28 bits (32 MB) at most, and that bound is on what is broadcast. Beyond it
    the keys are dealt once into slices of the hash space, each with a filter of its own and read by itself alone, so the
    work stays in proportion to the keys; SIDE slices run at a time. A slice's rows are dealt to WAYS tasks by the task
    they come from, so that one with a hot hash is not one task.
    """
    spark = keys.sparkSession
    slices = max(1, -(-rows * BITS_A_ROW // MOST_BITS))
    words = max(1024, -(-rows * BITS_A_ROW // slices // 64))

    def mark(batches):
        for b in batches:
            word, mask = _marks(b.column(0).to_numpy(zero_copy_only=False), words)
            word, one, two = _fold(word, mask, np.zeros_like(mask))
            columns = [word // CHUNK, word, one.view(np.int64), two.view(np.int64)]
            yield pa.record_batch([pa.array(c) for c in columns], ["chunk", "word", "one", "two"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        word, _, two = _fold(pdf["word"].to_numpy(), pdf["one"].to_numpy().view(np.uint64), pdf["two"].to_numpy().view(np.uint64))
        bits = np.zeros(CHUNK, np.uint64)
        bits[word - int(key[0]) * CHUNK] = two
        return pd.DataFrame({"chunk": [int(key[0])], "bits": [bits.tobytes()]})

    def filtered(own: DataFrame):
        marks = own.select(hash_col).mapInArrow(mark, "chunk long, word long, one long, two long")
        full = np.zeros(-(-words // CHUNK) * CHUNK, np.uint64)
        for c in marks.groupBy("chunk").applyInPandas(merge, "chunk long, bits binary").toLocalIterator():
            full[c["chunk"] * CHUNK : (c["chunk"] + 1) * CHUNK] = np.frombuffer(c["bits"], np.uint64)
        bits = spark.sparkContext.broadcast(full)
        return own.withColumn("maybe", _tested(bits, words)(hash_col)), bits

    if slices == 1:
        return filtered(keys)[0]
    base = f"{shared_dir(spark)}/sediment/dedup-slices-{uuid.uuid4().hex}"
    (number,) = fresh(keys.columns, "slice")
    dealt = keys.withColumn(number, F.pmod(F.col(hash_col), F.lit(slices)).cast("int"))
    dealt = dealt.repartition(slices * WAYS, number, F.pmod(F.spark_partition_id(), F.lit(WAYS)))
    dealt.write.partitionBy(number).parquet(f"{base}/keys")
    schema = keys.withColumn("maybe", F.lit(False)).schema

    def one(s: int) -> None:
        flagged, bits = filtered(spark.read.schema(keys.schema).parquet(f"{base}/keys/{number}={s}"))
        flagged.write.parquet(f"{base}/flagged/{number}={s}")  # a folder each: writes into one would delete each other's
        bits.destroy()

    with ThreadPoolExecutor(SIDE) as pool:
        list(pool.map(one, sorted(r[0] for r in spark.read.parquet(f"{base}/keys").select(number).distinct().collect())))
    return spark.read.schema(schema).parquet(f"{base}/flagged").select(*schema.names)


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups rows whose texts are equal when all white space is deleted; of a group the row with most code points in
    its text stays, then the one with the smallest id.

    One row for each input row: id, keep_id (id of the row that stays), group_size long, kept boolean, text_sha256 (of
    the normalised text). Only rows that the Bloom filters report shuffle, and only their id, length and hash; the
    others are groups of one and pass straight through. Groups that hold over 1/1024 of those rows are joined by
    broadcast (at most 1024 of them), so a group that holds a third of all rows shuffles only as partial aggregates.

    Defined cases: null counts as empty; null ids come after all others; of rows equal in id and length just one stays;
    other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(
        F.col(id_col).alias("id"),
        F.char_length(text).cast("long").alias("n"),
        F.unhex(F.sha2(F.regexp_replace(text, f"{WS}+", ""), 256)).alias("sha"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("h", F.xxhash64("sha"))
    keys = stored(slim, "dedup-keys")
    flagged = stored(flag_repeated(keys, "h", keys.count()), "dedup-flagged")
    maybe = flagged.where("maybe")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row")))
    groups = maybe.groupBy("sha").agg(F.count("*").alias("size"), best.alias("best"))
    groups = stored(groups.select("sha", "size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "dedup-groups")
    told = join_hot(maybe, groups, "sha", "size", "inner")
    passed = flagged.where("not maybe").withColumns({"size": F.lit(1), "keep_id": F.col("id"), "keep_row": F.col("row")})
    return told.unionByName(passed, allowMissingColumns=True).select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("size").cast("long").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
