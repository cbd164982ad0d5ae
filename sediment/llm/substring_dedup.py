"""Substring deduplication by seed and extend over winnowed anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, stored, trim
from .words import U, Block, blocks

#: Stands for a null id: such rows are one document, after all others.
LAST = (1 << 63) - 1
SEED = 10


def anchors(block: Block, length: int, seed: int = SEED):
    """Winnowed anchors of a block: (document, first window, windows, seed hash, span hash, its second lane), arrays of
    one entry each.

    Every window of `length` words picks the smallest hash among its runs of `seed` words, the last of equals, so equal
    windows pick the same run wherever they stand. Windows in a row that pick the same run share one anchor; its span,
    from the first window's start to the last one's end, is as far as the seed can be extended by its windows.
    """
    n = len(block.hashes)
    counts = np.diff(block.first)
    grams = n - seed + 1
    wide = length - seed + 1
    if grams < wide:
        return None
    g = block.runs(np.arange(grams), seed)
    low = U((1 << 30) - 1)
    key = (g & ~low) | (low - np.arange(grams, dtype=U))
    best, have = key, 1
    while have * 2 <= wide:
        best = np.minimum(best[: len(best) - have], best[have:])
        have *= 2
    best = np.minimum(best[: grams - wide + 1], best[wide - have : grams - have + 1])
    pick = (low - (best & low)).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)[: len(pick)]
    ok = np.arange(len(pick)) + length <= block.first[doc + 1]
    at = np.flatnonzero(ok)
    if not len(at):
        return None
    pick, doc = pick[at], doc[at]
    new = np.r_[True, (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    windows = np.diff(np.r_[first, len(at)])
    start, seeds, doc = at[first], pick[first], doc[first]
    span = block.runs(start, windows + length - 1) ^ ((seeds - start).astype(U) * U(0x9E3779B97F4A7C15))
    return doc, start - block.first[doc], windows, g[seeds], span, block.check(start, windows + length - 1)


def repeated_runs(df: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """(id, rk, start, stop): word ranges of windows of `length` words that also start in a document with a smaller id.

    Seeds: anchors are joined on their seed's hash; those of one document only go. Extend: anchors whose seed extends to
    the same whole span are one class, and all its windows are repeated in every document but its first. Where a seed
    extends differently in several classes (at the ends of shared passages and around edits), the extension is followed
    window by window for the first document of each class. Nothing lists pairs: a passage in a third of all documents
    costs one row an anchor and document, and its minima are aggregated before they are shuffled. Spans and windows are
    equal where two hashes of their own kinds are (126 bits); a seed's hash alone only says where to look.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("rk"), text.alias("text"))

    def seeds(batches):
        for b in batches:
            ids, rks = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, _, block in blocks(b.column(2), False):
                if (found := anchors(block, length)) is not None:
                    doc, start, windows, g, span, lane = found
                    yield pa.record_batch([pa.array(x) for x in (g.view(np.int64), span.view(np.int64), lane.view(np.int64), ids[i + doc], rks[i + doc], start.astype(np.int32), windows.astype(np.int32))], ["g", "s", "t", "id", "rk", "start", "windows"])
        trim()

    found = stored(docs.mapInArrow(seeds, "g long, s long, t long, id long, rk long, start int, windows int"), "anchors")
    shared = found.groupBy("g").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("many")).where("lo < hi").select("g", "many")
    shared = stored(shared, "shared-seeds")
    found_again = stored(join_hot(found, shared, "g", "many", "inner").drop("many"), "shared-anchors")
    discard(found)
    classes = stored(found_again.groupBy("g", "s", "t").agg(F.min("id").alias("owner"), F.count("*").alias("n")), "anchor-classes")
    several = stored(classes.groupBy("g").agg(F.count("*").alias("classes"), F.sum("n").alias("many")).where("classes > 1").select("g", "many"), "open-seeds")
    owned = join_hot(found_again, classes, ["g", "s", "t"], "n", "inner")
    stop = (F.col("start") + F.col("windows") + F.lit(length - 1)).cast("int").alias("stop")
    whole = owned.where("id > owner").select("id", "rk", "start", stop)
    owners = stored(owned.where("id = owner").select("g", "id", "rk", "start", "windows"), "class-owners")
    open_ = join_hot(owners, several, "g", "many", "inner").groupBy("id", "rk").agg(F.collect_set(F.struct("start", "windows")).alias("spans"))

    def windows(batches):
        for b in batches:
            plain, spans = unpacked(b.column(2)), b.column(3).to_pylist()
            for i, j, block in blocks(plain, False):
                at, row = [], []
                for r in range(i, j):
                    own = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["windows"]) for s in spans[r]]))
                    at.append(own + block.first[r - i])
                    row.append(np.full(len(own), r))
                at, row = np.concatenate(at), np.concatenate(row)
                h = block.runs(at, length)
                yield pa.record_batch([pa.array(x) for x in (h.view(np.int64), block.check(at, length).view(np.int64), b.column(0).to_numpy()[row], b.column(1).to_numpy()[row], (at - block.first[row - i]).astype(np.int32))], ["h", "t", "id", "rk", "start"])
        trim()

    texts = open_.join(packed(docs), ["id", "rk"]).select("id", "rk", "packed", "spans")
    each = stored(texts.mapInArrow(windows, "h long, t long, id long, rk long, start int").distinct(), "windows")
    first = stored(each.groupBy("h", "t").agg(F.min("id").alias("owner"), F.max("id").alias("hi"), F.count("*").alias("n")).where("owner < hi").drop("hi"), "window-owners")
    partly = join_hot(each, first, ["h", "t"], "n", "inner").where("id > owner").select("id", "rk", "start", (F.col("start") + length).cast("int").alias("stop"))
    return whole.unionByName(partly)


def packed(docs: DataFrame) -> DataFrame:
    """docs with their texts compressed, for a join that carries them."""

    def run(batches):
        zip_ = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [zip_.compress(t.as_buffer() if hasattr(t, "as_buffer") else t.as_py().encode()) for t in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.binary())], ["id", "rk", "packed"])
        trim()

    return docs.mapInArrow(run, "id long, rk long, packed binary")


def unpacked(column: pa.Array) -> pa.Array:
    back = zstandard.ZstdDecompressor()
    return pa.array([back.decompress(z.as_py()) for z in column], pa.large_binary())


def remove_repeats(df: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Removes from each document the words in a window of `length` words that also starts in a document with a smaller id.

    Words are runs without [\\x20\\x09-\\x0D], unchanged; windows are judged on the input. Columns: id, n_words long,
    n_removed long, kept_sha256 (of the kept words joined by one space), removed array of struct (start, stop): the
    maximal removed ranges in words, and kept_text where asked for.

    Defined cases: null text has no words; null ids are one document, after all others; rows of equal ids are one
    document to others, each with its own row; a document's repeats within itself stay; texts shorter than a window
    stay; other columns are not read; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("rk"), text.alias("text"))
    gone = repeated_runs(df, length, id_col, text_col).groupBy("id", "rk").agg(F.collect_set(F.struct("start", "stop")).alias("gone"))

    def apply(batches):
        for b in batches:
            plain, gone = unpacked(b.column(2)), b.column(3).to_pylist()
            out: list[list] = [[], [], [], [], []]
            for i, j, block in blocks(plain, False):
                for r in range(i, j):
                    lo, hi = block.first[r - i], block.first[r - i + 1]
                    n = int(hi - lo)
                    drop = np.zeros(n + 1, np.int64)
                    for s in gone[r] or ():
                        drop[s["start"]] += 1
                        drop[s["stop"]] -= 1
                    inside = np.cumsum(drop[:n]) > 0
                    words = plain[r].as_py().split()  # bytes: splits at the contract's white space alone
                    kept = b" ".join(words if not inside.any() else [w for w, d in zip(words, inside.tolist()) if not d])
                    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
                    for col, v in zip(out, (n, int(inside.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(x), "stop": int(y)} for x, y in zip(edge[::2], edge[1::2])], kept.decode() if keep_text else None)):
                        col.append(v)
            ranges = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.record_batch(
                [b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), ranges, pa.string())))],
                ["id", "n_words", "n_removed", "kept_sha256", "removed", "kept_text"],
            )
        trim()

    joined = packed(docs).join(gone, ["id", "rk"], "left").select("id", "rk", "packed", "gone")
    out = joined.mapInArrow(apply, "id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,stop:int>>, kept_text string")
    out = out.withColumn("id", F.when(F.col("id") != LAST, F.col("id"))).withColumnRenamed("id", id_col)
    return out if keep_text else out.drop("kept_text")
