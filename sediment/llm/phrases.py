"""Phrase collocations: merged count-min sketches, exact counts of what they let through, scores and subsumption."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .coded import STRETCH, Coded, byte_class, raw_bytes, stretches
from .common import join_hot, stored, trim
from .words import U, mixed

#: Bytes that part pieces, bytes that part words, and all others.
BREAKS = byte_class((0x0A, 0x0D)) | byte_class(*((ord(c), ord(c)) for c in ".,;:!?"))
BLANKS = byte_class((0x20, 0x20), (0x09, 0x09))
IN_WORD = ~(BREAKS | BLANKS)

#: Few wide rows: what matters is how much other runs add to a cell, not how seldom that is beyond all bounds.
ROWS = 2
#: Cells in each row of a sketch at most: a byte a cell in a worker, a bit a cell once merged.
MOST_CELLS = 1 << 26
#: Cells that are counted together before they are added to the sketch.
TOGETHER = 1 << 16
#: Cells of a merged sketch's row that one task sums at a time.
CHUNK = 1 << 20
#: Splits of the input that share a sketch at most.
SPLITS = 64
LONGEST = 4


def cells(h: np.ndarray, row: int, mask: int) -> np.ndarray:
    """The cell of each hash in a row of the sketch."""
    return ((h >> U(32) if row else h) & U(mask)).astype(np.int64)


def grams(raw: np.ndarray, lang: str, longest: int, size: int = STRETCH):
    """For each stretch of a language's pieces: its coded words and, for each size n, (hashes, same, fresh) of the runs of n
    words by their first word: same says that a run lies inside one piece; runs before fresh were whole in the stretch before.

    Hashes are of the language and the words, the same in every task.
    """
    seed = U(xxhash.xxh3_64_intdigest(lang.encode(), seed=1))
    for start, stop, seen in stretches(raw, IN_WORD, BREAKS, longest - 1, size):
        part = raw[start:stop]
        coded = Coded(part, IN_WORD)
        if not len(coded):
            continue
        of_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.words), U, len(coded.words))
        one = of_word[coded.codes]
        piece = np.cumsum(BREAKS[part], dtype=np.int32)[coded.starts]
        h, out = mixed(one ^ seed), []
        for n in range(1, longest + 1):
            if n > len(one):
                break
            if n > 1:
                h = mixed(h[:-1] * U(0xD1342543DE82EF95) + one[n - 1 :])
            out.append((h, piece[n - 1 :] == piece[: len(piece) - n + 1], max(0, seen - n + 1)))
        yield coded, out


def by_language(batch: pa.RecordBatch):
    """(language, bytes) of a batch of (lang, text with a closing line break)."""
    langs = batch.column(0)
    for lang in langs.unique().to_pylist():
        rows = batch.column(1).filter(pc.equal(langs, lang)) if len(langs) > 1 else batch.column(1)
        yield lang, raw_bytes(rows)[0]


def sketch(docs: DataFrame, least: int, width: int, longest: int) -> np.ndarray:
    """Count-min sketch of all runs of 1 to `longest` words: bits of cells that reach `least`, packed, a row each.

    Each task counts its part of the input in a sketch of its own, in cells that stop at `least`: a sum of stopped
    counts reaches `least` if and only if the sum of the counts does. Sketches are merged chunk by chunk, and ROWS * width
    / 8 bytes (16 MB at most) come to the driver, whatever the input's size.
    """
    kind, mask, chunk = (np.uint8 if least < 256 else np.uint32), width - 1, min(CHUNK, width)

    def count(batches):
        table = np.zeros((ROWS, width), kind)
        for b in batches:
            for lang, raw in by_language(b):
                for _, found in grams(raw, lang, longest):
                    h = np.concatenate([h[fresh:][same[fresh:]] for h, same, fresh in found])
                    for row in range(ROWS):
                        at = cells(h, row, mask)
                        for i in range(0, len(at), TOGETHER):
                            some, n = np.unique(at[i : i + TOGETHER], return_counts=True)
                            table[row][some] = np.minimum(table[row][some] + n, least)
        zip_ = zstandard.ZstdCompressor(level=1)
        for row in range(ROWS):
            for c in range(0, width, chunk):
                part = table[row, c : c + chunk]
                if part.any():
                    yield pa.record_batch([pa.array([row], pa.int32()), pa.array([c // chunk], pa.int32()), pa.array([zip_.compress(part.tobytes())], pa.binary())], ["row", "chunk", "counts"])
        del table
        trim()

    def merge(batches):
        back, at, sums = zstandard.ZstdDecompressor(), None, None
        out = lambda: pa.record_batch([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["row", "chunk", "bits"])
        for b in batches:
            for row, c, counts in zip(*(b.column(i) for i in range(3))):
                key = (row.as_py(), c.as_py())
                if key != at:
                    if at is not None:
                        yield out()
                    at, sums = key, np.zeros(chunk, np.uint32)
                sums += np.frombuffer(back.decompress(counts.as_py()), kind)
                np.minimum(sums, least, out=sums)
        if at is not None:
            yield out()

    splits = docs.rdd.getNumPartitions()
    tasks = max(1, min(splits, max(docs.sparkSession.sparkContext.defaultParallelism, -(-splits // SPLITS))))
    parts = docs.coalesce(tasks).mapInArrow(count, "row int, chunk int, counts binary")
    merged = parts.repartition("row", "chunk").sortWithinPartitions("row", "chunk").mapInArrow(merge, "row int, chunk int, bits binary")
    bits = np.zeros((ROWS, width // 8), np.uint8)
    for r in merged.collect():
        bits[r["row"], r["chunk"] * chunk // 8 : (r["chunk"] + 1) * chunk // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def phrase_counts(df: DataFrame, least: int = 30, longest: int = LONGEST, text_col: str = "text", lang_col: str = "lang", most_cells: int = MOST_CELLS) -> DataFrame:
    """(lang, phrase, size, f): runs of 1 to `longest` words found at least `least` times in a language, with exact counts,
    and a row (lang, null, 0, n) for each language with all its word occurrences. A stored table.

    The first pass sketches. The second counts, stretch by stretch by exact word codes, the runs whose estimate and
    whose parts' estimates reach `least`, and only these are shuffled. Estimates never fall short, so nothing is lost;
    a sketch too small for its input lets more through, and the result stays the same.
    """
    text = F.concat(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"))
    docs = df.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), text.alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = 1 << 16
    while width < min(size // 16, most_cells):
        width *= 2
    shared = df.sparkSession.sparkContext.broadcast(sketch(docs, least, width, longest))

    def count(batches):
        bits = shared.value
        for b in batches:
            for lang, raw in by_language(b):
                total = 0
                for coded, found in grams(raw, lang, longest):
                    total += len(coded) - found[0][2]
                    phrases, sizes, counts = survivors(coded, found, bits, width - 1)
                    yield pa.record_batch([pa.array([lang] * len(phrases), pa.string()), pa.array(phrases, pa.string()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int64())], ["lang", "phrase", "size", "f"])
                yield pa.record_batch([pa.array([lang], pa.string()), pa.array([None], pa.string()), pa.array([0], pa.int32()), pa.array([total], pa.int64())], ["lang", "phrase", "size", "f"])
        trim()

    found = docs.mapInArrow(count, "lang string, phrase string, size int, f long").groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return stored(found.where((F.col("f") >= least) | F.col("phrase").isNull()), "phrase-counts")


def survivors(coded: Coded, found: list, bits: np.ndarray, mask: int):
    """Phrases, sizes and counts of a stretch's runs that the sketch lets through together with all their parts."""
    words = [w.decode() for w in coded.words]
    codes, phrases, sizes, counts = coded.codes.astype(np.int64), [], [], []
    passed = ids = None
    for n, (h, same, fresh) in enumerate(found, 1):
        at = np.flatnonzero(same if n == 1 else same & passed[:-1] & passed[1:])
        for row in range(ROWS):
            cell = cells(h[at], row, mask)
            at = at[(bits[row][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1]
        key = codes[at] if n == 1 else ids[at] << 32 | codes[at + n - 1]  # the run's first n - 1 words and its last
        _, first, back = np.unique(key, return_index=True, return_inverse=True)
        number = np.bincount(back[at >= fresh], minlength=len(first))  # runs that the stretch before counted only help longer ones
        passed, ids = np.zeros(len(h), bool), np.full(len(h), -1, np.int64)
        passed[at], ids[at] = True, back
        own = np.flatnonzero(number)
        phrases += [" ".join([words[c] for c in coded.codes[i : i + n]]) for i in at[first[own]].tolist()]
        sizes += [n] * len(own)
        counts += number[own].tolist()
    return phrases, sizes, counts


def collocations(df: DataFrame, least: int = 30, longest: int = LONGEST, within: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best collocations of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    Texts have A-Z lower-cased and are split at [.,;:!?\\x0A-\\x0D] into pieces, these at spaces and tabs into words.
    Candidates are phrases of 2 to `longest` words found a >= `least` times; a cut after k words gives l and r, the counts
    of its parts, and floor(2000000 a / (l + r)); the cut that scores lowest counts, of equals that of smallest k. A
    candidate inside a longer candidate with 100 f >= `within` a goes. The first `top` of a language by score, a
    (descending) and phrase stay.

    Defined cases: null text has no words; null lang is `und`, as is the lang of that name; null or equal ids do not
    matter, as rows are not told apart; languages without a candidate give no row; very long texts are coded in parts;
    other columns are not read; an empty table gives an empty result.
    """
    counts = phrase_counts(df, least, longest, text_col, lang_col)
    words = F.split("phrase", " ")
    candidates = counts.where("size >= 2").select("lang", "phrase", "size", F.col("f").alias("a"))
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("*", k).select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ").alias("right"))
    parts = counts.where(f"size between 1 and {longest - 1}")
    for side, count in (("left", "l"), ("right", "r")):
        dim = parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count))
        cuts = join_hot(cuts, dim, ["lang", side], count, "inner")
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    least_cut = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase", "a").agg(least_cut).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    return ranked(scored, subsumed(candidates, longest), counts.where("phrase is null").select("lang", F.col("f").alias("n")), within, top)


def subsumed(candidates: DataFrame, longest: int) -> DataFrame:
    """(lang, phrase, f): the largest count of a longer candidate that has the phrase inside."""
    words = F.split("phrase", " ")
    spans = F.expr(f"filter(flatten(transform(sequence(2, {longest - 1}), n -> transform(sequence(1, {longest} - n + 1), i -> struct(i as i, n as n)))), s -> s.n < size and s.i + s.n - 1 <= size)")
    inside = candidates.where("size > 2").select("lang", "a", words.alias("words"), F.explode(spans).alias("span"))
    inside = inside.select("lang", "a", F.array_join(F.slice("words", F.col("span.i"), F.col("span.n")), " ").alias("phrase"))
    return inside.groupBy("lang", "phrase").agg(F.max("a").alias("f"))


def ranked(scored: DataFrame, longer: DataFrame, totals: DataFrame, within: int, top: int) -> DataFrame:
    big = lambda c: F.col(c).cast("decimal(20,0)")
    gone: Column = F.col("f").isNotNull() & (big("f") * 100 >= big("a") * within)
    kept = scored.join(longer, ["lang", "phrase"], "left").where(~gone)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
