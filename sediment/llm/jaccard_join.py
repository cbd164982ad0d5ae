"""N-gram Jaccard join of documents: a size-aware heavy-light set similarity join."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_hot, stored, trim
from .substring_dedup import LAST, packed, unpacked
from .words import U, blocks, mixed

#: Sets larger than this are never enumerated; a boundary below it is chosen by cost.
MOST_ENUMERATED = 28
#: The share of documents, and about how many at least, whose shingles are counted for the order of elements; from how many
#: of them a shingle counts as common; and how many common ones are put last, at most (8 bytes each are broadcast). They
#: change the work, never the result.
SHARE, SAMPLE, OFTEN, COMMON = 1 / 8, 16384, 3, 2_000_000


class Threshold:
    """den * |A and B| >= num * |A or B|, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.link = (den - num) / (den + num)  # linked sets of n and m elements differ in at most link * (n + m)

    def overlap(self, n: int, m: int) -> int:
        """Least intersection of linked sets of n and m elements."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def least(self, n: int) -> int:
        """Least size of a set linked with one of n."""
        return -(-self.num * n // self.den)

    @lru_cache(maxsize=None)  # noqa: B019
    def prefixes(self, n: int) -> tuple[int, int]:
        """How many first elements a set of n shares one of with any linked set that is no larger, or no smaller."""
        return n - self.overlap(n, self.least(n)) + 1, n - self.overlap(n, n) + 1

    def deleted(self, n: int) -> list[int]:
        """How many elements to delete from a set of n to reach an overlap with a linked set of MOST_ENUMERATED or less."""
        sizes = {self.overlap(n, m) for m in range(self.least(n), MOST_ENUMERATED + 1) if self.least(m) <= n}
        return sorted({n - o for o in sizes if o <= n})


def shingles(block, row: int, k: int) -> np.ndarray:
    """Distinct hashes of a document's runs of k words; of the whole sequence where it is shorter; none without words."""
    lo, hi = int(block.first[row]), int(block.first[row + 1])
    if hi == lo:
        return np.zeros(0, U)
    if hi - lo < k:
        return block.runs(np.array([lo]), hi - lo)
    return np.unique(block.runs(np.arange(lo, hi - k + 1), k))


def block_sets(block, rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): shingles() of all of a block's documents, in a row, and where each document's start and the last ends."""
    words = np.diff(block.first)
    many = np.where(words < k, np.minimum(words, 1), words - k + 1)
    at = np.r_[0, np.cumsum(many)]
    start = np.arange(at[-1]) + np.repeat(block.first[:-1] - at[:-1], many)
    h = block.runs(start, np.repeat(np.minimum(words, k), many)) if len(start) else np.zeros(0, U)
    for i in range(rows):
        h[at[i] : at[i + 1]].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[at[:-1][many > 0]] = True
    return h[new], np.r_[0, np.cumsum(new)][at]


def identities(h: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums a set that stand for it; sums, so a subset's follows from the deleted elements."""
    out = []
    for x in (0x243F6A8885A308D3, 0x13198A2E03707344):
        total = np.r_[U(0), np.cumsum(mixed(h ^ U(x)), dtype=U)]
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out


def all_parities(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits, ends): the sets' parity bits, as longs: each element turns one bit, so two sets' bits differ in no more places
    than the sets in elements. A power of two of them a set, at least 64 and one an element."""
    n = np.diff(ends)
    size = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    at = np.r_[0, np.cumsum(size)]
    place = (mixed(h ^ U(0xA4093822299F31D0)) & np.repeat(size - 1, n).astype(U)).astype(np.int64) + np.repeat(at[:-1], n)
    bits = np.bincount(place, minlength=at[-1]) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64), at // 64


def parities(h: np.ndarray) -> np.ndarray:
    """The parity bits of one set."""
    return all_parities(h, np.array([0, len(h)]))[0]


def signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def _docs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("id"), F.xxhash64(text).alias("rk"), text.alias("text"))


#: Rows of fixed width that a task holds before it deals them by hash.
HELD = 1 << 19


def dealt(df: DataFrame, cut: Callable, kind: np.dtype, keep: Callable, schema: str) -> DataFrame:
    """Rows that cut makes of df's batches (arrays of kind, with a hash h), dealt by h: keep gets all of a bucket's rows,
    sorted by h, and gives a batch of the schema.

    A bucket's rows travel as bytes, many in one row: the engine sorts a few thousand rows where it would sort each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(10, (16 * parts - 1).bit_length())

    def deal(batches):
        def flush():
            rows = np.concatenate(held)
            bucket = (rows["h"].view(U) >> U(64 - bits)).astype(np.int64)
            rows = rows[np.argsort(bucket, kind="stable")]
            many = np.bincount(bucket, minlength=1 << bits)
            ends = np.r_[0, np.cumsum(many)][np.r_[True, many > 0]] * kind.itemsize
            data = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(rows)])
            return pa.record_batch([pa.array(np.flatnonzero(many).astype(np.int32)), data.cast(pa.binary())], ["bucket", "rows"])

        held, n = [], 0
        for rows in cut(batches):
            held.append(rows)
            n += len(rows)
            if n >= HELD:
                yield flush()
                held, n = [], 0
        if n:
            yield flush()
        trim()

    def gather(batches):
        last, held = None, []

        def whole():
            rows = np.frombuffer(b"".join(held), kind)
            return keep(rows[np.argsort(rows["h"])])

        for b in batches:
            for bucket, data in zip(b.column(0).to_pylist(), b.column(1)):
                if held and bucket != last:
                    yield whole()
                    held = []
                last = bucket
                held.append(data.as_py())
        if held:
            yield whole()
        trim()

    blobs = df.mapInArrow(deal, "bucket int, rows binary")
    return blobs.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(gather, schema)


def common_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """Shingles that several of a sample of the documents have. They only come last in the order of elements, which saves
    work; the join is exact under any order."""
    rate = max(SHARE, SAMPLE / max(docs.count(), 1))
    sample = docs.where(F.pmod(F.xxhash64("id", "rk"), F.lit(1 << 30)) < F.lit(int(min(1.0, rate) * (1 << 30))))

    kind = np.dtype([("h", np.int64)])

    def run(batches):
        for b in batches:
            for i, j, block in blocks(b.column(0), True):
                yield block_sets(block, j - i, k)[0].view(kind)

    def often(rows):
        at = np.r_[np.flatnonzero(np.r_[True, rows["h"][1:] != rows["h"][:-1]]), len(rows)]
        many = np.diff(at)
        kept = many >= OFTEN
        return pa.record_batch([pa.array(rows["h"][at[:-1][kept]]), pa.array(many[kept])], ["h", "count"])

    counts = dealt(sample.select("text"), run, kind, often, "h long, count long")
    found = counts.orderBy(F.desc("count"), "h").limit(COMMON).select("h").toArrow()
    return np.sort(found.column("h").to_numpy().view(U))


def document_sets(docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """Per document: id, rk, n (size of its set), s1, s2 (the set's identity), elems: its first elements in the common
    order (all of small sets, else twice its prefix and one more), lights: how many of these are not put last for being
    common, reach: its prefix and one more, and bits: the set's parities."""
    told = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, k))

    def run(batches):
        common = told.value
        for b in batches:
            cols = [[] for _ in range(9)]
            for i, j, block in blocks(b.column(2), True):
                h, ends = block_sets(block, j - i, k)
                n = np.diff(ends)
                often = np.zeros(len(h), bool)
                if len(common) and len(h):
                    often = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                seen = np.r_[0, np.cumsum(often)]
                light = n - (seen[ends[1:]] - seen[ends[:-1]])
                first = np.repeat(ends[:-1], n)
                heavy = seen[:-1] - np.repeat(seen[ends[:-1]], n)  # common ones before it in its set
                place = np.where(often, np.repeat(light, n) + heavy, np.arange(len(h)) - first - heavy)
                most = np.array([t.prefixes(x)[0] + 1 if x else 0 for x in n.tolist()], np.int64)
                take = np.where(n <= MOST_ENUMERATED, n, np.minimum(n, 2 * most))
                ordered = np.empty(len(h), U)
                ordered[first + place] = h
                elems = ordered[np.arange(len(h)) - first < np.repeat(take, n)]
                bits, at = all_parities(h, ends)
                for col, x in zip(cols, (n, *identities(h, ends), np.minimum(light, take), most, elems.view(np.int64), take, bits, np.diff(at))):
                    col.append(x)
            n, s1, s2, lights, reach, elems, take, bits, longs = (np.concatenate([*c, np.zeros(0, np.int64)]) for c in cols)
            arrays = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(flat)) for flat, size in ((elems, take), (bits, longs))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n.astype(np.int32)), pa.array(s1), pa.array(s2), pa.array(lights.astype(np.int32)), pa.array(reach.astype(np.int32)), *arrays], ["id", "rk", "n", "s1", "s2", "lights", "reach", "elems", "bits"])
        trim()

    return stored(docs.mapInArrow(run, "id long, rk long, n int, s1 long, s2 long, lights int, reach int, elems array<long>, bits array<long>"), "document-sets")


def chosen_boundary(sets: DataFrame, t: Threshold) -> int:
    """Sets up to this size are joined by enumerated subsets, larger ones by inverted lists.

    Cost of enumerating sets of n: their subsets. Cost of scanning: their prefix elements, each with the mean length of
    such lists. The boundary with the smallest sum wins; the driver sees one row a size up to MOST_ENUMERATED.
    """
    few = sets.where(F.col("n").between(1, MOST_ENUMERATED))
    counts = {r["n"]: r["count"] for r in few.groupBy("n").count().collect()}
    lists = few.select("n", F.explode("elems").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    means = {r["n"]: r["c"] for r in lists.groupBy("n").agg((F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("c")).collect()}
    ways = lambda n: sum(_choose(n, d) for d in t.deleted(n))
    scan = {n: c * t.prefixes(n)[0] * (1 + means.get(n, 1.0)) for n, c in counts.items()}
    exact = max(n for n in range(1, MOST_ENUMERATED + 1) if t.deleted(n) == [0] or n == 1)  # such sets link only with equal ones
    cost = lambda b: sum(c * ways(n) for n, c in counts.items() if n <= b) + sum(s for n, s in scan.items() if n > b)
    return min(range(exact, MOST_ENUMERATED + 1), key=lambda b: (cost(b), b))


def _choose(n: int, d: int) -> int:
    out = 1
    for i in range(d):
        out = out * (n - i) // (i + 1)
    return out


def small_links(sets: DataFrame, t: Threshold, boundary: int) -> DataFrame:
    """(a, b): sets of up to `boundary` elements that share a subset as large as their sizes need. Each set lists its
    subsets of those fixed sizes by their identity; equal subsets are starred around the set with the smallest number."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for sid, elems in zip(b.column(0).to_pylist(), b.column(1)):
                h = np.array(elems.as_py(), np.int64).view(U)
                n = len(h)
                parts = [[int(v) for v in mixed(h ^ U(x))] for x in (0x243F6A8885A308D3, 0x13198A2E03707344)]
                whole = [sum(p) for p in parts]
                for d in t.deleted(n):
                    for out in combinations(range(n), d):
                        rows.append((n - d, signed(whole[0] - sum(parts[0][i] for i in out)), signed(whole[1] - sum(parts[1][i] for i in out)), sid, n))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.record_batch([pa.array(c, p) for c, p in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["c", "k1", "k2", "sid", "n"])

    subsets = sets.where(F.col("n").between(1, boundary)).select("sid", "elems").mapInArrow(run, "c int, k1 long, k2 long, sid long, n int")
    subsets = stored(subsets, "small-subsets")
    key = ["c", "k1", "k2"]
    # Sets over one subset of c elements: the smallest of them links with every other one that its size allows; those
    # that it doesn't allow are larger, so pairs of them meet over a larger subset.
    least = subsets.groupBy(*key).agg(F.min(F.struct("n", "sid")).alias("m"), F.count("*").alias("many")).where("many > 1").select(*key, F.col("m.n").alias("m"), F.col("m.sid").alias("a"), "many")
    joined = join_hot(subsets, stored(least, "small-stars"), key, "many", "inner")
    enough = F.col("c") * (t.num + t.den) >= t.num * (F.col("n") + F.col("m"))
    return joined.where((F.col("sid") != F.col("a")) & enough).select("a", F.col("sid").alias("b")).distinct()


#: A posting as it travels.
POSTING = np.dtype([("h", np.int64), ("sid", np.int64), ("n", np.int32), ("pos", np.int32), ("index", np.bool_)])


def repeated_postings(sets: DataFrame, t: Threshold, boundary: int) -> DataFrame:
    """(h, sid, n, pos, index): prefix elements that at least two sets have, one of them as an index entry.

    Rare elements' postings are dealt by element, many in one row; those of one set alone go there. Common elements, whose
    lists may be long, all stay and are not dealt by element.
    """
    names, lengths = list(POSTING.names), [(0, 0)]

    def cut(batches):
        for b in batches:
            sid, n, lights = (b.column(i).to_numpy() for i in range(3))
            elems = b.column(3)
            ends = elems.offsets.to_numpy()
            flat = elems.values.to_numpy()
            pre = np.array([t.prefixes(x) for x in n.tolist()] or lengths)[: len(n)]
            take = np.minimum(np.where(n > boundary, pre[:, 0], pre[:, 1]), lights)
            row = np.repeat(np.arange(len(n)), take)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
            out = np.empty(len(row), POSTING)
            for name, x in zip(names, (flat[ends[:-1][row] + pos], sid[row], n[row], pos, pos < pre[row, 1])):
                out[name] = x
            yield out

    def repeated(rows):
        same = rows["h"][1:] == rows["h"][:-1]
        rows = rows[np.r_[False, same] | np.r_[same, False]]
        return pa.record_batch([pa.array(np.ascontiguousarray(rows[c])) for c in names], names)

    used = sets.where(F.col("n") >= t.least(boundary + 1))
    rare = dealt(used.select("sid", "n", "lights", "elems"), cut, POSTING, repeated, "h long, sid long, n int, pos int, index boolean")
    # `reach` is the prefix and one more; the index's prefix as in Threshold.prefixes.
    index = F.col("n") + 1 - F.expr(f"(n * {2 * t.num}L + {t.num + t.den - 1}) div {t.num + t.den}")
    take = F.when(F.col("n") > boundary, F.col("reach") - 1).otherwise(index)
    after = F.slice("elems", F.col("lights") + 1, F.greatest(take - F.col("lights"), F.lit(0)).cast("int"))
    common = used.where(take > F.col("lights")).select("sid", "n", "lights", index.alias("upto"), F.posexplode(after).alias("i", "h"))
    pos = F.col("i") + F.col("lights")
    return stored(rare.unionByName(common.select("h", "sid", "n", pos.alias("pos"), (pos < F.col("upto")).alias("index"))), "postings")


#: Most rows of (set, document), or pairs of sets, that are broadcast to pick texts or sets; more are joined by shuffle.
FEW_SETS = 500_000


def plausible(pairs: DataFrame, sets: DataFrame, most: Callable[[int, int], float]) -> DataFrame:
    """The distinct pairs whose sets a and b, of n and m elements, may differ in most(n, m) elements or fewer, as far as
    their first elements tell.

    Up to the smaller of two sets' last known elements both are known in full. If more elements differ there, the pair
    goes. Only these short arrays travel.
    """
    side = lambda s: sets.select(F.col("sid").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("n", "lights", "elems")])

    def run(batches):
        for b in batches:
            cols = b.to_pydict()
            arrays = []
            for c in ("elems_a", "elems_b"):
                col = b.column(b.schema.get_field_index(c))
                ends, flat = col.offsets.to_numpy(), col.values.to_numpy().view(U)
                arrays.append([flat[x:y] for x, y in zip(ends[:-1], ends[1:])])
            keep = []
            for x, y, n, m, p, q in zip(*arrays, cols["n_a"], cols["n_b"], cols["lights_a"], cols["lights_b"]):
                last = min((len(x) > p, int(x[-1])), (len(y) > q, int(y[-1])))
                upto = lambda e, k: int(np.searchsorted(e[:k], U(last[1]), "right")) if not last[0] else k + int(np.searchsorted(e[k:], U(last[1]), "right"))  # noqa: B023, E731
                i, j = upto(x, p), upto(y, q)
                same = len(set(x[:i].tolist()).intersection(y[:j].tolist()))
                keep.append(i + j - 2 * same <= most(n, m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs.distinct(), "pairs")
    if pairs.count() <= FEW_SETS:  # sets stay where they are
        both = F.broadcast(pairs).join(side("a"), "a").join(F.broadcast(pairs).join(side("b"), "b"), ["a", "b"])
    else:
        both = pairs.join(side("a"), "a").join(side("b"), "b")
    out = stored(both.select("a", "b", *[f"{c}_{s}" for c in ("n", "lights", "elems") for s in "ab"]).mapInArrow(run, "a long, b long"), "plausible-pairs")
    discard(pairs)
    return out


def whole_sets(used: DataFrame, sets: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(sid, set): the whole sets of the sids in used, made again from one text of each.

    The table that picks those texts is broadcast where it has FEW_SETS rows or fewer, and joined by shuffle where it has
    more.
    """
    where = stored(sets.select("sid", "id", "rk").join(used, "sid"), "used-sets")
    few = where.count() <= FEW_SETS

    def run(batches):
        for b in batches:
            texts = b.column(1) if few else unpacked(b.column(1))
            found = [shingles(block, r - i, k).view(np.int64) for i, j, block in blocks(texts, True) for r in range(i, j)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate([*found, np.zeros(0, np.int64)])
            yield pa.record_batch([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["sid", "set"])
        trim()

    texts = docs.join(F.broadcast(where), ["id", "rk"]).select("sid", "text") if few else packed(docs).join(where, ["id", "rk"]).select("sid", "packed")
    out = stored(texts.mapInArrow(run, "sid long, set array<long>").dropDuplicates(["sid"]), "whole-sets")
    discard(where)
    return out


def both_sets(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """pairs (a, b) with their whole sets _a and _b."""
    left, right = whole.withColumnsRenamed({"sid": "a", "set": "_a"}), whole.withColumnsRenamed({"sid": "b", "set": "_b"})
    return pairs.join(left, "a").join(right, "b")


def measured(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """The linked ones of the pairs (a, b), counted on the whole sets of those that parities and first elements don't rule
    out. Parities are a few longs a set: most pairs go before the sets' elements travel."""
    side = lambda s: sets.select("sid", "n", "bits").alias(s)
    told = pairs.distinct().join(side("x"), F.col("a") == F.col("x.sid")).join(side("y"), F.col("b") == F.col("y.sid"))
    pairs = plausible(told.where(alike_parities(t)).select("a", "b"), sets, lambda n, m: n + m - 2 * t.overlap(n, m))
    used = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    whole = whole_sets(used, sets, docs, k)
    inter = F.size(F.array_intersect("_a", "_b"))
    linked = inter * t.den >= (F.size("_a") + F.size("_b") - inter) * t.num
    out = stored(both_sets(pairs, whole).where(linked).select("a", "b"), "measured-links")
    discard(whole, pairs)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component of edges (a, b), by alternating large and small stars.

    A large star ties a node's larger neighbours to the least node around it, a small star its smaller ones. Both keep
    what is connected, never add edges and are minima and joins over slim rows. Rounds go on until each node has one edge,
    to a node without a smaller neighbour; on a chain their number grows with the logarithm of its length. A table in the
    shared folder ends each star's lineage.
    """
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = edges.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("label")).distinct()
    links = stored(links, "edges")
    while True:
        both = links.unionByName(links.select(F.col("label").alias("node"), F.col("node").alias("label")))
        up, down = F.count(F.when(F.col("label") < F.col("node"), 1)), F.count(F.when(F.col("label") > F.col("node"), 1))
        if both.groupBy("node").agg(up.alias("up"), down.alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty():
            break
        least = both.groupBy("node").agg(F.min("label").alias("l")).select("node", F.least("node", "l").alias("l"))
        large = both.where("label > node").join(least, "node").select(F.col("label").alias("node"), F.col("l").alias("label"))
        large = stored(large.distinct(), "large-stars")
        least = large.groupBy("node").agg(F.min("label").alias("l"))
        small = large.join(least, "node").where("label != l").select(F.col("label").alias("node"), F.col("l").alias("label"))
        small = stored(small.unionByName(least.withColumnRenamed("l", "label")).distinct(), "small-stars")
        discard(links, large)
        links = small
    out = stored(nodes.join(links, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    discard(links)
    return out


def close_enough(t: Threshold) -> Column:
    """Whether postings x and y of one list can belong to linked sets: sizes, index entry, and elements left after them."""
    n, m = F.greatest("x.n", "y.n"), F.least("x.n", "y.n")
    need = F.ceil((F.lit(t.num) * (n + m)) / F.lit(t.num + t.den))
    rest = F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    smaller = F.when(F.col("x.n") < F.col("y.n"), F.col("x.index")).when(F.col("y.n") < F.col("x.n"), F.col("y.index")).otherwise(F.col("x.index") & F.col("y.index"))
    return (F.lit(t.den) * m >= F.lit(t.num) * n) & (rest >= need - F.least("x.pos", "y.pos")) & smaller


#: Lists of at most so many sets are joined in pairs, longer ones around leaders: lists over elements of sets, and those
#: over elements of differences, whose pairs are few.
SHORT, SHORT_OF_DIFFERENCES = 64, 128
#: Rounds around leaders end, and all lists left are joined in pairs, once that compares no more pairs than so many times
#: the sets that stood in lists at first; or after so many rounds.
FEW_PAIRS, LEADERS = 16, 8


#: Stands for the leader in lists over elements of whole sets; others are numbers of sets, from 0.
ELEMENTS = -1


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, label) after further links (a, b): only the labels that links join are walked again."""
    label = lambda c: parts.select(F.col("node").alias(c), F.col("label").alias(f"{c}_"))
    both = links.join(label("a"), "a", "left").join(label("b"), "b", "left")
    both = both.select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
    new = components(both)
    named = parts.unionByName(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(parts, "node", "left_anti").select("node", F.col("node").alias("label")))
    return stored(named.join(new.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def apart(lists: DataFrame, parts: DataFrame) -> DataFrame:
    """lists (k1, k2, sid, n, w, ...) whose sets are in several components, with part, many (sets) and leader of each list.

    Of lists over differences from one leader (k1 is no ELEMENTS) that hold the same sets in the same way, one stays: sets
    that differ from it in the same elements would meet again in each. So does one of the lists over elements that hold
    the same sets, as those over a shared passage do: the first in the order of elements, where pos is least for each of
    its sets. What two sets share first stands in such a list, and who has one of the others in its index has this one.
    """
    key = ["k1", "k2"]
    told = lists.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("part", F.coalesce("label", "sid")).drop("label")
    told = stored(told, "told-lists")
    ranks = [F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("many"), F.max_by("sid", F.struct("w", "n", "sid")).alias("leader")]
    mark = lambda *cols: [F.bit_xor(F.xxhash64(F.lit(i), *cols)).alias(f"x{i}") for i in (1, 2)]
    of_elements = told.where(F.col("k1") == ELEMENTS).groupBy(*key).agg(*ranks, *mark("sid"), F.min("pos").cast("long").alias("at")).where("lo < hi")
    others = told.where(F.col("k1") != ELEMENTS).groupBy(*key).agg(*ranks, *mark("sid", "d", "s", "small"), F.min("k2").alias("at")).where("lo < hi")
    alike = of_elements.unionByName(others).groupBy("k1", "many", "x1", "x2").agg(F.min_by(F.struct("k2", "leader"), F.struct("at", "k2")).alias("one"))
    sums = stored(alike.select("k1", "one.k2", "many", "one.leader"), "apart-lists")
    out = stored(join_hot(told, sums, key, "many", "inner"), "apart-members")
    discard(told, sums)
    return out


def alike_parities(t: Threshold) -> Column:
    """Whether sets x and y of n elements can be linked by their parities. Twice as many of one set are folded first; where
    there are more still, they tell nothing."""
    x, y = F.col("x.bits"), F.col("y.bits")
    few, many = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    xor = lambda a, b: a.bitwiseXOR(b)
    halves = F.zip_with(F.slice(many, 1, F.size(few)), F.slice(many, F.size(few) + 1, F.size(few)), xor)
    folded = F.when(F.size(many) == F.size(few), many).when(F.size(many) == F.size(few) * 2, halves)
    apart = F.aggregate(F.zip_with(few, folded, xor), F.lit(0), lambda total, v: total + F.bit_count(v))
    return F.coalesce(apart * (t.den + t.num) <= (F.col("x.n") + F.col("y.n")) * (t.den - t.num), F.lit(True))


def short_pairs(members: DataFrame, sets: DataFrame, t: Threshold, close: Column) -> DataFrame:
    """(a, b): the pairs of sets in different components that share a list and may be linked.

    Many sets that share a passage meet in pairs, with the square of their number, and few of them are near: parities tell
    nearly all others before a pair becomes a row.
    """
    rows = stored(members.join(sets.select("sid", "bits"), "sid"), "members-with-bits")
    x, y = rows.alias("x"), rows.alias("y")
    joined = x.join(y, [F.col("x.k1") == F.col("y.k1"), F.col("x.k2") == F.col("y.k2"), F.col("x.sid") < F.col("y.sid"), F.col("x.part") != F.col("y.part"), close, alike_parities(t)])
    out = stored(joined.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct(), "short-pairs")
    discard(rows)
    return out


def pairs_once(members: DataFrame, alike: Column) -> DataFrame:
    """(a, b): the pairs of sets in different components that share a list of differences from one leader; once each, in
    the first list that can tell them: one in which the set nearer to the leader is `small`."""
    lists = members.groupBy("k1", "sid").agg(F.collect_list("k2").alias("all"), F.collect_list(F.when(F.col("small"), F.col("k2"))).alias("smalls"))
    rows = stored(members.join(lists, ["k1", "sid"]).select("k1", "k2", "sid", "n", "d", "s", "part", "all", "smalls"), "members-once")
    x, y = rows.alias("x"), rows.alias("y")
    nearer = F.col("x.d") <= F.col("y.d")
    shared = F.array_intersect(F.when(nearer, F.col("x.smalls")).otherwise(F.col("y.smalls")), F.when(nearer, F.col("y.all")).otherwise(F.col("x.all")))
    same = (F.col("x.k1") == F.col("y.k1")) & (F.col("x.k2") == F.col("y.k2")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.part") != F.col("y.part"))
    joined = x.join(y, same & alike & (F.array_min(shared) == F.col("x.k2")))
    out = stored(joined.select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct(), "short-pairs")
    discard(rows)
    return out


def near_pairs(members: DataFrame, sets: DataFrame, t: Threshold) -> DataFrame:
    """(a, b, w): leaders and sets of their lists that may be near, as far as first elements tell."""
    pairs = members.where("sid != leader").select(F.col("leader").alias("a"), F.col("sid").alias("b"), "w").distinct()
    near = plausible(pairs.select("a", "b"), sets, lambda m, n: (2 * (n * t.den / t.num + m) + n * t.den / t.num + n) * t.link + 1e-6)
    out = stored(near.join(pairs, ["a", "b"]), "near-pairs")
    discard(near)
    return out


def differences(pairs: DataFrame, whole: DataFrame, t: Threshold, all_: bool = False) -> DataFrame:
    """(leader, sid, n, w, m, size, apart) of the pairs (a, b, w): how many elements a set b (of n) and its leader a (of m)
    don't share, and which, where the set is near enough for its links to be found there (or for all pairs): what is
    linked with a set of n that differs from the leader in 2 * link * (n + m) elements or fewer."""
    sized = both_sets(pairs, whole).withColumns({"m": F.size("_a"), "n": F.size("_b")})
    sized = sized.withColumn("size", F.col("m") + F.col("n") - 2 * F.size(F.array_intersect("_a", "_b")))
    link, back, n, m = t.link, t.den / t.num, F.col("n"), F.col("m")
    near = F.lit(all_) | (F.col("size") <= (2 * (n * back + m) + n * back + n) * link + 1e-6)
    only = F.when(near, F.concat(F.array_except("_a", "_b"), F.array_except("_b", "_a")))
    return stored(sized.select(F.col("a").alias("leader"), F.col("b").alias("sid"), "n", "w", "m", "size", only.alias("apart")), "differences")


def centred(found: DataFrame, long: DataFrame, whole: DataFrame, t: Threshold) -> DataFrame:
    """found, with each leader's near sets told against the most central of them.

    Elements that over half of a leader's near sets differ from it in are the leader's own peculiarities. The set nearest
    to the leader without these becomes the leader of all near sets, the old leader included: differences from a central
    set are small and seldom shared, so few sets meet again.
    """
    near = found.where("apart is not null")
    rows = stored(near.select("leader", F.explode("apart").alias("e"), "sid"), "peculiar-elements")
    cohort = near.groupBy("leader").agg(F.count("*").alias("all"))
    common = rows.groupBy("leader", "e").agg(F.count("*").alias("many")).join(cohort.where(F.col("all") > SHORT), "leader")
    common = stored(common.where("many * 2 > all").drop("all"), "peculiarities")
    hits = join_hot(rows, common, ["leader", "e"], "many", "inner").groupBy("leader", "sid").agg(F.count("*").alias("hits"))
    near = near.join(hits, ["leader", "sid"], "left").withColumn("d", F.col("size") - 2 * F.coalesce("hits", F.lit(0)))
    best = near.groupBy("leader").agg(F.min(F.struct("d", "sid")).alias("best")).where("best.d < 0").select("leader", F.col("best.sid").alias("centre"))
    best = stored(best, "centres")
    moved = found.where("apart is not null").join(best, "leader").where("sid != centre").select(F.col("centre").alias("a"), F.col("sid").alias("b"), "w")
    olds = best.join(long.where("sid = leader").select("leader", "w").distinct(), "leader").select(F.col("centre").alias("a"), F.col("leader").alias("b"), "w")
    again = differences(moved.unionByName(olds).distinct(), whole, t, True)
    stay = found.where("apart is not null").join(best.select("leader"), "leader", "left_anti")
    out = stored(stay.unionByName(again), "centred-differences")
    discard(rows, common, best, again)
    return out


def lists_of_differences(found: DataFrame, t: Threshold) -> DataFrame:
    """(k1, k2, sid, n, w, d, s, small): lists over the elements k2 that sets and a leader k1 don't share.

    If x and y differ from the leader in dx and dy elements, c of them common, they differ in dx + dy - 2 c from each
    other, so linked ones share at least (dx + dy - link * (n + m)) / 2. As in prefixes of sets, only a set's seldomest
    elements need lists then: fewer of them as the smaller of a pair (`small`) than as the larger. Elements in no other
    difference are not common either: c is at most sx and at most sy, the numbers of those that others have, and a set
    stays in a list where such sums, put together in steps of dy, don't rule out every y.
    """
    k = t.link
    rows = stored(found.select(F.col("leader").alias("k1"), F.explode("apart").alias("k2"), "sid", "n", "w", F.col("size").alias("d")), "difference-elements")
    many = stored(rows.groupBy("k1", "k2").agg(F.count("*").alias("many")).where("many > 1"), "difference-lists")
    shared = join_hot(rows, many, ["k1", "k2"], "many", "inner").groupBy("k1", "sid", "n", "w", "d").agg(F.sort_array(F.collect_list(F.struct("many", "k2"))).alias("e"))
    reach = F.col("n") * (k * (1 + t.den / t.num))  # at least link * (n + m) for any m
    prefix = lambda part: F.col("d") - F.greatest(F.lit(1), F.ceil(F.col("d") - reach * part - 1e-6)) + 1
    told = shared.select("k1", "sid", "n", "w", "d", F.size("e").alias("s"), F.posexplode("e").alias("i", "at"))
    place = F.col("i") + F.col("d") - F.col("s")  # after the elements that no other set has
    told = told.where(place < prefix(1.0)).select("k1", "at.k2", "sid", "n", "w", "d", "s", (place < prefix(0.5)).alias("small"))
    told = stored(told.withColumns({"need": F.col("d") - F.col("n") * k, "can": F.col("s") * 2 - F.col("d") + F.col("n") * k}), "difference-bounds")
    step = F.least(F.floor(F.col("need") * 8 / (F.col("n") * k)), F.lit(64)).alias("step")  # at most 73 a list
    steps = told.groupBy("k1", "k2", step).agg(F.struct(F.min("need").alias("need"), F.max("can").alias("can")).alias("at"), F.count("*").alias("many"))
    best = stored(steps.groupBy("k1", "k2").agg(F.collect_list("at").alias("steps"), F.sum("many").alias("many")).where("many > 1"), "difference-best")
    able = F.exists("steps", lambda y: (F.col("need") <= y["can"] + 1e-6) & (F.col("need") + y["need"] <= F.col("s") * 2 + 1e-6))
    out = join_hot(told, best, ["k1", "k2"], "many", "inner").where(able)
    out = stored(out.select("k1", "k2", "sid", "n", "w", "d", "s", "small"), "lists")
    discard(rows, many, told, best)
    return out


def around_leaders(members: DataFrame, sets: DataFrame, docs: DataFrame, parts: DataFrame, k: int, t: Threshold) -> tuple[DataFrame, list[DataFrame]]:
    """Components after all links found around the leaders of long lists, and tables of the pairs (a, b) still to measure.

    Each set of a list is measured against the list's leader. Sets x and y that differ from it in dx and dy elements and
    are linked are either both linked with the leader (where dx + dy is at most what linked sets differ in), or share an
    element of their differences: so near ones meet again in lists over these elements, which are short (copies of one
    text differ from it in few places, each in its own). Far ones, whose partners are far too by the triangle inequality,
    stay in their list, less its leader. Lists of one component are dropped, short ones become pairs, as do all that are
    left once that is little work. What is still long in the end, lists of sets that are far from each other, is parted by
    a second element.
    """
    pairs, n, m = [], F.col("n"), F.col("m")
    budget = members.count() * FEW_PAIRS
    fit = F.lit(t.den) * F.least("x.n", "y.n") >= F.lit(t.num) * F.greatest("x.n", "y.n")
    alike = fit & (F.col("x.d") + F.col("y.d") - 2 * F.least("x.s", "y.s") <= (F.col("x.n") + F.col("y.n")) * t.link + 1e-6)
    of_elements = F.col("k1") == ELEMENTS
    is_long = F.col("many") > F.when(of_elements, SHORT).otherwise(SHORT_OF_DIFFERENCES)
    work = lambda rows: rows.agg(F.sum((F.col("many") - 1) / 2)).first()[0] or 0
    pairs.append(short_pairs(members.where(~is_long), sets, t, close_enough(t)))
    for depth in range(LEADERS + 1):
        long = members.where(is_long)
        if long.isEmpty():
            break
        if depth and work(long) <= budget or depth == LEADERS:
            pairs.append(pairs_once(long.where(~of_elements), alike))
            rest = long.where(of_elements)
            pairs.append(short_pairs(rest, sets, t, close_enough(t)) if work(rest) <= budget else by_two_elements(rest, sets, t, fit))
            break
        close = near_pairs(long, sets, t)
        used = close.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        whole = whole_sets(used, sets, docs, k)
        found = differences(close, whole, t)
        told = centred(found, long, whole, t)
        linked = F.col("size") * (t.den + t.num) <= (n + m) * (t.den - t.num)
        links = stored(found.unionByName(told).where(linked).select(F.col("leader").alias("a"), F.col("sid").alias("b")).distinct(), "leader-links")
        parts = merged(parts, links)
        lists = lists_of_differences(told, t)
        near = found.where(F.col("size") <= 2 * t.link * (n + m)).select("leader", "sid")
        left = stored(long.where("sid != leader").join(near, ["leader", "sid"], "left_anti"), "far-members")
        new = apart(left.drop("leader", "many", "part").unionByName(lists, allowMissingColumns=True), parts)
        discard(close, whole, found, told, links, lists, left, members)
        members = new
        short = members.where(~is_long)
        pairs.append(pairs_once(short.where(~of_elements), alike))
        pairs.append(short_pairs(short.where(of_elements), sets, t, close_enough(t)))
    discard(members)
    return parts, pairs


def by_two_elements(members: DataFrame, sets: DataFrame, t: Threshold, fit: Column) -> DataFrame:
    """(a, b): pairs that share a list's element and another one after it. Linked sets that share an element first share a
    second one too, in prefixes longer by one."""
    own = members.join(sets.select("sid", "elems", "reach"), "sid")
    after = F.explode(F.slice("elems", F.col("pos") + 2, F.col("reach"))).alias("k2")
    rows = stored(own.select(F.col("k2").alias("k1"), after, "sid", "n", "part"), "second-elements")
    many = rows.groupBy("k1", "k2").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("k1", "k2")
    return short_pairs(stored(rows.join(many, ["k1", "k2"]), "lists-of-two"), sets, t, fit)


def linked_sets(sets: DataFrame, docs: DataFrame, k: int, t: Threshold) -> DataFrame:
    """(node, label) over distinct sets: the components of the links.

    Small sets meet over enumerated subsets. Pairs with a larger set meet in inverted lists over prefixes of the sets in
    one order of elements. In each list a leader, the set with most of its prefix in lists, is measured against the
    others first: a group of near copies is joined by one pair for each. Lists in which sets are still apart follow:
    short ones in pairs, long ones around leaders. So every link between two texts is either measured or its ends are
    already connected by links.
    """
    boundary = chosen_boundary(sets, t)
    few = small_links(sets, t, boundary)
    posts = repeated_postings(sets, t, boundary)
    share = posts.groupBy("sid").agg((F.count("*") / F.first("n")).alias("w"))
    posts = stored(posts.join(share, "sid"), "ranked-postings")
    size = posts.groupBy("h").agg(F.count("*").alias("many"), F.max_by(F.struct("sid", "n"), F.struct("w", "n", "sid")).alias("l"))
    lists = stored(size.where("many > 1").select("h", "many", F.col("l.sid").alias("leader"), F.col("l.n").alias("ln")), "lists")
    star = join_hot(posts, lists, "h", "many", "inner").where("sid != leader").where(F.lit(t.den) * F.least("n", "ln") >= F.lit(t.num) * F.greatest("n", "ln"))
    first = measured(star.select(F.col("leader").alias("a"), F.col("sid").alias("b")), sets, docs, k, t)
    parts = components(stored(first.unionByName(few), "links"))
    own = {"k1": F.lit(ELEMENTS), "d": F.lit(0), "s": F.lit(0), "small": F.lit(True)}
    members = apart(posts.withColumnRenamed("h", "k2").withColumns(own), parts)
    parts, found = around_leaders(members, sets, docs, parts, k, t)
    pairs = found[0]
    for p in found[1:]:
        pairs = pairs.unionByName(p)
    label = lambda c: parts.select(F.col("node").alias(c), F.col("label").alias(f"{c}_"))
    still = pairs.distinct().join(label("a"), "a", "left").join(label("b"), "b", "left")
    still = still.where(F.coalesce("a_", "a") != F.coalesce("b_", "b")).select("a", "b")
    late = measured(still, sets, docs, k, t)
    return parts if late.isEmpty() else merged(parts, late)


def similar_groups(df: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents linked by den * |A and B| >= num * |A or B| over their sets of distinct k-word shingles.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Per document: id, n_shingles long, component_id (smallest id
    reachable by links, its own included). Documents with equal sets are one before the join, so exact copies cost one
    row each; membership is joined back with hot sets broadcast (at most 1024 of them).

    Defined cases: with fewer than k words the whole sequence is the one shingle; no words or null text: an empty set,
    linked with nothing; null ids come after all others, and a component of such rows alone has a null id; repeated rows
    are kept; other columns are not read; an empty table gives an empty result.
    """
    t = Threshold(num, den)
    docs = _docs(df, id_col, text_col)
    own = document_sets(docs, k, t)
    key = ["n", "s1", "s2"]
    rest = ["lights", "reach", "elems", "bits"]
    some = own.where("n > 0")
    repeated = stored(some.groupBy(*key).count().where("count > 1").select(*key), "repeated-sets")
    if repeated.count() <= FEW_SETS:  # other sets stay where they are
        several, once = some.join(F.broadcast(repeated), key, "left_semi"), some.join(F.broadcast(repeated), key, "left_anti")
    else:
        several, once = some, some.limit(0)
    classes = several.groupBy(*key).agg(F.min(F.struct("id", "rk")).alias("m"), *[F.first(c).alias(c) for c in rest], F.count("*").alias("copies"))
    classes = classes.select(*key, "m.id", "m.rk", *rest, "copies").unionByName(once.select(*key, "id", "rk", *rest, F.lit(1).cast("long").alias("copies")))
    sets = stored(classes.select(F.monotonically_increasing_id().alias("sid"), *key, "id", "rk", *rest, "copies"), "sets")
    discard(repeated)
    parts = linked_sets(sets, docs, k, t)
    labelled = stored(sets.select("sid", *key, "id", "copies").join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid")), "labelled-sets")
    least = labelled.groupBy("label").agg(F.min("id").alias("component"))
    named = stored(labelled.join(least, "label").select(*key, "component", "copies"), "named-sets")
    slim = own.select("id", *key)
    told = join_hot(slim.where("n > 0"), named, key, "copies", "inner").select("id", "n", "component")
    out = told.unionByName(slim.where("n = 0").select("id", "n", F.col("id").alias("component")))
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(known("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), known("component").alias("component_id"))
