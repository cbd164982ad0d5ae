"""A Merkle manifest of a table: roots and authentication paths by scheduled traversal of aligned blocks."""

from __future__ import annotations

import string
from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Nodes of a run, and levels of a block (so 8^4 = 4096 leaves a block).
FAN, LEVELS = 8, 4


def folded(digests: list[bytes]) -> bytes:
    """The parent of a run: sha256 of its digests as lower-case hex, one after another."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


class Treehash:
    """Builds nodes from leaves as they come, with an unfinished run a level as its whole memory.

    keep(level, node) is told each node when it is complete. Of a tree with `levels` levels above the leaves, a last run
    that has fewer nodes, even one, is closed by finish().
    """

    def __init__(self, levels: int, keep):
        self.levels, self.keep, self.runs = levels, keep, [[] for _ in range(levels)]

    def push(self, node: bytes, level: int = 0) -> None:
        self.keep(level, node)
        if level < self.levels:
            self.runs[level].append(node)
            if len(self.runs[level]) == FAN:
                self.close(level)

    def close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.push(folded(run), level + 1)

    def finish(self) -> None:
        for level in range(self.levels):
            if self.runs[level]:
                self.close(level)


def traverse(leaves: list[bytes], levels: int) -> Iterator[list[tuple[list[bytes], int]]]:
    """For leaf after leaf of a block its path: at each level the run that holds its node, and the node's place in it.

    One run a level is held, and one more is built: while the leaves under a run of level k are passed, a treehash over
    the leaves that come next builds the run that follows, one leaf a step, and hands it over when it is needed. So a
    step costs a push a level, and memory is two runs a level beside the leaves themselves.
    """
    first: list[list[bytes]] = [[] for _ in range(levels)]

    def keep(level: int, node: bytes) -> None:
        if level < levels and len(first[level]) < FAN:
            first[level].append(node)

    start = Treehash(levels, keep)
    for leaf in leaves:
        start.push(leaf)
    start.finish()
    runs, spans = first, [FAN ** (k + 1) for k in range(levels)]
    following: list[list[bytes]] = [[] for _ in range(levels)]

    def builder(k: int) -> Treehash:
        return Treehash(k, lambda level, node: following[k].append(node) if level == k else None)

    builders = [builder(k) for k in range(levels)]
    n = len(leaves)
    for i in range(n):
        yield [(runs[k], i // FAN**k % FAN) for k in range(levels)]
        for k in range(levels):
            ahead = i + spans[k]
            if ahead < n:
                builders[k].push(leaves[ahead])
                if ahead == n - 1:
                    builders[k].finish()
            if (i + 1) % spans[k] == 0:
                runs[k], following[k] = following[k], []
                builders[k] = builder(k)


def height(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def field(c: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(df: DataFrame, columns: tuple[str, ...], id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(id, lang, leaf, seen): each row's digest, and the digest of the row as it is found later, if that differs."""
    text = F.col(text_col)
    lower = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    digest = lambda over: F.unhex(F.sha2(F.concat(*[field(over.get(c, F.col(c))) for c in columns]), 256))
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), digest({}).alias("leaf"), F.when(hit, digest({text_col: lower})).alias("seen"))


def placed(nodes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """nodes with their position in their group (from 0) and the group's size n. A stored table.

    Rows are range-sorted by group and order; each partition's rows of a group begin where those of the partitions before
    end, which a table of one row a partition and group tells.
    """
    keys = [*group, *order, "_row"]
    sorted_ = nodes.withColumn("_row", F.monotonically_increasing_id())
    sorted_ = stored(sorted_, "merkle-rows").repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    rows = stored(sorted_.withColumn("_part", F.spark_partition_id()), "merkle-sorted")
    starts = rows.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part")
    starts = starts.withColumn("_before", F.sum("_n").over(before) - F.col("_n")).withColumn("n", F.sum("_n").over(Window.partitionBy(*group)))
    starts = stored(starts.select("_part", *group, "_first", "_before", "n"), "merkle-starts")
    same = [rows[g].eqNullSafe(starts[g]) for g in group]
    joined = rows.join(starts, [rows["_part"] == starts["_part"], *same])
    return joined.select(*[rows[c] for c in nodes.columns], (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "n")


#: The nodes beside a node, level by level upwards: those left and those right of it, as digests in a row.
PATH = "array<struct<left:binary,right:binary>>"


def levels_in(n: int, levels: int) -> int:
    """Levels that a block of a tree of n nodes is folded by: all, or up to the root of a tree that is one block."""
    return height(n) if n <= FAN**levels else levels


def in_blocks(nodes: DataFrame, levels: int, upper: DataFrame | None = None, *more: str) -> DataFrame:
    """Nodes (tree, block, pos, node, n, path, *more) with a block's rows in one partition, in order; the block's own path
    comes as one row before them (pos -1) where upper has it."""
    block = F.floor(F.col("pos") / F.lit(FAN**levels)).cast("long").alias("block")
    rows = nodes.select("tree", block, "pos", "node", "n", F.lit(None).cast(PATH).alias("path"), *more)
    if upper is not None:
        rows = rows.unionByName(upper.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "path"), allowMissingColumns=True)
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def blocks(batches) -> Iterator[tuple[int, int, Iterator[tuple]]]:
    """(tree, block, rows (pos, node, n, path, *more)) of block after block; a block may span batches."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for (tree, block), some in groupby(rows, itemgetter(0, 1)):
        yield tree, block, (row[2:] for row in some)


def roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The blocks of nodes (tree, pos, node, n) as nodes of the tier above: pos is the block's number, n its tree's blocks."""

    def run(batches):
        for tree, block, rows in blocks(batches):
            found, build = [], None
            for _, node, n, _ in rows:
                if build is None:
                    top = levels_in(n, levels)
                    build = Treehash(top, lambda level, x, top=top, found=found: found.append(x) if level == top else None)
                build.push(node)
            build.finish()
            yield pa.record_batch([pa.array([tree], pa.int64()), pa.array([block], pa.int64()), pa.array(found, pa.binary()), pa.array([-(-n // FAN**levels)], pa.int64())], ["tree", "pos", "node", "n"])

    return in_blocks(nodes, levels).mapInArrow(run, "tree long, pos long, node binary, n long")


def tiers(nodes: DataFrame, levels: int, most: int, name: str) -> list[DataFrame]:
    """nodes, their blocks as nodes, the blocks of these, and so on up to one node a tree."""
    out = [nodes]
    while most > 1:
        most = -(-most // FAN**levels)
        out.append(stored(roots(out[-1], levels), f"merkle-{name}"))
    return out


def walked(batches, levels: int) -> Iterator[tuple[int, list, list[tuple], Iterator]]:
    """(tree, path above, rows (pos, node, n, *more), paths within) of block after block."""
    for tree, _, rows in blocks(batches):
        above, found = [], []
        for pos, node, n, path, *more in rows:
            if pos < 0:
                above = path
            else:
                found.append((pos, node, n, *more))
        yield tree, above, found, traverse([x[1] for x in found], levels_in(found[0][2], levels))


def paths(nodes: DataFrame, levels: int, upper: DataFrame | None) -> DataFrame:
    """(tree, pos, path) of nodes (tree, pos, node, n); upper has the paths of their blocks."""
    kind = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))

    def run(batches):
        for tree, above, found, within in walked(batches, levels):
            out = [[{"left": b"".join(run[:i]), "right": b"".join(run[i + 1 :])} for run, i in path] + above for path in within]
            yield pa.record_batch([pa.array([tree] * len(out), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array(out, kind)], ["tree", "pos", "path"])

    return in_blocks(nodes, levels, upper).mapInArrow(run, f"tree long, pos long, path {PATH}")


def climbed(node: bytes, path: list[tuple[str, str]]) -> bytes:
    """The root that a node and its path (left and right digests as hex) come to."""
    for left, right in path:
        node = sha256(f"{left}{node.hex()}{right}".encode()).digest()
    return node


def proven(nodes: DataFrame, levels: int, upper: DataFrame, root: bytes) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of leaves (tree, pos, node, n, id, seen)."""

    def run(batches):
        for _, above, found, within in walked(batches, levels):
            above = [(x["left"].hex(), x["right"].hex()) for x in above]
            rest, subroot, out = "".join(a + b for a, b in above), None, []
            for (_, node, n, id_, seen), runs in zip(found, within):
                path = [("".join([x.hex() for x in run[:i]]), "".join([x.hex() for x in run[i + 1 :]])) for run, i in runs]
                if subroot is None:
                    subroot = climbed(node, (path + above)[: height(n)]).hex()
                proof = sha256(("".join([a + b for a, b in path]) + rest).encode()).hexdigest()
                top = climbed(node if seen is None else seen, path + above)
                out.append((id_, node.hex(), subroot, root.hex(), proof, top.hex(), top == root))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 5, pa.bool_()))], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return in_blocks(nodes, levels, upper, "id", "seen").mapInArrow(run, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(df: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row: a tree a lang over its leaves in
    order of id, and a tree over the langs' roots.

    Leaves are sorted by ranges and dealt into aligned blocks of 8^`levels`. The first pass folds each block to its root
    by treehash; roots are folded again as leaves of a smaller tree, tier by tier, until each lang has one. The second
    pass walks down: a block's own path comes as one row before its leaves, a scheduled traversal advances the paths
    within the block leaf by leaf, and each row is proven on the spot, so of paths only one a block is shuffled.

    Rows whose id has a crc32 divisible by 3 are proven as found later, with the text's A-Z lower-cased.

    Defined cases: a null field is `-`; null langs are one tree, before all others; null ids come after all others and
    are not tampered with; of equal ids the smaller leaf comes first, so repeated rows, whose leaves are equal, have any
    order among them; long texts are digested by the engine; other columns are not read and their names do not clash; an
    empty table gives an empty result.
    """
    rows = stored(leaves(df, columns, id_col, text_col, lang_col), "merkle-leaves")
    langs = placed(rows.select("lang").distinct().withColumn("all", F.lit(0).cast("long")), ["all"], ["lang"])
    langs = stored(langs.select("lang", F.col("pos").alias("tree")), "merkle-langs")
    n = langs.count()
    keyed = rows.join(langs, rows["lang"].eqNullSafe(langs["lang"])).select("tree", F.col("id").isNull().alias("none"), "id", "leaf", "seen")
    nodes = placed(keyed, ["tree"], ["none", "id", "leaf"]).select("tree", "pos", F.col("leaf").alias("node"), "n", "id", "seen")
    nodes = stored(nodes, "merkle-nodes")
    low = tiers(nodes, levels, nodes.agg(F.max("n")).first()[0] or 0, "lang")
    tops = low[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "node", F.lit(n).cast("long").alias("n"))
    high = tiers(stored(tops, "merkle-subroots"), levels, n, "root")
    root = high[-1].first()
    above = None
    for tier in reversed(high):
        above = stored(paths(tier, levels, above), "merkle-paths")
    above = above.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "path")
    for tier in reversed(low[1:-1]):
        above = stored(paths(tier, levels, above), "merkle-paths")
    return proven(low[0], levels, above, root["node"] if root else b"").withColumnRenamed("id", id_col)
