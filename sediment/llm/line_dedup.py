"""Line deduplication against levelled sorted runs of line hashes, in DataFrame operations only."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WS_CHARS, discard, fresh, shared_dir, stored

#: Stands for a null id: such rows count as one document, after all others.
LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z lower-cased (other letters as they are)."""
    bare = F.btrim(line, F.lit(WS_CHARS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


class Runs:
    """Sorted runs of line hashes in levels: `fanout` runs of a level are compacted into one of the next.

    A run is a table bucketed and sorted by hash in the shared folder, so a batch merges with it bucket by bucket
    without shuffling it again. No hash is in two runs.
    """

    def __init__(self, spark, fanout: int):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, keys: DataFrame) -> DataFrame:
        name = f"sediment_run_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/sediment/{name}"
        keys.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", path).saveAsTable(name)
        table = self.spark.table(name)
        table._stored_at, table._name = path, name
        return table

    def drop(self, runs: list[DataFrame]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE {run._name}")
            discard(run)

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        for run in self.all():
            keys = keys.join(run.select("h"), "h", "left_anti")
        return keys

    def add(self, keys: DataFrame) -> DataFrame:
        own = self.write(keys)
        self.levels[0].append(own)
        return own

    def compact(self) -> None:
        for i, level in enumerate(self.levels):
            if len(level) < self.fanout:
                break
            if i + 1 == len(self.levels):
                self.levels.append([])
            merged = level[0]
            for run in level[1:]:
                merged = merged.unionByName(run)
            self.levels[i + 1].append(self.write(merged.repartition(self.buckets, "h")))
            self.levels[i] = []
            self.drop(level)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int | None = None, fanout: int = 3) -> DataFrame:
    """Drops from every document the lines whose key stands in a document with a smaller id.

    Lines are split at \\n; a line's key is line_key; keys under `min_chars` code points are never dropped. Documents
    come in `batches` batches by id (quantiles; None: one for each 2^31 rows, 4 to 64): a batch's keys merge-anti-join the runs, those unseen are added as a
    new run with the smallest id that holds them, and every line whose (key, id) is not in its batch's new run is
    dropped. Keys are 128-bit hashes. A line that a third of all documents hold is shuffled as partial minima and as
    (key, id) pairs, which spread. Texts are shuffled once, to meet their dropped positions.

    Returns df's columns with n_lines long (before), n_dropped long and kept_text string.

    Defined cases: null or empty text is one empty line and gives an empty kept text, as does a text that loses all its
    lines; rows with the same id are one document, as are all rows with a null id, which come last; repeated rows lose
    the same lines; an empty table gives an empty result; columns named as the results are replaced.
    """
    spark = df.sparkSession
    df = df.drop("n_lines", "n_dropped", "kept_text")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    batches = batches or min(64, max(4, df.count() >> 31))
    cuts = df.agg(F.percentile_approx(F.col(id_col).cast("long"), [i / batches for i in range(1, batches)], 10000)).first()[0] or []
    cuts = sorted(set(cuts))
    batch = sum([F.when(rid > c, 1).otherwise(0) for c in cuts], F.lit(0))
    keys = F.transform(F.split(text, "\n", -1), line_key)
    found = df.select(rid.alias("id"), F.xxhash64(text).alias("rk"), batch.alias("batch"), F.posexplode(keys).alias("pos", "key"))
    lines = stored(found.where(F.char_length("key") >= min_chars).select("batch", "id", "rk", "pos", F.unhex(F.md5("key")).alias("h")), "lines")
    runs, dropped = Runs(spark, fanout), []
    try:
        for b in range(len(cuts) + 1):
            part = lines.where(F.col("batch") == b)
            first = part.groupBy("h").agg(F.min("id").alias("id"))
            new = runs.add(runs.unseen(first))
            dropped.append(stored(part.join(new, ["h", "id"], "left_anti").select("id", "rk", "pos"), "dropped-lines"))
            runs.compact()
    finally:
        runs.drop(runs.all())
    gone = dropped[0]
    for d in dropped[1:]:
        gone = gone.unionByName(d)
    i, k, id_, rk, out = fresh(df.columns, "i", "k", "id", "rk", "gone")
    gone = gone.groupBy("id", "rk").agg(F.collect_set("pos").alias(out)).withColumnsRenamed({"id": id_, "rk": rk})
    discard(lines)
    parts = F.split(text, "\n", -1)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(out)), lambda j: F.get(parts, j))
    return (
        df.withColumns({i: rid, k: F.xxhash64(text)})
        .join(gone, (F.col(i) == F.col(id_)) & (F.col(k) == F.col(rk)), "left")
        .withColumns({
            "n_lines": F.size(parts).cast("long"),
            "n_dropped": F.coalesce(F.size(out), F.lit(0)).cast("long"),
            "kept_text": F.when(F.col(out).isNull(), text).otherwise(F.array_join(left, "\n")),
        })
        .drop(i, k, id_, rk, out)
    )
