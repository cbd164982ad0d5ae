"""Folds over a group's rows in order, as a stream."""

from __future__ import annotations

from hashlib import sha256
from itertools import count, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters of values that are joined before the serial digest of a group meets them (a longer value is a block by itself).
BLOCK = 8 << 10


def ordered_digest(df: DataFrame, keys: list[str], order: list[Column], value: Column, start: str = "", sep: str = "", name: str = "hash") -> DataFrame:
    """(keys, hash, n): sha256 of `start` and the group's values in order, with `sep` between them; n counts its rows.

    A digest of rows in order is serial by nature, so a group is one stream in the end. What that stream meets is not
    rows but blocks of joined values: rows are sorted by ranges of (keys, order), side by side also within a large group,
    and each range joins its own. What is held of a group is a block and the state of its hash. Null values are passed
    over; null keys are one group; an empty table gives no row.
    """
    by = [f"_o{i}" for i in range(len(order))]
    rows = df.select(*keys, *[c.alias(n) for c, n in zip(order, by)], value.cast("string").alias("_v"))
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartitionByRange(parts, *keys, *by).sortWithinPartitions(*keys, *by).select(*keys, F.spark_partition_id().alias("_p"), "_v")
    of = rows.select(*keys).schema.fields
    long = lambda n: T.StructField(n, T.LongType())

    def runs(batches):
        """(schema, key, the rows of a run of one key in a batch) of each."""
        for b in batches:
            for key, run in groupby(zip(*[c.to_pylist() for c in b.columns]), key=lambda r: r[: len(keys)]):
                yield b.schema, key, list(run)

    def batch(rows: list[tuple], schema: pa.Schema, fields: list[pa.Field]) -> pa.RecordBatch:
        fields = [*(schema.field(i) for i in range(len(keys))), *fields]
        return pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))

    def join(batches):
        fields = [pa.field(n, t) for n, t in (("_p", pa.int64()), ("_b", pa.int64()), ("_v", pa.string()), ("_n", pa.int64()))]
        done, places = [], count()
        for schema, key, run in runs(batches):
            values, size, n = [], 0, 0
            for r in run:
                n += 1
                if r[-1] is not None:
                    values.append(r[-1])
                    size += len(r[-1]) + len(sep)
                if size >= BLOCK:
                    done.append((*key, r[-2], next(places), sep.join(values), n))
                    values, size, n = [], 0, 0
            if n:
                done.append((*key, run[-1][-2], next(places), sep.join(values) if values else None, n))
            if len(done) >= BLOCK:
                yield batch(done, schema, fields)
                done = []
        if done:
            yield batch(done, schema, fields)

    def digest(batches):
        fields = [pa.field(name, pa.string()), pa.field("n", pa.int64())]
        at, state, some, n, done, schema = None, None, False, 0, [], None
        for schema, key, run in runs(batches):
            if key != at:
                if at is not None:
                    done.append((*at, state.hexdigest(), n))
                at, state, some, n = key, sha256(start.encode()), False, 0
            n += sum(r[-1] for r in run)
            for r in run:
                if r[-2] is not None:
                    state.update(((sep if some else "") + r[-2]).encode())
                    some = True
            if len(done) >= BLOCK:
                yield batch(done, schema, fields)
                done = []
        if at is not None:
            yield batch([*done, (*at, state.hexdigest(), n)], schema, fields)

    blocks = rows.mapInArrow(join, T.StructType([*of, long("_p"), long("_b"), T.StructField("_v", T.StringType()), long("_n")]))
    dealt = blocks.repartition(*keys).sortWithinPartitions(*keys, "_p", "_b").select(*keys, "_v", "_n")
    return dealt.mapInArrow(digest, T.StructType([*of, T.StructField(name, T.StringType()), long("n")]))
