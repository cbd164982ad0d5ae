"""Versioned rows from a stream of files, kept by the same rules as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.sinks import insert_or_ignore


def ingest(spark: SparkSession, source: str, schema: str, target: str, keys: list[str], order: str, checkpoint: str):
    """Reads what is new in `source` (Parquet files) and appends rows with unseen keys to `target`; returns the query.

    availableNow: it ends when all files present have been taken; run again, it takes only later ones.
    """

    def batch(df: DataFrame, _: int) -> None:
        try:
            known = spark.read.schema(schema).parquet(target)
            known.limit(0).collect()
        except Exception as e:  # the first batch: nothing is stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], schema)
        insert_or_ignore(known, df, keys, order).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
