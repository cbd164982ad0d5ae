"""Requests as a stream: which downloads changed what a URL last gave."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TOLD = "url string, request_id long, content_hash string, content_changed boolean"
LAST = "request_id long, content_hash string"


def content_changes(requests: DataFrame) -> DataFrame:
    """A stream of requests (request_id, url, status, content_hash) to its successes with content_changed: the hash differs
    from the URL's success before, null for its first.

    State is one hash and id a URL. Requests of a micro-batch are taken in order of their ids; one that is not later than
    the last taken was told before, or came too late to be compared, and is passed over, so files read twice add nothing.
    """
    good = requests.where(F.col("status").between(200, 299) & F.col("content_hash").isNotNull() & F.col("url").isNotNull() & F.col("request_id").isNotNull())

    def told(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, last = state.get if state.exists else (None, None)
        rows = pd.concat(parts).sort_values("request_id").drop_duplicates("request_id")
        out = []
        for request_id, found in zip(rows["request_id"].tolist(), rows["content_hash"].tolist()):
            if at is None or request_id > at:
                out.append((key[0], request_id, found, None if last is None else found != last))
                at, last = request_id, found
        state.update((at, last))
        yield pd.DataFrame(out, columns=["url", "request_id", "content_hash", "content_changed"]).astype({"content_changed": "object"})

    return good.select("url", F.col("request_id").cast("long").alias("request_id"), "content_hash").groupBy("url").applyInPandasWithState(told, TOLD, LAST, "append", GroupStateTimeout.NoTimeout)


def follow(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str):
    """Tells the changes of new request files (Parquet) in `source` to Parquet under `target`; returns the query.

    availableNow: it ends when all files present are taken; run again, it goes on from its checkpoint, so the same files
    add nothing and a URL's state is still known.
    """
    changes = content_changes(spark.readStream.schema(schema).parquet(source))
    return changes.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
