"""Tables in the folder that the cluster shares: they end a plan's lineage and outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and all runs on one machine, a folder of our own, set there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='sediment-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, so that its true size is known to what follows."""
    path = f"{shared_dir(df.sparkSession)}/sediment/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


#: At most so many keys are ever broadcast as heavy ones: each holds over 1/HEAVY of the rows that were counted.
HEAVY = 1024


def join_hot(rows: DataFrame, dim: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined (inner) with dim, one row a key with how often it was counted: keys that hold over 1/1024 of all are at
    most 1024 and are broadcast, the others are joined by shuffle. dim should be a stored table, as it is read twice."""
    total = dim.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > F.lit(max(total // HEAVY, 1000))
    heavy, light = F.broadcast(dim.where(hot)), dim.where(~hot)
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(dim.where(hot).select(key)), key, "left_anti").join(light, key))


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
