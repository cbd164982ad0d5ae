"""Row numbers over a whole table's order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its rows' numbers from 1 in the given order, which should be total.

    Rows are range-partitioned by the order once; each range numbers its own rows and adds the rows before it, of which
    the driver sees one count a range. No task holds more than its range.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before, starts = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):
        starts.append((r["_range"], before))
        before += r["count"]
    table = F.broadcast(df.sparkSession.createDataFrame(starts, "_range int, _start long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_own", own).join(table, "_range").withColumn(name, F.col("_own") + F.col("_start")).select(*df.columns, name)
