"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored

#: Most sources whose table is broadcast.
FEW_SOURCES = 50_000
#: Documents of a source that share a bucket of the running sums, about.
A_BUCKET = 20_000


def source_targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """sizes (source, source_size) with rank, weight and target.

    Sources by code point, null last, get the weights in turn. Targets share `share` times all sizes by weight; a target
    stops at `most` times its source's size, and the excess goes to the others by weight until none is above: each
    round is one aggregate over the table of sources, with one row to the driver.
    """
    ranged = stored(sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("_p", F.spark_partition_id()), "mix-sources")
    run, starts = 0, {}
    for p, n in sorted((r["_p"], r["count"]) for r in ranged.groupBy("_p").count().collect()):
        starts[p], run = run, run + n
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.col("_p")) if starts else F.lit(0)
    rank = F.row_number().over(Window.partitionBy("_p").orderBy(F.col("source").isNull(), "source")) + start - 1
    table = ranged.withColumn("rank", rank.cast("int")).withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), F.col("rank") % len(weights) + 1))
    table = stored(table.select("source", "source_size", "rank", "weight"), "mix-weights")
    total = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    cap, rate = F.col("source_size") * F.lit(float(most)), 0.0
    capped: Column = F.lit(False)
    while True:
        row = table.agg(F.sum(F.when(capped, cap).otherwise(0.0)).alias("full"), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("weight")).first()
        if not row["weight"]:
            break
        new = (total - row["full"]) / row["weight"]
        if new <= rate:
            break
        rate, capped = new, F.col("weight") * F.lit(new) >= cap
    return table.withColumn("target", F.least(cap, F.col("weight") * F.lit(rate)))


def default_schedule(rank: Column) -> Column:
    """Knots (t, rate) of a source's weight over the run: by rank the sources in turn fall from 1.5 to 0.5 of their mean
    weight, stay, and rise from 0.5 to 1.5."""
    knots = lambda a, b: F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(r)).alias("rate")) for t, r in ((0, a), (1, b))])
    return F.when(rank % 3 == 0, knots(1.5, 0.5)).when(rank % 3 == 1, knots(1, 1)).otherwise(knots(0.5, 1.5))


def integrated(knots: Column) -> Column:
    """Segments (t, rate, slope, done) of a piecewise linear schedule; done: the share of its integral before t."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(knots) - 1), lambda i: F.struct(
        F.element_at(knots, i)["t"].alias("t"), F.element_at(knots, i)["rate"].alias("rate"),
        ((F.element_at(knots, i + 1)["rate"] - F.element_at(knots, i)["rate"]) / (F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"])).alias("slope"),
        ((F.element_at(knots, i + 1)["t"] - F.element_at(knots, i)["t"]) * (F.element_at(knots, i + 1)["rate"] + F.element_at(knots, i)["rate"]) / 2).alias("area"),
    ))
    area = lambda upto: F.aggregate(upto, F.lit(0.0), lambda a, s: a + s["area"])
    whole = area(pairs)
    return F.transform(pairs, lambda s, i: F.struct(s["t"].alias("t"), (s["rate"] / whole).alias("rate"), (s["slope"] / whole).alias("slope"), (area(F.slice(pairs, F.lit(1), i)) / whole).alias("done")))


def inverted(segments: Column, share: Column) -> Column:
    """The time at which the integrated schedule reaches the share: the root of a quadratic in the segment it falls in."""
    s = F.element_at(F.filter(segments, lambda x: (x["done"] <= share) | (x["t"] == 0)), -1)
    left = F.greatest(share - s["done"], F.lit(0.0))
    root = s["rate"] + F.sqrt(F.greatest(s["rate"] * s["rate"] + s["slope"] * left * 2, F.lit(0.0)))
    return s["t"] + F.when(root > 0, left * 2 / root).otherwise(0.0)


def mix(df: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, schedule=default_schedule, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """How much of each document a curriculum takes, and when.

    A source's documents stand in a fixed random order (md5 of id and text). The source's demand over the run is its
    target times the integral of its schedule; a document begins at the time at which that demand reaches the words
    before it, found by inverting the integral. Past its last document a source begins again (whole `most` times at
    most). The document at which a target is reached is taken in part, so each source's taken words are its target's
    whole words exactly. Rows come range-sorted by their first position.

    Columns: those of `carry` (all by default), size, source_size, target double, taken long, takes array of struct
    (epoch int, position double in [0, 1), words long).

    Running sums are built in two steps, buckets of a source and rows of a bucket, so a source that holds a third of
    all rows is spread over tasks. Defined cases: null text has no words; null source is a source, the last one; null
    ids are ordered by text; rows equal in id and text are kept, each with its own place; an empty table gives an
    empty result; columns named as the results are replaced.
    """
    carry = [c for c in (carry or df.columns) if c not in ("size", "source_size", "target", "taken", "takes")]
    text = F.coalesce(F.col(text_col), F.lit(""))
    order = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), F.md5(text)))
    own = [f"c{i}" for i in range(len(carry))]  # no column of the caller's meets the names used here
    slim = df.select(*[F.col(f"`{c}`").alias(o) for c, o in zip(carry, own)], F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.col(source_col).alias("_source"), order.alias("_o"), F.monotonically_increasing_id().alias("_row"))
    docs = stored(slim, "mix-docs")
    out = mixed(docs, source_targets(docs.groupBy(F.col("_source").alias("source")).agg(F.sum("size").alias("source_size")), list(weights), share, most), schedule, most, own)
    return out.select(*[F.col(o).alias(c) for c, o in zip(carry, own)], "size", "source_size", "target", "taken", "takes")


def mixed(docs: DataFrame, targets: DataFrame, schedule, most: float, carry: list[str]) -> DataFrame:
    targets = stored(targets.select(F.col("source").alias("_s"), "source_size", "target", integrated(schedule(F.col("rank"))).alias("_segments")), "mix-targets")
    digits, rows, n_sources = 0, docs.count(), targets.count()
    while rows > A_BUCKET * 16**digits and digits < 6:
        digits += 1
    docs = docs.withColumn("_b", F.substring("_o", 1, digits))
    sums = docs.groupBy("_source", "_b").agg(F.sum("size").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_source").orderBy("_b")) - F.col("_sum")
    if n_sources <= FEW_SOURCES:
        targets = F.broadcast(targets)
    sums = sums.withColumn("_before", before).join(targets, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s", "_sum")
    sums = sums.withColumnsRenamed({"_source": "_s", "_b": "_sb"})
    ordered = Window.partitionBy("_source", "_b").orderBy("_o", "_row")
    run = docs.withColumn("_run", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    at = run.join(sums, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb"))).withColumn("_at", F.col("_run") + F.col("_before"))
    goal = F.floor("target").cast("long")
    take = lambda e: F.struct(
        F.lit(e + 1).alias("epoch"),
        inverted(F.col("_segments"), F.try_divide((F.col("_at") + F.col("source_size") * e).cast("double"), F.col("target"))).alias("position"),
        F.least(F.greatest(goal - F.col("_at") - F.col("source_size") * e, F.lit(0)), F.col("size")).cast("long").alias("words"),
    )
    takes = F.filter(F.array(*[take(e) for e in range(int(-(-most // 1)))]), lambda x: x["words"] > 0)
    out = at.withColumn("takes", takes).withColumn("taken", F.aggregate("takes", F.lit(0).cast("long"), lambda a, x: a + x["words"]))
    first = F.coalesce(F.get("takes", F.lit(0))["position"], F.lit(2.0))
    return out.withColumn("_first", first).repartitionByRange("_first", "_o").sortWithinPartitions("_first", "_o").select(*carry, "size", "source_size", "target", "taken", "takes")
