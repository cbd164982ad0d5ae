"""Connected components and leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_digest
from .running import Running, ranged, running
from .tables import discard, stored


def components(nodes: DataFrame, keys: list[str], node: str = "event_id") -> DataFrame:
    """(node, component): nodes that share a non-null value of any key are connected; a component is its smallest node.

    A value ties its nodes to the least of them, its hub, so a value that many nodes share costs one partial minimum a task
    and pairs are never listed. Nodes then only link hubs, and stars of hubs are contracted, larger neighbours to a node's least one and smaller ones to the
    least of those in turn, until every node hangs on the least of its component: the rounds grow with the logarithm of
    the longest chain. Null nodes have no component and are left out.
    """
    names = nodes.where(F.col(node).isNotNull()).select(F.col(node).alias("n"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    hubs = [f"h{i}" for i in range(len(keys))]
    for i, hub in enumerate(hubs):
        own = names.where(F.col(f"k{i}").isNotNull()).groupBy(f"k{i}").agg(F.min("n").alias(hub))
        names = names.join(own, f"k{i}", "left").drop(f"k{i}")
    # One pass over the nodes: from here on the hubs of values alone are contracted, and each node keeps one of its own.
    rows = stored(names.withColumn("low", F.least("n", "n", *hubs)), "hubs")
    ids = stored(rows.groupBy("n").agg(F.min("low").alias("own"), F.max("low").alias("other")), "nodes")
    tied = rows.join(ids.where("own != other").select("n", "own"), "n").select(F.col("low").alias("n"), F.col("own").alias("hub"))
    for hub in hubs:
        tied = tied.unionByName(rows.select(F.col(hub).alias("n"), F.col("low").alias("hub")))
    links = stored(tied.where("n != hub").distinct(), "ties")
    discard(rows)
    while True:
        around = links.unionByName(links.select(F.col("hub").alias("n"), F.col("n").alias("hub")))
        below, above = F.count(F.when(F.col("hub") < F.col("n"), 1)), F.count(F.when(F.col("hub") > F.col("n"), 1))
        if around.groupBy("n").agg(below.alias("below"), above.alias("above")).where("below > 1 or (below > 0 and above > 0)").isEmpty():
            break
        least = around.groupBy("n").agg(F.min("hub").alias("m")).select("n", F.least("n", "m").alias("m"))
        outer = stored(around.where("hub > n").join(least, "n").select(F.col("hub").alias("n"), F.col("m").alias("hub")).distinct(), "outer-stars")
        lowest = outer.groupBy("n").agg(F.min("hub").alias("m"))
        inner = outer.join(lowest, "n").where("hub != m").select(F.col("hub").alias("n"), F.col("m").alias("hub"))
        new = stored(inner.unionByName(lowest.withColumnRenamed("m", "hub")).distinct(), "inner-stars")
        discard(links, outer)
        links = new
    told = ids.select("n", "own").join(links.select(F.col("n").alias("own"), "hub"), "own", "left")
    return told.select(F.col("n").alias(node), F.coalesce("hub", "own").alias("component"))


def group_hashes(parts: DataFrame, seed: str, node: str = "event_id") -> DataFrame:
    """(component, hash, size) of (node, component): sha256 of `seed:id|id|...` over a component's ids sorted as strings."""
    name = F.col(node).cast("string")
    return ordered_digest(parts, ["component"], [name], name, start=f"{seed}:", sep="|").withColumnRenamed("n", "size")


def split(nodes: DataFrame, keys: list[str], seed: str, fraction: float, node: str = "event_id") -> DataFrame:
    """(node, component, part): whole components go to `eval`, in the order of their hashes, until they hold the fraction."""
    return split_components(stored(components(nodes, keys, node), "components"), seed, fraction, node)


def split_components(parts: DataFrame, seed: str, fraction: float, node: str = "event_id") -> DataFrame:
    """split() of nodes whose components (node, component) are known.

    The cumulative sizes are taken over one row a component, by ranges. The target is max(1, half-even round of
    n * fraction).
    """
    groups = ranged(group_hashes(parts, seed, node), [], ["hash", "component"])
    n = groups.agg(F.sum("size")).first()[0] or 0
    target = max(1, round(n * fraction))
    sums = running(groups, [], ["hash", "component"], {"upto": Running("sum", F.col("size"))})
    told = sums.select("component", F.when(F.col("upto") - F.col("size") < target, "eval").otherwise("train").alias("part"))
    return parts.join(told, "component").select(node, "component", "part")
