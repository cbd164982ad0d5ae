"""Dataset releases: resolved annotations, leakage-safe splits, reports, and the packages made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import annotation, graph
from .baselines import ratio
from .folds import ordered_digest
from .running import RANGE, ranged
from .tables import stored

#: The label that stands for none, and how far an annotation has come.
NONE = "no_material_event"
INDEPENDENT, ADJUDICATED, EXCLUDED = ("submitted", "needs_adjudication"), "adjudicated", "excluded"


def contract(**checks: bool) -> None:
    """Raises with the names of the checks that did not pass."""
    failed = sorted(name for name, passed in checks.items() if not passed)
    if failed:
        raise ValueError(f"frozen contract failed: {failed}")


def families(labels: Column) -> Column:
    """The distinct prefixes of labels before their first dot, sorted."""
    return F.array_sort(F.array_distinct(F.transform(labels, lambda x: F.split_part(x, F.lit("."), F.lit(1)))))


def signature(labels: Column) -> Column:
    """Sorted labels; the one label NONE where there are none."""
    return F.when(F.size(F.coalesce(labels, F.array().cast("array<string>"))) == 0, F.array(F.lit(NONE))).otherwise(F.array_sort(labels))


def resolved(records: DataFrame) -> DataFrame:
    """Current records (annotation_id, event_id, annotator_id, status, labels, created_at, supersedes_annotation_id) to one
    row an event: annotation_id and labels of its adjudication, else of its first annotator; whether two annotators
    labelled it, agree in labels and in families; and error, where the event breaks a rule.

    Excluded records don't count. An event has one adjudication and two independent annotators at most, who differ, and
    where their labels differ it needs an adjudication. Each event's records are aggregated without listing pairs.
    """
    now = annotation.current(records).where(F.col("status") != EXCLUDED)
    own = F.struct("annotator_id", "annotation_id", signature(F.col("labels")).alias("labels"))
    alone, judged = F.col("status").isin(*INDEPENDENT), F.col("status") == ADJUDICATED
    by = now.groupBy("event_id").agg(
        F.count(F.when(alone, 1)).alias("n"), F.count(F.when(judged, 1)).alias("judged"),
        F.min(F.when(alone, own)).alias("a"), F.max(F.when(alone, own)).alias("b"), F.min(F.when(judged, own)).alias("j"),
    ).where("n + judged > 0")
    double, same = F.col("n") == 2, F.col("a.labels") == F.col("b.labels")
    error = (
        F.when(F.col("judged") > 1, "multiple_adjudications").when(F.col("n") > 2, "over_two_annotations")
        .when(double & (F.col("a.annotator_id") == F.col("b.annotator_id")), "same_annotator")
        .when(double & ~same & (F.col("judged") == 0), "needs_adjudication")
    )
    return by.select(
        "event_id", F.coalesce("j.annotation_id", "a.annotation_id").alias("annotation_id"), F.coalesce("j.labels", "a.labels").alias("labels"),
        double.alias("double"), (double & same).alias("exact"), (double & (families(F.col("a.labels")) == families(F.col("b.labels")))).alias("family"), error.alias("error"),
    )


def release(tasks: DataFrame, records: DataFrame, seed: str, fraction: float) -> DataFrame:
    """(event_id, annotation_id, labels, double, exact, family, component, part): the events of a release.

    tasks: event_id, entity_id, related_event_group. Broken histories, annotations without a task and events that break a
    rule are errors, which name the first few.
    """
    found = stored(resolved(records), "resolved")
    faults = annotation.chain_errors(records).select(F.concat_ws(": ", F.col("annotation_id").cast("string"), "error").alias("e"))
    faults = faults.unionByName(found.where("error is not null").select(F.concat_ws(": ", F.col("event_id").cast("string"), "error").alias("e")))
    faults = faults.unionByName(found.join(tasks, "event_id", "left_anti").select(F.concat_ws(": ", F.col("event_id").cast("string"), F.lit("no task")).alias("e")))
    told = [r["e"] for r in faults.orderBy("e").limit(5).collect()]
    if told:
        raise ValueError(f"annotations cannot be released: {told}")
    kept = tasks.join(found.select("event_id"), "event_id", "left_semi")
    parts = graph.split(kept, ["entity_id", "related_event_group"], seed, fraction)
    return stored(found.drop("error").join(parts, "event_id"), "release-members")  # read by every report of it


def leakage(members: DataFrame, tasks: DataFrame) -> DataFrame:
    """(entities, groups): how many entities and related groups stand in both parts."""
    told = members.select("event_id", "part").join(tasks, "event_id")
    shared = lambda c, name: told.where(F.col(c).isNotNull()).groupBy(c).agg(F.countDistinct("part").alias("n")).agg(F.count(F.when(F.col("n") > 1, 1)).alias(name))
    return shared("entity_id", "entities").join(shared("related_event_group", "groups"), F.lit(True))


def release_report(members: DataFrame, tasks: DataFrame, ontology: DataFrame, rare: int, least: int, most: int, least_double: float) -> DataFrame:
    """One row: sizes, agreement, class counts and rare labels (as `label=n`), leakage, and whether the contract is kept."""
    n, double = F.count("*"), F.count(F.when(F.col("double"), 1))
    agreed = members.agg(
        n.alias("events"), F.count(F.when(F.col("part") == "train", 1)).alias("train"), F.count(F.when(F.col("part") == "eval", 1)).alias("eval"),
        double.alias("double"), ratio(double, n).alias("double_fraction"),
        ratio(F.count(F.when(F.col("exact"), 1)), double).alias("exact_agreement"), ratio(F.count(F.when(F.col("family"), 1)), double).alias("family_agreement"),
        F.count(F.when(F.col("double") & ~F.col("exact"), 1)).alias("adjudicated"),
    )
    counted = annotation.label_report(members, ontology.select("label").unionByName(members.select(F.explode("labels").alias("label"))).distinct(), rare)
    # One row a label of the ontology, so the lists below are bounded by it.
    told = lambda c: F.array_join(F.sort_array(F.collect_list(F.when(c, F.concat_ws("=", "label", F.col("n").cast("string"))))), ",")
    classes = counted.agg(told(F.col("n") > 0).alias("classes"), told(F.col("rare")).alias("rare_labels"))
    gold = tasks.join(members.select("event_id"), "event_id", "left_semi").agg(F.coalesce(F.min(F.when(F.col("annotation_round") == "gold", True).otherwise(False)), F.lit(False)).alias("all_gold"))
    out = agreed.join(classes, F.lit(True)).join(leakage(members, tasks), F.lit(True)).join(gold, F.lit(True))
    size = F.col("events").between(least, most) & F.col("all_gold")
    kept = size & (F.col("double_fraction") >= least_double) & (F.col("entities") == 0) & (F.col("groups") == 0) & (F.col("train") > 0) & (F.col("eval") > 0)
    return out.withColumn("contract_passed", kept).drop("all_gold")


def model_rows(members: DataFrame, tasks: DataFrame) -> DataFrame:
    """(event_id, part, line): a task as a model sees it, without its company and entity, as one canonical JSON line."""
    told = members.join(tasks.select("event_id", "text", "filing_type", "prior", "source_published_at", "tradable_at"), "event_id")
    given = F.struct("filing_type", F.col("prior").alias("prior_company_disclosure"), F.col("source_published_at").cast("string").alias("source_published_at"), "text", F.col("tradable_at").cast("string").alias("tradable_at"))
    labels = F.filter("labels", lambda x: x != NONE)
    target = F.struct(labels.alias("labels"), (F.size(labels) == 0).alias("no_material_event"))
    line = F.to_json(F.struct("event_id", given.alias("input"), target.alias("target")), {"ignoreNullFields": "false"})
    return told.select("event_id", "part", line.alias("line"))


def write_lines(rows: DataFrame, path: str, order: str = "event_id", line: str = "line") -> DataFrame:
    """Writes the lines as ordered text files under path, a file a range of `order`, and tells (part, items, sha256): of each
    file by its number, and of all lines in order with part null.

    No line passes the driver: ranges are written side by side, each file's digest is taken over its range, and the
    whole digest is one task's stream of the ranges in order. The files' names sort as their numbers do, so that digest is
    that of the files one after another.
    """
    lines = ranged(rows.select(order, F.concat(F.col(line), F.lit("\n")).alias("_line")), [], [order])
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = lines.repartitionById(parts, F.col(RANGE)).sortWithinPartitions(order).select(F.expr("left(_line, char_length(_line) - 1)").alias("value"))
    out.write.text(path)
    each = ordered_digest(lines.withColumnRenamed(RANGE, "part"), ["part"], [F.col(order)], F.col("_line"), name="sha256")
    whole = ordered_digest(lines.withColumn("part", F.lit(None).cast("int")), ["part"], [F.col(order)], F.col("_line"), name="sha256")
    return whole.unionByName(each).select("part", F.col("n").alias("items"), "sha256")


def write_package(rows: DataFrame, path: str, names: list[str], order: str = "event_id") -> DataFrame:
    """write_lines of each named part of rows (event_id, part, line) under path/<name>.jsonl, as (name, part, items, sha256);
    a part without rows writes nothing and has no row."""
    out = None
    for name in names:
        own = write_lines(rows.where(F.col("part") == name), f"{path}/{name}.jsonl", order).select(F.lit(name).alias("name"), "*")
        out = own if out is None else out.unionByName(own)
    return out
