"""Annotation histories, agreement, votes and releases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranking
from .asof import first_of
from .running import Running, ranged, running

#: The order in which models break ties.
MODELS = ["A", "B", "C", "D", "E"]


def current(records: DataFrame, key: str = "annotation_id", supersedes: str = "supersedes_annotation_id") -> DataFrame:
    """Records that no other record supersedes."""
    gone = records.where(F.col(supersedes).isNotNull()).select(F.col(supersedes).alias(key)).distinct()
    return records.join(gone, key, "left_anti")


def chain_errors(records: DataFrame) -> DataFrame:
    """(annotation_id, error): missing targets, targets superseded twice, other annotators' targets, times that don't grow."""
    r = records.select("annotation_id", "annotator_id", "created_at", "supersedes_annotation_id")
    old = r.select(F.col("annotation_id").alias("supersedes_annotation_id"), F.col("annotator_id").alias("o_annotator"), F.col("created_at").alias("o_created"))
    link = r.where("supersedes_annotation_id is not null").join(old, "supersedes_annotation_id", "left")
    link = link.withColumn("twice", F.count("*").over(Window.partitionBy("supersedes_annotation_id")) > 1)
    found = F.array(
        F.when(F.col("o_annotator").isNull(), F.lit("missing_target")),
        F.when(F.col("twice"), F.lit("superseded_twice")),
        F.when(F.col("o_annotator") != F.col("annotator_id"), F.lit("other_annotator")),
        F.when(F.col("created_at") <= F.col("o_created"), F.lit("time_not_increasing")),
    )
    told = link.withColumn("_e", F.filter(found, lambda e: e.isNotNull()))
    return told.select("annotation_id", F.explode("_e").alias("error"))


def next_task(tasks: DataFrame, records: DataFrame, annotators: DataFrame) -> DataFrame:
    """For each annotator the first task without a record of theirs, by round (calibration first, then gold) and event."""
    rank = F.when(F.col("annotation_round") == "calibration", 0).when(F.col("annotation_round") == "gold", 1).otherwise(2)
    seen = records.select("event_id", "annotator_id").distinct()
    # Tasks are numbered once; an annotator's first gap is the least task number they lack, found without listing
    # annotators x tasks: numbers 1..n of their own records are in place until the first gap.
    numbered = ranking.numbered(tasks.select("event_id", rank.alias("r")), ["r", "event_id"], "i").select("event_id", "i")
    own = seen.join(numbered, "event_id").withColumn("j", F.row_number().over(Window.partitionBy("annotator_id").orderBy("i")))
    gap = own.where("i = j").groupBy("annotator_id").agg((F.max("i") + 1).alias("i"))
    first = annotators.join(gap, "annotator_id", "left").withColumn("i", F.coalesce("i", F.lit(1)))
    return first.join(numbered, "i", "left").select("annotator_id", "event_id")


def vote(votes: DataFrame, item: list[str], value: str = "value", model: str = "model") -> DataFrame:
    """One row an item: the value with most votes, ties by the first model in priority that chose it, then by value.

    A model without a place in the priority is an error. rule: unanimous, strict_majority (over half of those who voted on the item) or model_priority_tiebreak.
    """
    place = F.array_position(F.lit(MODELS), F.col(model))
    priority = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("no such model: "), F.coalesce(F.col(model), F.lit("null")))))
    by = votes.groupBy(*item, value).agg(F.count("*").alias("n"), F.min(priority).alias("p"), F.array_join(F.sort_array(F.collect_list(model)), ",").alias("supporters"))
    total = F.sum("n").over(Window.partitionBy(*item))
    best = first_of(by.withColumn("voters", total), item, [F.desc("n"), F.asc("p"), F.asc(value)])
    rule = F.when(F.col("n") == F.col("voters"), "unanimous").when(F.col("n") * 2 > F.col("voters"), "strict_majority").otherwise("model_priority_tiebreak")
    return best.select(*item, value, F.col("n").alias("support"), "voters", "supporters", rule.alias("rule"))


def agreement(decisions: DataFrame, family: Column | None = None) -> DataFrame:
    """One row: events with two decisions, the share that agree, the share that agree in family, and disagreements."""
    fam = F.split_part(F.col("event_type"), F.lit("."), F.lit(1)) if family is None else family
    pair = decisions.withColumn("_f", fam).groupBy("event_id").agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("v"), F.countDistinct("_f").alias("f")).where("n = 2")
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.when(c, 1.0).otherwise(0.0)), F.count("*").cast("double")), F.lit(0.0))
    return pair.agg(F.count("*").alias("events"), share(F.col("v") == 1).alias("leaf_agreement"), share(F.col("f") == 1).alias("family_agreement"), F.count(F.when(F.col("v") > 1, 1)).alias("disagreements"))


def calibration_agreement(pairs: DataFrame) -> DataFrame:
    """(measure, n, event_id) of pairs (event_id, a, b), two annotators' decisions or null: a row each for tasks, completed_a,
    completed_b, paired and agreed with its count, and a row for each disagreed and each incomplete event with its id."""
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    count = lambda name, c: F.struct(F.lit(name).alias("measure"), F.count(F.when(c, 1)).alias("n"))
    sums = pairs.agg(F.array(count("tasks", F.lit(True)), count("completed_a", F.col("a").isNotNull()), count("completed_b", F.col("b").isNotNull()), count("paired", both), count("agreed", F.col("a") == F.col("b"))).alias("m"))
    told = sums.select(F.inline("m")).withColumn("event_id", F.lit(None).cast(pairs.schema["event_id"].dataType))
    named = pairs.withColumn("measure", F.when(~both, "incomplete").when(F.col("a") != F.col("b"), "disagreed")).where("measure is not null")
    return told.unionByName(named.select("measure", F.lit(1).cast("long").alias("n"), "event_id"))


def label_report(labelled: DataFrame, ontology: DataFrame, threshold: int) -> DataFrame:
    """(label, n, rare) for every label of the ontology, absent ones with 0."""
    counts = labelled.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    out = ontology.select("label").join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.withColumn("rare", F.col("n") < threshold)


def evidence(quotes: DataFrame, item: list[str]) -> DataFrame:
    """The span most models quote; ties by length, start, end."""
    by = quotes.groupBy(*item, "start", "stop").agg(F.countDistinct("model").alias("support"))
    return first_of(by, item, [F.desc("support"), (F.col("stop") - F.col("start")).asc(), F.asc("start"), F.asc("stop")])


def prior_disclosure(tasks: DataFrame, chars: int = 1200) -> DataFrame:
    """tasks (task_id, entity_id, published, text) with the text of the entity's last task published strictly before."""
    # One row a moment first: at equal times the largest task id speaks, and its peers don't see each other.
    moment = tasks.groupBy("entity_id", "published").agg(F.max_by(F.substring("text", 1, chars), "task_id").alias("t"))
    key, order = ["entity_id"], ["published"]
    before = running(ranged(moment, key, order), key, order, {"_last": Running("last", F.struct("t"), before=True)})
    return tasks.join(before.select("entity_id", "published", F.col("_last")["t"].alias("prior")), ["entity_id", "published"])


def round_robin(df: DataFrame, stratum: Column, order: str, n: int) -> DataFrame:
    """n rows, taken from the strata in turn: every stratum's first, then every second, and so on."""
    ranked = df.withColumn("stratum", stratum).withColumn("turn", F.row_number().over(Window.partitionBy("stratum").orderBy(order)))
    return ranked.where(F.col("turn") <= n).orderBy("turn", "stratum", order).limit(n)
